import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from lodestone.llm import mixing, neardup
from lodestone.llm.common import stored

from test_privacy import base  # noqa: I001


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(260):
        text = ". ".join(" ".join(r.choices(words, k=r.randint(4, 12))) for _ in range(r.randint(3, 9)))
        toxic = r.random() < 0.2
        if toxic:
            text += ". you vile " + r.choice(["scum", "moron"])
        elif r.random() < 0.1:
            text += f" write to p{i}@host{i}.org or 10.0.0.{i % 250}"
        rows.append((i, text, "en", f"src{0 if i % 3 else i % 7}", len(text)))
        labels.append((i, int(toxic)))
    clean = [row for row, (_, y) in zip(rows, labels) if not y]
    for k, row in enumerate(clean[:12]):
        rows.append((1000 + k, row[1] if k % 2 else row[1] + " more", "en", "copies", 1))
    rows += [(2000, None, None, None, None), (2001, "", "en", "src0", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, dict(labels)


def test_stages_one_by_one(spark, corpus):
    path, rows, labels = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "pii", "mixing", "sentencepiece"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["toxicity"]}
    toxic = {i for i, t, *_ in rows if t and "vile" in t}
    assert not kept & toxic and kept == {i for i, *_ in rows} - toxic
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    left = {r.doc_id for r in seen["near_dedup"]}
    sets = {i: neardup.shingles(texts[i], 5) for i in kept}
    same = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    for i in kept:
        if i in left:
            assert not any(same(i, j) for j in left if j != i)
        else:
            assert any(same(i, j) for j in kept if j < i)
    private = {r.doc_id: r for r in seen["pii"]}
    assert private.keys() == left
    for i, r in private.items():
        assert not base(r.text or "")
        assert r.text is None or r.n_chars == len(r.text)
        if not base(texts[i].decode()):
            assert (r.text or "").encode() == texts[i]
    order = [r.doc_id for r in seen["mixing"]]
    assert sorted(order) == sorted(left)
    before = spark.createDataFrame(seen["pii"], docs.schema)
    assert order == [r.row.doc_id for r in sorted(mixing.mix(before).collect(), key=lambda r: r.position)]


def test_run(spark, corpus):
    path, *_ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), "again")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: library.encode(r.text or "", add_bos=True, add_eos=True) for r in docs.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the mix lies in several files
    try:
        result = corpus_pipeline.run(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in result} == want
    assert sorted(r.position for r in result) == list(range(len(result)))
    mixed = sorted(mixing.mix(docs).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in sorted(result, key=lambda r: r.position)] == [r.row.doc_id for r in mixed]


def test_one_row_of_each(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text), (3, "a b"), (3, "a b"), (3, "c d"), (None, text), (None, "lone"), (None, "lone"), (None, None), (5, ""), (6, None), (6, None)]
    docs = spark.createDataFrame([(*r, {"k": i}) for i, r in enumerate(rows)], "doc_id long, text string, h map<string,int>")
    kept = neardup.one_of_each(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, text), (3, "a b"), (3, "c d"), (None, "lone"), (5, ""), (6, None)], key=str)
    assert neardup.one_of_each(docs).columns == docs.columns


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
