import random

import numpy as np
import pytest

from lodestone.llm import toxicity
from lodestone.llm.common import fold

BAD = ["scum", "moron", "vile"]


def corpus(n=600):
    r = random.Random(4)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choices(words, k=r.randint(3, 9))) for _ in range(r.randint(1, 12))]
        toxic = r.random() < 0.25
        if toxic:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(BAD)
        docs.append((i, ". ".join(sentences) + ".", "toxic"))
        if i % 4:
            labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    return d, toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, toxic int"), fold("doc_id") != 0)


def test_held_out_accuracy_and_location(spark, learnt):
    docs, model = learnt
    got = toxicity.score(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    wrong = 0
    for r in got:
        toxic = any(b in texts[r.doc_id] for b in BAD)
        wrong += (r.score >= 0.5) != toxic
        assert 0 <= r.score <= 1
        if toxic and r.score >= 0.5:
            assert all(any(b in texts[r.doc_id][s.begin : s.end] for b in BAD) for s in r.sentences)
            assert len(r.sentences) == 1
    assert wrong <= 6
    kept = {r.doc_id for r in toxicity.accepted(docs, model).collect()}
    assert kept == {r.doc_id for r in got if r.score < 0.5}
    assert toxicity.accepted(docs, model).columns == docs.columns


def test_noisy_or_gradient():
    """The fit's bags: one word decides, in whatever sentence it stands."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        bag = [[int(w) for w in rng.integers(1, 20, 3)] for _ in range(rng.integers(1, 5))]
        y = int(rng.random() < 0.3)
        if y:
            bag[rng.integers(len(bag))].append(0)
        rows.append((y, bag))
    weights, bias = toxicity.fit_bags(toxicity.packed(rows), 20)
    assert weights[0] > 3 and weights[0] > 2 * np.abs(weights[1:]).max() and bias < -2


def test_defined_cases(spark, learnt):
    _, model = learnt
    rows = [(1, None), (2, ""), (3, "..."), (None, "scum"), (5, "scum"), (5, "scum"), (6, "scum " * 30_000)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == 0.0 and by[None] == by[5] > 0.5 and by[6] > 0.5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.learn(empty, spark.createDataFrame([(1, None)], "doc_id long, toxic int"), fold("doc_id") != 0)
    assert none.weights == {} and toxicity.score(spark.createDataFrame([(1, "a. b")], "doc_id long, text string"), none).first().score < 0.5


def test_neutral_sentences_do_not_add_up(spark, learnt):
    docs, model = learnt
    known = set(toxicity.WORD.findall(" ".join(r.text for r in docs.collect()).lower())) - set(BAD)
    neutral = ". ".join(["of nothing at all"] * 50_000)
    r = random.Random(5)
    seen = ". ".join(" ".join(r.choices(sorted(known), k=5)) for _ in range(50_000))
    rows = [(1, neutral), (2, seen), (3, neutral + ". scum"), (4, "scum")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == 0 and got[2] < 0.5 and got[3] == got[4] > 0.5
    assert {r.doc_id for r in toxicity.accepted(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()} == {1, 2}


def test_consistent_words_and_inflected_forms(spark):
    """Every rare toxic word shares its documents with a frequent one, which could take all the credit."""
    r = random.Random(6)
    words = [a + b + "en" for a in "bdfgklmnpr" for b in ("alt", "eist", "orn", "und", "ipf")]
    forms = ["achlich" + e for e in ("zu", "ver", "ung", "keit", "bar", "los")]
    text = lambda *more: ". ".join(" ".join(r.choices(words, k=6)) for _ in range(6)) + ". " + " ".join([*r.choices(words, k=3), *more]) + "."
    docs = [(i, text("scum", r.choice(forms), r.choice(forms)) if i % 5 == 0 else text(), int(i % 5 == 0)) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.learn(d, d.select("doc_id", "toxic"), fold("doc_id") >= 0)
    asked = [(i, text(*more)) for i, more in enumerate([("scum",), ("achlichzu", "achlichver"), ("achlichheit", "achlichsam"), ()])]
    got = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] > 0.5 and got[3] < 0.5
