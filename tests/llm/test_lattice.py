import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import lattice
from lodestone.llm.common import fold

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return lattice.vocabulary(PATH)


def brute(word, names, log_p):
    """Sum over all segmentations, written as plain recursion."""
    weight = dict(zip(names, log_p))
    text = "▁" + word

    def total(k):
        if k == len(text):
            return 1.0
        out = 0.0
        for end in range(k + 1, len(text) + 1):
            piece = text[k:end]
            if piece in weight:
                out += math.exp(weight[piece]) * total(end)
            elif end == k + 1:
                out += math.exp(sum(weight[f"<0x{b:02X}>"] for b in piece.encode())) * total(end)
        return out

    return math.log(total(0))


WORDS = ["a", "the", "reading", "ärger", "日本語", "x\U0001f600y", "zzzz", "�", "of,the."]


def test_forward_is_the_sum_over_segmentations(table):
    names, log_p = table
    assert abs(np.logaddexp.reduce(log_p)) < 1e-9
    got = lattice.Lattice(names, log_p).score(WORDS)
    assert got == pytest.approx([brute(w, names, log_p) for w in WORDS], rel=1e-9)


def test_expected_uses(table):
    """Expected counts are the derivatives of the log-probability."""
    names, log_p = table
    words, counts = ["reading", "ärger", "日"], np.array([2, 1, 3])
    uses = lattice.Lattice(names, log_p).expected(words, counts)
    for i in np.flatnonzero(uses > 1e-6)[:25]:
        moved = log_p.copy()
        moved[i] += 1e-5
        rise = (lattice.Lattice(names, moved).score(words) - lattice.Lattice(names, log_p).score(words)) @ counts / 1e-5
        assert uses[i] == pytest.approx(rise, rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("most_shared", [200_000, 20, 0])
def test_scores(spark, most_shared):
    texts = [None, "", " ", "the cat the DOG\tthe", "the cat ß İ 日本", "rare words here", "the cat " * 300] * 3
    rows = [(i, t, 0.5) for i, t in enumerate(texts)] + [(3, texts[3], 0.5), (None, "the cat", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = lattice.score(docs, fold("doc_id") != 1, PATH, most_shared=most_shared).collect()
    assert len(got) == len(rows)
    held = {r.doc_id: r.h for r in docs.select("doc_id", (fold("doc_id") == 1).alias("h")).collect()}
    count, n_docs = Counter(), 0
    for i, t, _ in rows:
        if not held[i]:
            count.update((t or "").encode().lower().split())
            n_docs += 1
    n, v = sum(count.values()) + n_docs, len(count) + 1
    want = Counter()
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        c = [count[w] for w in words] + [n_docs]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c)
        want[i, len(c), sum(x > 0 for x in c), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    one, two = (next(r.score for r in got if r.doc_id == k) for k in (1, 6))
    assert two < one


def test_a_distribution(spark, table):
    """Piece and end weights sum to one after re-estimation, and training raises the corpus's likelihood."""
    names, first = table
    words = spark.createDataFrame([("the", 50), ("cat", 20), ("reading", 5)], "word string, c long")
    model = lattice.fit(words, 7, PATH)
    assert abs(np.logaddexp(np.logaddexp.reduce(model.log_p), model.log_end)) < 1e-9
    counts, listed = np.array([50, 20, 5]), ["the", "cat", "reading"]
    assert lattice.Lattice(names, model.log_p).score(listed) @ counts > lattice.Lattice(names, first).score(listed) @ counts


def test_empty_table(spark):
    assert lattice.score(spark.createDataFrame([], "doc_id long, text string"), fold("doc_id") != 1, PATH).collect() == []
