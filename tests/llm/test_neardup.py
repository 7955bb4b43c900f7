import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neardup
from lodestone.llm.components import components


def brute(rows, width, threshold):
    """component of each id, by comparing all pairs of full sets."""
    sets = [(i, neardup.shingles((t or "").encode(), width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and threshold[1] * len(a & b) >= threshold[0] * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def mutated(rng, words, share):
    return [w if rng.random() > share else f"w{rng.integers(10**6)}" for w in words]


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rng = np.random.default_rng(width)
    texts = []
    for _ in range(6):
        base = [f"w{rng.integers(300)}" for _ in range(rng.integers(30, 200))]
        texts += [" ".join(mutated(rng, base, s)) for s in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2)]
    texts += [" ".join(f"x{rng.integers(50)}" for _ in range(60)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    want = brute(rows, width, (80, 100))
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert all(r.n_shingles == len(neardup.shingles(texts[r.doc_id].encode(), width)) for r in got)


def test_crowded_bucket_with_several_components(spark, monkeypatch):
    """A large group whose members are near the threshold: blocks and visitors must find every link."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(mutated(rng, base, 0.05))) for i in range(90)]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 2, (80, 100))


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "one", None), (5, "ONE", "e"), (6, "one two", "f"), (7, "One  two", "g"), (7, "One  two", "g"), (None, "one two", "h"), (9, "ı İ", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = neardup.near_duplicates(docs, width=2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[4] == (1, 4) and by[5] == (1, 4) and by[6] == (1, 6) and by[7] == (1, 6)
    assert neardup.near_duplicates(docs.where("false")).collect() == []
    kept = {r.doc_id for r in neardup.one_of_each(docs, width=2).collect()}
    assert {1, 2, 3, 4, 6, 9} <= kept and 5 not in kept and 7 not in kept


def test_rows_of_one_id(spark):
    """Ids 3 and 8 have two sets each; what either is linked with is one component."""
    a, b, c = ("one two three four five", "six seven eight nine ten", "all other words stand here")
    rows = [(3, a), (3, b), (5, b), (1, a), (8, b), (8, c), (9, c), (10, "alone in this table")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1))
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, width=2).collect()}
    assert got == {(i, 1) for i in (1, 3, 5, 8, 9)} | {(10, 10)}
    kept = neardup.one_of_each(docs, width=2)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 10}


def test_sequential_test_keeps_the_similar():
    table = neardup.least_matches(240, 0.8, 1e-6)
    assert table[-1][0] == 240 and all(m < 0.8 * n for n, m in table)
    rng = np.random.default_rng(0)
    left = rng.integers(0, 2**16, (2000, 240)).astype(np.uint16)
    same = rng.random((2000, 240)) < 0.82
    right = np.where(same, left, rng.integers(0, 2**16, (2000, 240))).astype(np.uint16)
    assert len(neardup.surviving(left, right, 0.8, 1e-6)) == 2000
    far = np.where(rng.random((2000, 240)) < 0.5, left, rng.integers(0, 2**16, (2000, 240))).astype(np.uint16)
    assert len(neardup.surviving(left, far, 0.8, 1e-6)) == 0


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components(chain.where("false")).collect() == []
