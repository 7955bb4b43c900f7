import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann


def brute(ids, x, queries, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[ids.tolist().index(q)]
        order = [j for j in np.lexsort((ids, -s)).tolist() if ids[j] != q]
        out[q] = ids[order[:k]].tolist()
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 1.0) for i, row in zip(ids, x)], "vec_id long, embedding array<float>, score double")


@pytest.mark.parametrize("clusters", [0, 30])
def test_recall(spark, monkeypatch, clusters):
    monkeypatch.setattr(ann, "ROWS_A_PART", 200)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16))
    if clusters:
        x = 0.3 * x + 2 * rng.standard_normal((clusters, 16))[rng.integers(0, clusters, 3000)]
    x, ids = x.astype(np.float32), np.arange(3000)
    got = ann.search(frame(spark, ids, x), F.col("vec_id") % 50 == 0, sample=1500).collect()
    want = brute(ids, x.astype(float), range(0, 3000, 50))
    found = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want}
    assert all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 for r in got)


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    part = ann.balanced_parts(ann.neighbour_graph(rng.standard_normal((1000, 8))), 3)
    assert np.bincount(part, minlength=8).tolist() == [125] * 8


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    x = np.repeat(np.eye(4, dtype=np.float32), 30, axis=0)
    got = ann.search(frame(spark, np.arange(120), x), F.col("vec_id") % 50 == 0).collect()
    by = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in (0, 50, 100)}
    assert by == {0: [1, 2, 3, 4, 5], 50: [30, 31, 32, 33, 34], 100: [90, 91, 92, 93, 94]}
    assert all(r.score == 1.0 for r in got)


def test_parts_with_few_rows_are_not_the_end(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_PART", 50)
    x = np.random.default_rng(3).standard_normal((400, 8)).astype(np.float32)
    df = frame(spark, np.arange(400), x)
    found = ann.search(df.unionByName(df), F.col("vec_id") % 50 == 0, k=120, probes=1).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {q: 120 for q in range(0, 400, 50)}
    everything = ann.search(df, F.col("vec_id") % 50 == 0, k=1000, probes=1).groupBy("query_id").count().collect()
    assert {r["count"] for r in everything} == {399}


def test_defined_cases(spark):
    good = [1.0, 2.0]
    rows = [(0, good), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [2.0, 1.0]), (8, [2.0, 1.0]), (None, good), (50, [-1.0, -2.0]), (9, [1e300, 2e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted({r.vec_id for r in got if r.query_id == 0}) == [8, 9, 50]
    assert [(r.rank, r.vec_id) for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [(1, 9), (2, 8), (3, 50)]
    assert {r.query_id for r in got} == {0, 50}
    assert ann.search(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).collect() == []
