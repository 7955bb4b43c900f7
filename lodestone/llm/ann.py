"""Approximate nearest neighbours through learned partitions.

On a bounded sample the neighbour graph is cut into balanced parts (recursive spectral bisection at the median, then
swaps that lower the cut). A small classifier learns, for a vector, how its neighbours spread over the parts. Every
vector is stored in its most probable part; a query visits as many of its most probable parts as a calibration on
held-out vectors needs for ``TARGET`` recall, and more where these hold fewer than k other ids; all vectors found there
are ranked by their exact cosine.

Parts are handled in blocks of rows and of queries, so no task holds a whole part, however large or hot.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows with a null id; ties go to the smaller id; a query never finds its own id;
repeated rows of one id are one candidate (their best score) and one query; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored
from .neardup import _runs

SAMPLE = 4_000
HELD_OUT = 400
ROWS_A_PART = 800
MOST_PARTS = 256
TARGET = 0.95
BLOCK = 4_096


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """Row numbers of the k nearest other rows by cosine."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(graph: np.ndarray, seed: int) -> np.ndarray:
    """A balanced two-way cut of a dense symmetric graph: True for one half."""
    n = len(graph)
    degree = np.maximum(graph.sum(axis=1), 1e-9)
    scale, rng = 1 / np.sqrt(degree), np.random.default_rng(seed)
    flat, v = np.sqrt(degree), rng.standard_normal(n).astype(np.float32)
    flat = flat / np.linalg.norm(flat)
    for _ in range(60):  # power iteration towards the second eigenvector
        v = v - flat * (flat @ v)
        v = 0.5 * v + 0.5 * scale * (graph @ (scale * v))
        v /= max(np.linalg.norm(v), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v * scale, kind="stable")[n // 2 :]] = True
    for _ in range(10):  # swaps keep the balance
        to_true, own = graph @ side.astype(np.float32), graph.sum(axis=1)
        gain = np.where(side, own - 2 * to_true, 2 * to_true - own)
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b), max(1, n // 50))
        better = gain[a[:m]] + gain[b[:m]] - 2 * graph[a[:m], b[:m]] > 0
        if not better.any():
            break
        side[a[:m][better]], side[b[:m][better]] = False, True
    return side


def balanced_parts(near: np.ndarray, depth: int) -> np.ndarray:
    """Part (0 to 2**depth - 1) of each vertex."""
    n = len(near)
    graph = np.zeros((n, n), np.float32)
    graph[np.repeat(np.arange(n), near.shape[1]), near.ravel()] = 1
    graph = np.maximum(graph, graph.T)
    part = np.zeros(n, np.int64)
    for level in range(depth):
        whole, part = part, np.zeros(n, np.int64)
        for p in range(2**level):
            own = np.flatnonzero(whole == p)
            side = _halves(graph[np.ix_(own, own)], level * 1000 + p) if len(own) > 1 else np.zeros(len(own), bool)
            part[own] = 2 * p + side
    return part


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer over unit vectors, and the number of parts to visit."""

    layers: tuple[np.ndarray, ...]
    probes: int

    @property
    def n_parts(self) -> int:
        return self.layers[-1].shape[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(x @ a + b, 0) @ c + d

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def fit_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, steps: int = 600, rate: float = 3e-3) -> tuple[np.ndarray, ...]:
    """Weights by Adam on the cross-entropy with soft targets."""
    rng = np.random.default_rng(11)
    layers = [rng.standard_normal((x.shape[1], hidden)) * math.sqrt(2 / x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * 0.05, np.zeros(target.shape[1])]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(x), min(512, len(x)))
        h = np.maximum(x[at] @ layers[0] + layers[1], 0)
        z = h @ layers[2] + layers[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
        dh = (dz @ layers[2].T) * (h > 0)
        for i, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
            g = g + 1e-4 * layers[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return tuple(layers)


def learn(sample: np.ndarray, n_rows: int, k: int = 5, target: float = TARGET) -> Router:
    """A router from a bounded sample of vectors, for a table of ``n_rows``."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    held, x = x[: min(HELD_OUT, len(x) // 5)], x[min(HELD_OUT, len(x) // 5) :]
    depth = int(min(math.log2(MOST_PARTS), max(0, round(math.log2(max(n_rows, 1) / ROWS_A_PART)))))
    depth = min(depth, int(math.log2(max(len(x) // 16, 1))))
    near = neighbour_graph(x, min(10, max(len(x) - 1, 1))) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    part = balanced_parts(near, depth)
    soft = np.zeros((len(x), 2**depth))
    np.add.at(soft, (np.arange(len(x)), part), max(near.shape[1], 1))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    layers = fit_router(x, soft / soft.sum(axis=1, keepdims=True))
    router = Router(layers, 2**depth)
    if not len(held) or depth == 0:
        return router
    home = router.ranked(x)[:, 0]
    best = np.argsort(-(held @ x.T), axis=1)[:, :k]
    place = np.argsort(router.ranked(held), axis=1)  # of each part in a query's order
    need = place[np.arange(len(held))[:, None], home[best]]
    recall = [(need < p).mean() for p in range(1, 2**depth + 1)]
    return Router(layers, next(p for p, r in enumerate(recall, 1) if r >= min(target, recall[-1])))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, row, cosine) of the k nearest rows of each query, ties to the smaller id, without the query's own id."""
    def norm(m):
        scale = np.abs(m).max(axis=1, keepdims=True)
        return np.sqrt(((m / scale) ** 2).sum(axis=1)), scale
    (qn, qs), (rn, rs) = norm(queries), norm(rows)
    q, r = queries / qs, rows / rs
    rough = (q / qn[:, None]) @ (r / rn[:, None]).T
    out = []
    for i in range(len(queries)):
        s = rough[i]
        s[row_ids == query_ids[i]] = -np.inf
        floor = np.partition(s, -k)[-k] if len(s) > k else -np.inf
        at = np.flatnonzero((s >= floor - 1e-9) & (s > -np.inf))
        exact = (r[at] * q[i]).sum(axis=1) / (rn[at] * qn[i])  # one order of summation for all rows, so equal vectors tie
        taken = set()
        for j in np.lexsort((row_ids[at], -exact)).tolist():
            if row_ids[at[j]] not in taken:
                taken.add(row_ids[at[j]])
                out.append((int(query_ids[i]), int(row_ids[at[j]]), float(exact[j])))
                if len(taken) == k:
                    break
    return out


def _enough(index: DataFrame, n_parts: int, visit: int, k: int) -> Column:
    """The first ``visit`` parts of a query's ranking, and more until they hold ``k`` ids besides its own.

    An id counts in one part only, so rows repeated in several parts are not taken for more ids.
    """
    held = index.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    ids = {r["part"]: r["n"] for r in held.collect()}  # at most MOST_PARTS rows
    sizes = F.array(*(F.lit(ids.get(i, 0)).cast("long") for i in range(n_parts)))
    start = F.struct(F.lit(0).cast("long").alias("ids"), F.lit(0).alias("parts"))
    more = lambda have, part: F.when(have["ids"] > k, have).otherwise(F.struct((have["ids"] + sizes[part]).alias("ids"), (have["parts"] + 1).alias("parts")))
    return F.slice("visits", F.lit(1), F.greatest(F.lit(visit), F.aggregate("visits", start, more)["parts"]))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, target: float = TARGET, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that ``is_query`` marks."""
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector_column))).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.where(F.size("v") == dim)
    chosen = rows.select("v", F.xxhash64("vec_id").alias("h"))
    if n > 4 * sample:
        chosen = chosen.where(F.pmod("h", F.lit(1_000_000)) < int(4_000_000 * sample / n))
    got = chosen.orderBy("h").limit(sample).collect()
    router = learn(np.array([r["v"] for r in got]), n, k, target)
    visit = router.probes if probes is None else min(probes, router.n_parts)

    def placed(batches):
        for batch in pieces(batches):
            x = _matrix(batch.column(1))
            ranked = router.ranked(x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True))
            asks = batch.column(2).to_pylist()
            parts = [ranked[i].tolist() if a else [] for i, a in enumerate(asks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranked[:, 0].astype(np.int32)), pa.array(parts, pa.list_(pa.int32()))], ["vec_id", "v", "part", "visits"])

    index = stored(rows.mapInArrow(placed, "vec_id long, v array<double>, part int, visits array<int>"), "ann-index")
    queries = index.where(F.size("visits") > 0).select("vec_id", "v", F.explode(_enough(index, router.n_parts, visit, k)).alias("part"))
    row_blocks = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    query_blocks = queries.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asked"))
    grid = F.broadcast(stored(row_blocks.join(query_blocks, "part"), "ann-grid"))  # at most MOST_PARTS rows
    own = lambda many: F.pmod(F.xxhash64("vec_id"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    dealt = index.select("vec_id", "v", "part").join(grid, "part").select("part", own("rows").alias("row_block"), every("asked").alias("query_block"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = queries.join(grid, "part").select("part", every("rows").alias("row_block"), own("asked").alias("query_block"), F.lit(True).alias("asks"), "vec_id", "v")

    def ranked(batches):
        for group in _runs(batches, 3):
            asks, ids, x = group.column(3).to_numpy(), group.column(4).to_numpy(), _matrix(group.column(5))
            if asks.any() and not asks.all():
                found = nearest(x[asks], ids[asks], x[~asks], ids[~asks], k)
                if found:
                    a, b, s = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    found = dealt.unionByName(asked).repartition("part", "row_block", "query_block").sortWithinPartitions("part", "row_block", "query_block")
    found = found.mapInArrow(ranked, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
