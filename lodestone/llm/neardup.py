"""MinHash near-duplicate classes with sequential Bayesian verification.

1. Every text becomes its set of word shingles; documents with the same set form a class at once.
2. A class has a MinHash signature of ``bands * rows`` lanes. Classes that agree on all lanes of a band share a bucket.
3. In each bucket every class is compared with the bucket's smallest class; links found there are followed, and only
   classes of a bucket that are still in different components are compared with each other, in blocks. No bucket's
   pairs are ever listed.
4. A candidate pair's signatures are compared a batch of lanes at a time. With m of n lanes equal and a uniform prior,
   the similarity is Beta(m + 1, n - m + 1); the pair is dropped as soon as the chance of reaching the threshold falls
   under ``miss``.
5. Survivors are verified on their full shingle sets, and components follow from the verified links.

Defined results: texts are lower-cased (A-Z) and cut at ASCII white space; a text with fewer words than a shingle has
its whole word sequence as one shingle; null texts and texts without words have the empty set and are linked with
nothing; rows that share an id are one document, linked with what any of their sets is; a null id is linked with
nothing and is its own component (null);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, utf8
from .components import components

BANDS, ROWS = 40, 6
BATCH = 30
MISS = 1e-6
BLOCK = 2048

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
        k += m
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> set[bytes]:
    """The exact set, for verification."""
    words = text.lower().split()
    if not words:
        return set()
    if len(words) < width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the same set."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    np.take(_SPACE, data, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = 1 << max(14, (len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(data)], out=sums[1:])
    words = _mixed((sums[end] - sums[begin]) * _powers(_INVERSE, size)[begin] + (end - begin).astype(np.uint64))
    n = max(1, len(words) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        mixed = _mixed(mixed * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return np.unique(mixed)


@lru_cache(maxsize=4)
def _family(lanes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 2**31, lanes, dtype=np.uint32) << np.uint32(1)) | np.uint32(1), rng.integers(0, 2**32, lanes, dtype=np.uint32)


def signature(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """16 bits of the least value of each of ``lanes`` hash functions."""
    a, b = _family(lanes)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(lanes, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024, None] * a + b).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


@lru_cache(maxsize=16)
def least_matches(lanes: int, threshold: float, miss: float, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(n, m): after n lanes a pair goes on only with m equal lanes or more.

    P(similarity >= t | m of n) = P(Bin(n + 1, t) <= m), for the uniform prior.
    """
    found = []
    for n in [*range(batch, lanes, batch), lanes]:
        total, m = 0.0, -1
        while m < n and total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append((n, m))
    return tuple(found)


def surviving(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Row numbers of the pairs of signatures that the sequential test keeps."""
    alive, equal, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in least_matches(left.shape[1], threshold, miss):
        equal = equal + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        keep = equal >= least
        alive, equal, done = alive[keep], equal[keep], n
        if not len(alive):
            break
    return alive


def _lanes(column: pa.Array, lanes: int) -> np.ndarray:
    return np.array([np.frombuffer(x, "<u2") for x in column.to_pylist()], np.uint16).reshape(-1, lanes)


def sketches(docs: DataFrame, id_column: str, text_column: str, width: int, lanes: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set; null if empty), sketch."""

    def run(batches):
        for batch in pieces(batches):
            sizes, keys, sketch = [], [], []
            for text in utf8(batch.column(1)):
                hashes = shingle_hashes(text, width)
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                sketch.append(signature(hashes, lanes).astype("<u2").tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            lanes = _lanes(batch.column(1), bands * rows)
            parts = np.zeros((len(lanes), bands), np.uint64)
            for i in range(rows):
                parts = _mixed(parts * np.uint64(0xD6E8FEB86659FD93) + lanes[:, i::rows][:, :bands] + np.uint64(1))
            parts = _mixed(parts + np.arange(bands, dtype=np.uint64) * np.uint64(_BASE))
            yield pa.RecordBatch.from_arrays([pa.array(parts.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["bucket", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "bucket long, node long")


def _pruned(pairs: DataFrame, sketched: DataFrame, lanes: int, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) whose signatures pass the sequential test."""
    left = sketched.select(F.col("node").alias("a"), F.col("sketch").alias("left"))
    right = sketched.select(F.col("node").alias("b"), F.col("sketch").alias("right"))

    def run(batches):
        for batch in pieces(batches):
            keep = pa.array(surviving(_lanes(batch.column(2), lanes), _lanes(batch.column(3), lanes), threshold, miss))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs with ``threshold[1]`` * intersection >= ``threshold[0]`` * union on the full sets."""
    part, whole = threshold

    def run(batches):
        last, kept = None, set()
        for batch in pieces(batches):
            a, b, hold = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (left, right) in enumerate(zip(utf8(batch.column(2)), utf8(batch.column(3)))):
                if right != last:  # runs of one pivot follow each other
                    last, kept = right, shingles(right, width)
                own = shingles(left, width)
                common = len(own & kept)
                if common and whole * common >= part * (len(own) + len(kept) - common):
                    hold.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in hold], pa.int64()), pa.array([b[i] for i in hold], pa.int64())], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows that follow each other with the same first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:]):
            key = tuple(keys[begin].tolist())
            if now is not None and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _across(crowded: DataFrame, sketched: DataFrame, texts: DataFrame, labels: DataFrame, width: int, lanes: int, threshold: tuple[int, int], miss: float) -> DataFrame:
    """Verified links (a, b) between a bucket's nodes that are in different components.

    Buckets with the same nodes are handled once. Nodes outside a bucket's largest component meet all its nodes in
    blocks of at most about ``BLOCK`` by ``BLOCK``; signatures and full sets are compared where the block is, and only
    links that join two components there leave it, so the rows made grow with the nodes, not with their pairs.
    """
    part, whole = threshold
    content = crowded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    once = content.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    member = crowded.join(once, "bucket", "left_semi").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = member.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "component"))
    open_ = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), largest["component"].alias("main"), largest["n"].alias("inside"), F.count("*").alias("k")).where("k > 1")
    blocks, visitors = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int")
    placed = member.join(open_.select("bucket", "main", blocks.alias("blocks"), visitors.alias("visitors")), "bucket")
    own = lambda many: F.pmod(F.xxhash64("node"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    home = placed.select("bucket", own("blocks").alias("i"), every("visitors").alias("j"), F.lit(False).alias("visits"), "node", "component")
    visit = placed.where("component != main").select("bucket", every("blocks").alias("i"), own("visitors").alias("j"), F.lit(True).alias("visits"), "node", "component")
    full = home.unionByName(visit).join(sketched.select("node", "sketch"), "node").join(texts.select("node", "text"), "node").select("bucket", "i", "j", "visits", "node", "component", "sketch", "text")

    def run(batches):
        for group in _runs(batches, 3):
            visits, node, component = group.column(3).to_numpy(), group.column(4).to_numpy(), group.column(5).to_numpy().copy()
            sketch, text = _lanes(group.column(6), lanes), utf8(group.column(7))
            first, second = np.flatnonzero(visits), np.flatnonzero(~visits)
            sets: dict[int, set[bytes]] = {}
            found = []
            for x in first.tolist():
                others = second[component[second] != component[x]]
                if not len(others):
                    continue
                for y in others[surviving(np.broadcast_to(sketch[x], (len(others), lanes)), sketch[others], threshold[0] / threshold[1], miss)].tolist():
                    if component[x] == component[y]:
                        continue
                    for z in (x, y):
                        if z not in sets:
                            sets[z] = shingles(text[z], width)
                    common = len(sets[x] & sets[y])
                    if whole * common >= part * (len(sets[x]) + len(sets[y]) - common):
                        found.append((node[x], node[y]))
                        component[component == component[y]] = component[x]
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    clustered = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return clustered.mapInArrow(run, "a long, b long").distinct()


def _one_document(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of different sets that rows of one id have."""
    keys = full.select("doc_id", "set_key").distinct()
    several = keys.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    named = keys.join(several, "doc_id", "left_semi").join(classes, "set_key").select("doc_id", "node")
    least = named.groupBy("doc_id").agg(F.min("node").alias("low"))
    return named.join(least, "doc_id").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text", bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), kept (doc_id is its component's)."""
    lanes, least = bands * rows, threshold[0] / threshold[1]
    found = stored(sketches(docs, id_column, text_column, width, lanes), "sketches")
    full = found.where("set_key is not null and doc_id is not null")
    classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    nodes = full.join(classes.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "sketch")
    placed = _buckets(nodes, bands, rows)
    heads = placed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot != last").select("bucket", "pivot")
    crowded = stored(placed.join(heads, "bucket").select("bucket", "pivot", "node"), "crowded")
    near = crowded.select("node").distinct()
    sketched = stored(found.join(near, F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "sketch"), "near-sketches")
    texts = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).alias("text"))
    star = crowded.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    star = stored(_pruned(star, sketched, lanes, least, miss), "star")
    texts = stored(texts.join(near, "node", "left_semi"), "near-texts")
    links = stored(_verified(star, texts, width, threshold).unionByName(_one_document(full, classes)), "links")
    labels = components(links)
    more = stored(_across(crowded.select("bucket", "node"), sketched, texts, labels, width, lanes, threshold, miss), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = classes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    mine = found.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    return mine.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row of each group, with all its columns.

    Of the rows of a kept id, one stays for each text they have (the least by its columns as JSON); so does one for
    each text among the rows without an id, unless a document with an id has the same text. Rows of one id with
    different texts are one document, and all of that document stays.
    """
    gone = stored(near_duplicates(docs, id_column=id_column, text_column=text_column, **options).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    id_, digest = F.col(f"r.`{id_column}`"), F.sha2(F.coalesce(F.col(f"r.`{text_column}`").cast("string"), F.lit("")), 256)
    keyed = docs.select(F.struct("*").alias("r")).select("r", id_.cast("long").alias("id"), digest.alias("h"))
    narrow = stored(keyed.select("id", "h").join(gone, F.col("id") == F.col("gone"), "left_anti"), "kept-keys")
    twice = stored(narrow.groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(F.count("*").alias("n")).where("n > 1").select("id2", "h2"), "repeated-rows")
    nameless = narrow.where("id is null").select(F.col("h").alias("h3")).distinct()
    known = stored(nameless.join(narrow.where("id is not null").select("h"), F.col("h") == F.col("h3"), "left_semi"), "known-texts")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    rows = keyed.join(gone, F.col("id") == F.col("gone"), "left_anti").join(known, F.col("id").isNull() & (F.col("h") == F.col("h3")), "left_anti")
    # only rows that repeat are brought together
    several = rows.join(twice, same, "left_semi").groupBy("id", "h").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r")
    return rows.join(twice, same, "left_anti").select("r").unionByName(several).select(*(F.col(f"r.`{c}`") for c in docs.columns))
