"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hashed order, are cut into blocks. With weight w, its i-th block (from 1) is released at
floor((i - 1) / w) and due at ceil(i / w). In every slot the released block with the earliest deadline is placed.
With weights that sum to 1 every block meets its deadline, so at any time a source is less than one block away from
its share. Weights are whole parts of one period, and the schedule repeats with it: only one period is simulated.

No document is dropped or repeated: when a source has run out, the others go on with their weights scaled up (the
next phase, from its own time 0). There are at most as many phases as sources, and every phase keeps the bound.

The schedule is made on the driver from one number a source, of at most ``MOST_SOURCES``; what it says is broadcast up
to ``BROADCAST_ROWS`` rows and joined by shuffle beyond.

Defined results: a null source is a source of its own; repeated rows are documents of their own; a source without a
weight in ``weights`` is an error; an empty table gives an empty result; the input's columns stay inside ``row``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 64
PERIOD = 1_000
MOST_SOURCES = 5_000
BUCKET_ROWS = 2_000
BROADCAST_ROWS = 500_000


def tempered(counts: Mapping[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Target weights in proportion to a power of the sources' row counts."""
    total = sum(n**power for n in counts.values())
    return {s: n**power / total for s, n in counts.items()}


def parts(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole parts of a period, at least one each, nearest to the weights."""
    period = max(period, 10 * len(weights))
    total = sum(weights.values())
    return {s: max(1, round(period * w / total)) for s, w in weights.items()}


def one_period(shares: Mapping[str | None, int], left: Mapping[str | None, int] | None = None) -> list[tuple[str | None, int, int, int]]:
    """(source, block in the period from 1, release, deadline) of each slot of a period; ties go to the larger share.

    With ``left``, blocks that each source still has, it ends with the first source's last block if that comes earlier.
    """
    period = sum(shares.values())
    name = lambda s: ("", 0) if s is None else (s, 1)
    waiting = [(0, -q, name(s), s, 1) for s, q in shares.items()]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, minus, key, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * period // shares[s]), minus, key, s, i, release))
        deadline, minus, key, s, i, release = heapq.heappop(ready)
        out.append((s, i, release, deadline))
        if left and i == left[s]:
            break
        if i < shares[s]:
            heapq.heappush(waiting, (i * period // shares[s], minus, key, s, i + 1))
    return out


def phases(blocks: Mapping[str | None, int], shares: Mapping[str | None, int]) -> tuple[list[tuple], list[tuple]]:
    """The schedule of all blocks in few rows.

    No phase lists more slots than it uses, so there are never more than blocks. First list: (phase, source, first block, blocks, start slot, period, share). Second: (phase, source, block in the
    period from 0, slot in the period, release, deadline).
    """
    left, done, start, phase = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, 0
    spans, slots = [], []
    while left:
        own = {s: shares[s] for s in left}
        period = sum(own.values())
        table = one_period(own, left)
        length = len(table)
        if length == period:
            at = {(s, i): slot for slot, (s, i, _, _) in enumerate(table)}
            # the slot in which a source places its last block
            length = 1 + min(((n - 1) // own[s]) * period + at[s, (n - 1) % own[s] + 1] for s, n in left.items())
        whole, rest = divmod(length, period)
        used = {s: whole * q for s, q in own.items()}
        for s, _, _, _ in table[:rest]:
            used[s] += 1
        spans += [(phase, s, done[s], n, start, period, own[s]) for s, n in used.items() if n]
        slots += [(phase, s, i - 1, slot, release, deadline) for slot, (s, i, release, deadline) in enumerate(table) if slot < length]
        for s, n in used.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start, phase = start + length, phase + 1
    return spans, slots


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source_column: str = "source", id_column: str = "doc_id", block: int = BLOCK, period: int = PERIOD, power: float = 0.5) -> DataFrame:
    """row, source, weight, block, phase, release, deadline, slot (in blocks from 0), position (slot, then place in the block)."""
    spark = docs.sparkSession
    sized = docs.groupBy(F.col(source_column).alias("s")).agg(F.count("*").alias("n"))
    counted = sized.limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = {r["s"]: r["n"] for r in counted}
    weights = tempered(counts, power) if weights is None else weights
    shares = parts({s: weights[s] for s in counts}, period) if counts else {}
    spans, slots = phases({s: math.ceil(n / block) for s, n in counts.items()}, shares)
    n_spans, n_slots = len(spans), len(slots)
    spans = spark.createDataFrame(spans, "phase int, s string, first long, n long, start long, period long, share long")
    slots = spark.createDataFrame(slots, "phase int, s string, j long, at long, release long, deadline long")
    small = lambda df, rows_: F.broadcast(df) if rows_ <= BROADCAST_ROWS else df
    spans, slots = small(spans, n_spans), small(slots, n_slots)
    buckets = max(1, math.ceil(sum(counts.values()) / BUCKET_ROWS))
    key = F.xxhash64(F.col(id_column).cast("string"))
    bucket = F.floor((F.shiftrightunsigned(key, 1) / F.lit(float(2**63))) * buckets)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_column).cast("string").alias("s"), key.alias("key"), F.least(bucket, F.lit(buckets - 1)).alias("bucket"))
    sizes = stored(rows.groupBy("s", "bucket").agg(F.count("*").alias("size")), "bucket-sizes")
    before = sizes.select(F.col("s").alias("s2"), F.col("bucket").alias("bucket2"), (F.sum("size").over(Window.partitionBy("s").orderBy("bucket")) - F.col("size")).alias("before"))
    hashed = [F.to_json(F.struct(f"row.`{f.name}`")) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"row.`{f.name}`") for f in docs.schema]
    inside = F.row_number().over(Window.partitionBy("s", "bucket").orderBy("key", F.xxhash64(*hashed))) - 1
    ranked = rows.withColumn("inside", inside).join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("bucket2"))).withColumn("rank", F.col("before") + F.col("inside"))
    placed = ranked.select("row", "s", F.floor(F.col("rank") / block).cast("long").alias("block"), (F.col("rank") % block).alias("place"))
    p = spans.alias("p")
    found = placed.alias("d").join(p, F.col("d.s").eqNullSafe(F.col("p.s")) & (F.col("d.block") >= F.col("p.first")) & (F.col("d.block") < F.col("p.first") + F.col("p.n")))
    i = F.col("d.block") - F.col("p.first")
    found = found.select("row", F.col("d.s").alias("s"), "block", "place", "phase", "start", "period", "share", F.floor(i / F.col("share")).cast("long").alias("turn"), (i % F.col("share")).alias("j"))
    q = slots.alias("q")
    found = found.alias("d").join(q, (F.col("d.phase") == F.col("q.phase")) & F.col("d.s").eqNullSafe(F.col("q.s")) & (F.col("d.j") == F.col("q.j")))
    shift = F.col("start") + F.col("turn") * F.col("period")
    slot = shift + F.col("at")
    return found.select(
        "row", F.col("d.s").alias("source"), (F.col("share") / F.col("period")).alias("weight"), "block", F.col("d.phase").alias("phase"),
        (shift + F.col("release")).alias("release"), (shift + F.col("deadline")).alias("deadline"), slot.alias("slot"), (slot * block + F.col("place")).alias("position"),
    )


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The input's columns, rows in the order of the mix (files and rows within them)."""
    mixed = mix(docs, **options)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def numbered(docs: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a table that ``in_order`` was written to, with their number from 0 in the order of the mix.

    ``docs`` is read from Parquet files; a row's number is its place in its file after all rows of the files before,
    so it doesn't depend on the order in which files are read.
    """
    placed = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_path").agg(F.count("*").alias("_rows"))
    before = files.select("_path", (F.sum("_rows").over(Window.orderBy("_path")) - F.col("_rows")).alias("_before"))  # a row a file
    return placed.join(F.broadcast(stored(before, "file-starts")), "_path").select(*(F.col(f"`{c}`") for c in docs.columns), (F.col("_before") + F.col("_row")).alias(name))
