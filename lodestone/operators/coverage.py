"""Two-way topic coverage between the chunks of a record and the items of a candidate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(lexical: DataFrame, dense: DataFrame | None = None, lanes: DataFrame | None = None, mode: str = "all", weight: float = 0.25) -> DataFrame:
    """record_id, candidate_id, chunk_id, item_id, score: mean of both components, contamination down-weighted or dropped."""
    keys = ["record_id", "candidate_id", "chunk_id", "item_id"]
    found = lexical.select(*keys, F.col("score").alias("lexical"))
    if dense is not None:
        found = found.join(dense.select(*keys, F.col("score").alias("dense")), keys, "full")
        score = (F.coalesce("lexical", F.lit(0.0)) + F.coalesce("dense", F.lit(0.0))) / 2
    else:
        score = F.col("lexical")
    found = found.withColumn("score", score)
    if lanes is not None and mode != "all":
        found = found.join(lanes.select("record_id", "chunk_id", "lane"), ["record_id", "chunk_id"], "left")
        if mode == "content_only":
            found = found.where("lane = 'content'")
        else:
            found = found.withColumn("score", F.when(F.col("lane") == "contamination", F.col("score") * weight).otherwise(F.col("score")))
    return found.select(*keys, "score")


def bidirectional(scores: DataFrame, candidates: DataFrame, thresholds: Sequence[float] = (0.30, 0.42, 0.55, 0.65)) -> DataFrame:
    """record_id, candidate_id, threshold, syllabus_to_outline (share of items whose best chunk reaches it),
    outline_to_syllabus (share of chunks), bidirectional (mean of both, rounded before).

    ``candidates``: record_id, candidate_id, n_chunks, n_items; a side without rows gives zeros.
    """
    pair = ["record_id", "candidate_id"]
    each = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    items = scores.groupBy(*pair, "item_id").agg(F.max("score").alias("best")).select(*pair, "best", each)
    chunks = scores.groupBy(*pair, "chunk_id").agg(F.max("score").alias("best")).select(*pair, "best", each)
    reach = lambda df, name: df.groupBy(*pair, "threshold").agg(F.count_if(F.col("best") >= F.col("threshold")).alias(name))
    base = candidates.select(*pair, "n_chunks", "n_items", each)
    found = base.join(reach(items, "items_hit"), [*pair, "threshold"], "left").join(reach(chunks, "chunks_hit"), [*pair, "threshold"], "left")
    share = lambda hit, n: F.round(F.when((F.col("n_chunks") > 0) & (F.col("n_items") > 0), F.coalesce(hit, F.lit(0)) / F.col(n)).otherwise(0.0), 6)
    found = found.select(*pair, "threshold", share("items_hit", "n_items").alias("syllabus_to_outline"), share("chunks_hit", "n_chunks").alias("outline_to_syllabus"))
    millionths = lambda c: F.round(F.col(c) * 1_000_000).cast("long")  # noqa: E731  whole numbers, so that halves round up alike everywhere
    return found.withColumn("bidirectional", F.floor((millionths("syllabus_to_outline") + millionths("outline_to_syllabus") + 1) / 2) / 1_000_000.0)


def best_matches(scores: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """The k best chunk-item pairs at or over the threshold for each record and candidate."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("record_id", "candidate_id").orderBy(F.desc("score"), "chunk_id", "item_id"))
    return scores.where(F.col("score") >= threshold).withColumn("match_rank", rank.cast("long")).where(F.col("match_rank") <= k)


def rerank_score(weights: Mapping[str, float]):
    total = None
    for name, w in weights.items():
        part = F.lit(float(w)) * F.col(name)
        total = part if total is None else total + part
    return F.round(total, 12)


#: Weight vectors over (hybrid, lexical maximum, dense maximum, coverage).
WEIGHTS = {"current": (0.20, 0.25, 0.25, 0.30), "identity_removed": (0.0, 0.30, 0.30, 0.40), "coverage_heavy": (0.10, 0.20, 0.20, 0.50), "lexical_heavy": (0.15, 0.40, 0.30, 0.15), "dense_heavy": (0.15, 0.20, 0.45, 0.20)}
