"""Ranking: top-k with full tie-breaks, scaling, margins, statuses, hybrids and their metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(pairs: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", tie: str = "item_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def fill_zero(pairs: DataFrame, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Add what a full score vector would still rank in the top k: the first items, with score 0.

    A query with fewer than k positive pairs takes its zero pairs from the first 2k items, so only those are added.
    """
    first = F.broadcast(items.select("item_id").distinct().orderBy("item_id").limit(2 * k))  # 2k rows
    zero = queries.select("query_id").distinct().join(first).select("query_id", "item_id", F.lit(0.0).alias("score"))
    return pairs.select("query_id", "item_id", "score").unionByName(zero).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))


def scaled(column: str, by: Sequence[str] = ("query_id",)) -> Column:
    """x / max over the partition, 0 where the maximum isn't positive."""
    most = F.max(column).over(Window.partitionBy(*by))
    return F.when(most > 0, F.col(column) / most).otherwise(0.0)


def margin(mode: str = "last_zero", score: str = "score", by: Sequence[str] = ("query_id",)) -> Column:
    """Lead over the next rank. The last row's next is 0 (last_zero), itself (last_self), or nothing (last_score);
    fixed_second compares every rank with rank 2."""
    w = Window.partitionBy(*by).orderBy("rank")
    if mode == "fixed_second":
        return F.col(score) - F.coalesce(F.nth_value(score, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    following = F.lead(score, 1).over(w)
    last = {"last_zero": F.lit(0.0), "last_self": F.col(score), "last_score": F.lit(0.0)}[mode]
    return F.col(score) - F.coalesce(following, last)


def status(exact: Column, duplicate: Column, score: Column, lead: Column) -> Column:
    return F.when(exact & ~duplicate & (score >= 0.55), "exact").when(exact | (lead < 0.05) | (score >= 0.35), "ambiguous").otherwise("weak")


def bridge_status(n_exact: Column, best_similarity: Column) -> tuple[Column, Column]:
    """(status, reason) of an identity bridge."""
    strong = F.coalesce(best_similarity >= 0.70, F.lit(False))
    state = F.when(n_exact == 1, "exact").when(n_exact > 1, "ambiguous").when(strong, "ambiguous").otherwise("weak")
    reason = (
        F.when(n_exact == 1, "unique_exact_normalized_subject").when(n_exact > 1, "exact_name_has_multiple_outline_variants")
        .when(strong, "strong_machine_alias_requires_review").otherwise("no_unique_exact_or_strong_alias")
    )
    return state, reason


def components(**scores: DataFrame) -> DataFrame:
    """query_id, item_id and one column a component; a missing pair has 0."""
    long = None
    for name, pairs in scores.items():
        part = pairs.select("query_id", "item_id", F.lit(name).alias("component"), "score")
        long = part if long is None else long.unionByName(part)
    picked = [F.coalesce(F.max(F.when(F.col("component") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in scores]
    return long.groupBy("query_id", "item_id").agg(*picked)


def weighted(weights: Mapping[str, float]) -> Column:
    total = None
    for name, w in weights.items():
        part = F.lit(float(w)) * F.col(name)
        total = part if total is None else total + part
    return F.round(total, 9)


def methods_long(wide: DataFrame, methods: Mapping[str, Column]) -> DataFrame:
    """query_id, item_id, method, score."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), c.alias("score")) for n, c in methods.items()))).alias("m")
    return wide.select("*", each).select(*wide.columns, "m.method", "m.score")


def method_metrics(ranked: DataFrame, queries: DataFrame, hit: str = "hit") -> DataFrame:
    """method, queries, nonempty_top10, top1_hits, top10_hits: counted once a query."""
    per = ranked.groupBy("method", "query_id").agg(F.max(F.when(F.col("rank") == 1, F.col(hit).cast("int")).otherwise(0)).alias("one"), F.max(F.col(hit).cast("int")).alias("ten"))
    n = queries.select("query_id").distinct().count()
    return per.groupBy("method").agg(F.count("*").alias("nonempty_top10"), F.sum("one").alias("top1_hits"), F.sum("ten").alias("top10_hits")).withColumn("queries", F.lit(n).cast("long"))


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60) -> DataFrame:
    return ranked.groupBy("query_id", "item_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))
