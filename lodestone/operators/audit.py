"""Audit tables: reasons, queues, packs, failure classes, gates. Status columns are literals; nothing is imputed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(rules: Mapping[str, Column]) -> Column:
    """The labels whose condition holds, in rule order (a null condition doesn't hold)."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


def gap_queue(df: DataFrame, rules: Mapping[str, Column], id_column: str) -> DataFrame:
    found = df.withColumn("codes", reasons(rules)).where(F.size("codes") > 0)
    return found.select(id_column, F.array_join("codes", ",").alias("gap_reason_codes"), F.lit("review_required").alias("review_status"), F.lit("blocked").alias("release_status"))


def blocked(df: DataFrame, rules: Mapping[str, Column], *keep: str) -> DataFrame:
    """keep..., blockers, review_status: every row with its blockers."""
    found = df.withColumn("codes", reasons(rules))
    state = F.when(F.size("codes") > 0, "blocked_pending_formalization").otherwise("eligible_for_independent_review")
    return found.select(*keep, F.array_join("codes", ",").alias("replacement_blockers"), state.alias("review_status"))


def review_queue(df: DataFrame, pending: Column) -> DataFrame:
    """Rows for people, with their fields still empty."""
    return df.where(pending).withColumns({"reviewer_decision": F.lit(None).cast("string"), "review_status": F.lit("unreviewed")})


# The names of stages and classes.


def error_stage(in_catalogue: Column, in_gate: Column, in_top: Column) -> Column:
    return F.when(~in_catalogue, "no_exact").when(~in_gate, "excluded_by_gate").when(~in_top, "reranked_out").otherwise("survives")


def failure_category(top_hit: Column, any_hit: Column) -> Column:
    return F.when(top_hit, "proxy_top1_exact").when(any_hit, "proxy_ranker_miss_exact_in_top10").otherwise("proxy_identity_or_catalog_coverage_miss")


def samples(df: DataFrame, category: str, order: str, n: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return df.withColumn("sample_no", rank).where(F.col("sample_no") <= n)


def evidence_packs(candidates: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One pack a candidate; two blockers always hold, as no machine result is promoted."""
    always = {"human_adjudication_required": F.lit(True), "independent_cross_source_validation_missing": F.lit(True)}
    codes = reasons({**always, **rules})
    pack = F.concat_ws("-", F.lit("EP"), F.col("query_id").cast("string"), F.col("item_id").cast("string"))
    return candidates.withColumns({"evidence_pack_id": pack, "blockers": F.array_join(codes, ","), "pack_status": F.lit("blocked"), "promotion_status": F.lit("blocked")})


def gates(metrics: DataFrame) -> DataFrame:
    """From rows (gate, passed): each gate, and whether all hold."""
    return metrics.unionByName(metrics.groupBy().agg(F.lit("all").alias("gate"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")))


def histogram(df: DataFrame, column: Column, name: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit("<missing>")).alias(name)).agg(F.count("*").alias("n"))


def sliced_summary(df: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """Overall (null) and by slice in one pass, by grouping sets."""
    return df.rollup(by).agg(F.grouping(by).cast("long").alias("overall"), *aggregates)


def abstentions(df: DataFrame, partial: Column, reason: str, *keep: str) -> DataFrame:
    """Records that are left out of retrieval, with why."""
    return df.where(partial).select(*keep, F.lit(reason).alias("abstention_reason"), F.lit("abstained").alias("retrieval_status"), F.lit("blocked").alias("promotion_status"))


def union_pool(*pools: DataFrame) -> DataFrame:
    """query_id, item_id, pools: ordered union without repeats; ``pools`` says which (from 0) hold the pair."""
    parts = [p.select("query_id", "item_id", F.lit(i).alias("p")) for i, p in enumerate(pools)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "item_id").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("pools"))


def lanes_manifest(df: DataFrame, lanes: Mapping[str, Column]) -> DataFrame:
    """One row: the number of records, and of those in each lane (lanes may overlap)."""
    return df.agg(F.count("*").alias("records"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in lanes.items()))


def exclusions(df: DataFrame, id_column: str, rules: Mapping[str, Column]) -> DataFrame:
    """excluded_id, reason, scope: a row for each rule that keeps a record out."""
    found = df.select(F.col(id_column).alias("excluded_id"), F.explode(reasons(rules)).alias("reason"))
    return found.withColumn("scope", F.lit("excluded"))


def replacement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row of overlap counts between two sets of records (title, hash; null hashes match nothing) and the decision.

    The decision is a constant: overlap never lets one set replace the other.
    """
    shared = lambda c, n: left.select(c).where(F.col(c).isNotNull()).intersect(right.select(c)).agg(F.count("*").alias(n))
    held = lambda a, b, n: a.join(b.select("title").distinct(), "title", "left_semi").agg(F.count("*").alias(n))
    one = shared("title", "shared_titles").crossJoin(shared("hash", "shared_hashes"))  # one row each
    one = one.crossJoin(held(left, right, "left_records")).crossJoin(held(right, left, "right_records"))
    return one.withColumn("decision", F.lit("do_not_replace"))


def in_global_order(df: DataFrame, *by: str, name: str) -> DataFrame:
    """The rows in one order over all partitions, with their number from 1 in column ``name``.

    A range partition and a sort in each give the order; numbers follow from the partitions' sizes, so no task gets all rows.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = sizes.select(F.col("_part"), "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    numbered = placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") - F.col("_first") + 1)
    return numbered.select(*df.columns, name)


def scope(checks: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """check_name, passed: one aggregate over a dataset for each check."""
    out = None
    for name, (df, condition) in checks.items():
        one = df.agg(condition.alias("passed")).select(F.lit(name).alias("check_name"), F.coalesce("passed", F.lit(True)).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
