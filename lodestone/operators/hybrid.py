"""Component scores into candidates: the section-aware hybrid, the chunk and dense hybrid, identity audits.

Every component is a frame (query_id, item_id, score) without the pairs that score 0; scaling divides by a query's
largest score, so absent pairs don't matter. Scaling comes before any gate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rank

# The published weights.
SECTION_WEIGHTS = {"identity": 0.30, "title_similarity": 0.20, "topic": 0.20, "bm25": 0.20, "remarks": 0.10}
TOPIC_WEIGHTS = {"core": 0.60, "outline": 0.40}
CONTENT_WEIGHTS = {"topic": 0.55, "bm25": 0.35, "remarks": 0.10}
DENSE_WEIGHTS = {"identity": 0.20, "lexical": 0.40, "dense": 0.40}
TYPE_BONUS, TITLE_BONUS = 0.05, 0.02


def section_hybrid(**scores: DataFrame) -> DataFrame:
    """query_id, item_id, the scaled components, and hybrid. Needs identity, title, core, outline, remarks and bm25."""
    raw = rank.components(**scores)
    of = {n: F.when(F.col("identity") > 0, 1.0).otherwise(0.0) if n == "identity" else F.least(rank.scaled(n), F.lit(1.0)) for n in scores}
    s = raw.select("query_id", "item_id", *(c.alias(n) for n, c in of.items()))
    s = s.withColumns({"title_similarity": F.greatest("title", "identity"), "topic": rank.weighted(TOPIC_WEIGHTS)})
    return s.withColumn("hybrid", rank.weighted(SECTION_WEIGHTS))


def section_methods(scored: DataFrame) -> DataFrame:
    """query_id, item_id, method, score: the four methods of the ablation."""
    methods = {"title_identity": F.col("identity"), "topic_only": F.col("topic"), "content_topic": rank.weighted(CONTENT_WEIGHTS), "hybrid": F.col("hybrid")}
    return rank.methods_long(scored, methods).select("query_id", "item_id", "method", "score")


def chunk_dense_hybrid(identity: DataFrame, course_lexical: DataFrame, chunk_lexical: DataFrame, course_dense: DataFrame, chunk_dense: DataFrame, gate: int = 50) -> DataFrame:
    """query_id, item_id, identity, lexical, dense, chunk_max, hybrid, evidence_chunk of each query's ``gate`` best by course score.

    The chunk frames have a chunk_no besides. The evidence is the chunk nearest to the item, the first one where several are.
    """
    pair = ["query_id", "item_id"]
    best = chunk_lexical.groupBy(*pair).agg(F.max("score").alias("score"))
    nearest = chunk_dense.groupBy(*pair).agg(F.max("score").alias("score"), F.max_by(F.col("chunk_no"), F.struct(F.col("score"), F.negative("chunk_no"))).alias("evidence_chunk"))
    raw = rank.components(identity=identity, course=course_lexical, chunk=best, mean=course_dense, near=nearest)
    one = raw.select(*pair, "identity", "chunk", *(rank.scaled(n).alias(f"s_{n}") for n in ("course", "chunk", "mean", "near")))
    two = one.select(*pair, "identity", "chunk", "s_course", (0.65 * F.col("s_course") + 0.35 * F.col("s_chunk")).alias("l"), (0.5 * F.col("s_mean") + 0.5 * F.col("s_near")).alias("d"))
    three = two.select(*pair, "identity", "chunk", F.round("s_course", 9).alias("s_course"), rank.scaled("l").alias("lexical"), rank.scaled("d").alias("dense"))
    gated = rank.top_k(three, gate, score="s_course").drop("rank")
    return gated.join(nearest.select(*pair, "evidence_chunk"), pair, "left").select(*pair, "identity", "lexical", "dense", F.col("chunk").alias("chunk_max"), "evidence_chunk", rank.weighted(DENSE_WEIGHTS).alias("hybrid"))


def advisory(score: Column, compatible: Column, exact: Column) -> Column:
    """A candidate's score with the small bonuses for a fitting type and an equal title."""
    return F.round(score + F.when(compatible, TYPE_BONUS).otherwise(0.0) + F.when(exact, TITLE_BONUS).otherwise(0.0), 8)


def top_margin(candidates: DataFrame, score: str = "score", by: str = "query_id", tie: str = "item_id") -> DataFrame:
    """by, top_item, top_score, top_margin: the lead of the best candidate over the second; its score where it is alone."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    led = candidates.withColumn("next", F.lead(score).over(w)).withColumn("n", F.row_number().over(w)).where("n = 1")
    return led.select(by, F.col(tie).alias("top_item"), F.col(score).alias("top_score"), F.round(F.coalesce(F.col(score) - F.col("next"), F.col(score)), 8).alias("top_margin"))


def identity_audit(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: its best candidate by advisory score, margin, status and reason.

    ``candidates``: query_id, item_id, score, exact, compatible, similarity, duplicate (the item's name is shared).
    Queries without candidates are weak.
    """
    scored = candidates.withColumn("advisory", advisory(F.col("score"), F.col("compatible"), F.col("exact")))
    exact = scored.groupBy("query_id").agg(F.count_if("exact").alias("n_exact"), F.coalesce(F.bool_or(F.col("exact") & F.col("duplicate")), F.lit(False)).alias("exact_shared"))
    top = top_margin(scored, "advisory").join(scored.select("query_id", F.col("item_id").alias("top_item"), "similarity", "duplicate", F.col("exact").alias("top_exact")), ["query_id", "top_item"])
    found = queries.select("query_id").join(top, "query_id", "left").join(exact, "query_id", "left")
    n = F.coalesce("n_exact", F.lit(0))
    close = F.coalesce((F.col("similarity") >= 0.7) & (F.col("top_margin") < 0.05), F.lit(False))
    status = F.when((n == 1) & ~F.col("exact_shared"), "exact").when((n > 0) | close | F.coalesce("duplicate", F.lit(False)), "ambiguous").otherwise("weak")
    # The reasons.
    reason = F.create_map(*map(F.lit, ("exact", "unique_exact_title_match", "ambiguous", "duplicate_variant_or_close_candidate_margin", "weak", "no_unique_exact_or_strong_alias_evidence")))[F.col("status")]
    out = found.withColumn("status", status)
    return out.select("query_id", "top_item", F.col("top_score").alias("advisory_score"), F.coalesce("top_margin", F.lit(0.0)).alias("top_margin"), "similarity", "top_exact", "status", reason.alias("reason"))


def alias_candidates(audited: DataFrame) -> DataFrame:
    """The best candidates whose title is another than the query's, for review."""
    rows = audited.where(F.col("top_item").isNotNull() & ~F.col("top_exact"))
    return rows.select("query_id", F.col("top_item").alias("item_id"), "similarity", "advisory_score", F.lit("machine_candidate_review_required").alias("alias_status"), F.lit("not_human_adjudicated").alias("human_review_status"))


def config_metrics(components: DataFrame, configs: Mapping[str, tuple[float, ...]], names: tuple[str, ...], exact: str = "exact") -> DataFrame:
    """config, queries, top1, top10: queries whose best, or one of the ten best, is exact under each weight vector."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.array(*(F.lit(float(x)) for x in w)).alias("w")) for n, w in configs.items()))).alias("c")
    total = None
    for i, name in enumerate(names):
        part = F.col("c.w")[i] * F.col(name)
        total = part if total is None else total + part
    scored = components.select("query_id", "item_id", F.col(exact).alias("exact"), each, *names).select("c.config", "query_id", "item_id", "exact", F.round(total, 9).alias("score"))
    best = rank.top_k(scored, 10, by=("config", "query_id"))
    per = best.groupBy("config", "query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("exact").cast("int")).otherwise(0)).alias("one"), F.max(F.col("exact").cast("int")).alias("ten"))
    return per.groupBy("config").agg(F.count("*").alias("queries"), F.sum("one").alias("top1"), F.sum("ten").alias("top10"))
