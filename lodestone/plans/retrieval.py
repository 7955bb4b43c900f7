"""Retrieval queries: documents look for their benchmark items; vectors look for the mean vectors of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import audit, coverage, identity, index, rank, scores
from lodestone.sources.io import table

from . import sql as S
from .registry import query

K = 10
Q2, P2 = S.postings("documents", "doc_id", "text", 2), S.postings("benchmark", "item_id", "text", 2)
Q24, P24 = S.postings("documents", "doc_id", "text", 2, 4, whole=False), S.postings("benchmark", "item_id", "text", 2, 4, whole=False)
ITEMS = "select count(*) from benchmark"
BM25, TFIDF = S.bm25(Q2, P2, ITEMS), S.tfidf(Q24, P24, ITEMS)
#: A document holds an item if its key holds the item's key.
HIT = f"contains(dk, ik)"


def filled(pairs: str) -> str:
    return f"(select query_id, item_id, max(score) as score from (select query_id, item_id, score from {pairs} union all select doc_id, item_id, 0.0::double from documents, (select item_id from benchmark order by item_id limit {2 * K})) group by all)"


BM25_TOP, TFIDF_TOP = S.ranked(filled(BM25), K), S.ranked(filled(TFIDF), K)
KEYS = f"(select doc_id as query_id, {S.key('text')} as dk from documents)"
ITEM_KEYS = f"(select item_id, {S.key('text')} as ik from benchmark)"


def best_pairs(spark: SparkSession, d: str, orders, text: Column | None = None, **how) -> DataFrame:
    """query_id, item_id, tfidf, bm25, identity of each document's best pairs by the given orders."""
    text = F.col("text") if text is None else text
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text").repartition("query_id")  # even tasks, however few files there are
    items = table(spark, d, "benchmark").select("item_id", T.norm_key(text).alias("key"))
    return scores.best_pairs(docs.select("query_id", T.norm_key(text).alias("key")), items, orders, **how)


def _place(column: str) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(column), "item_id")).cast("long")


def lexical_ranks(spark, d, **how):
    """method, query_id, item_id, rank, hit of both methods' ten best; hit, with ``holds``: the document holds the whole item."""
    best = best_pairs(spark, d, [(scores.by_tfidf, K), (scores.by_bm25, K)], fill=True, **how).withColumns({n: _place(n) for n in ("tfidf", "bm25")})
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col(n).alias("rank")) for n in ("bm25", "tfidf")))).alias("m")
    return best.select("query_id", "item_id", (F.col("identity") == 1).alias("hit"), each).select("m.method", "query_id", "item_id", "m.rank", "hit").where(F.col("rank") <= K)


@query(f"select k as gram, df from (select gram as k, count(*) as df from {Q2} group by gram)")
def char_bigram_df(spark, d):
    return index.gram_counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"), 2, once=True).withColumnRenamed("n", "df")


@query(f"with p as (select * from {Q2}) select (select count(*) from documents) as n, round(sum(tf)::double / (select count(*) from documents), 9) as mean_length, count(distinct gram) as grams from p")
def corpus_stats(spark, d):
    docs = table(spark, d, "documents")
    return index.corpus_stats(docs, index.gram_counts(docs.select("doc_id", "text"), "doc_id", F.col("text"), 2)).withColumn("mean_length", F.round("mean_length", 9))


@query(f"select query_id, item_id, rank, score from {BM25_TOP}")
def bm25_top10(spark, d):
    best = best_pairs(spark, d, [(scores.by_bm25, K)], methods=["bm25"], fill=True)
    return rank.top_k(best.select("query_id", "item_id", F.col("bm25").alias("score")), K)


@query(f"select query_id, item_id, rank, score from {TFIDF_TOP}")
def tfidf_top10(spark, d):
    best = best_pairs(spark, d, [(scores.by_tfidf, K)], methods=["tfidf"], fill=True)
    return rank.top_k(best.select("query_id", "item_id", F.col("tfidf").alias("score")), K)


HEAD, TAIL = r"regexp_extract(text, '^[^.!?。！？]*')", r"regexp_replace(text, '^[^.!?。！？]*', '')"


@query(" union all ".join(f"select '{n}' as field, query_id, item_id, rank, score from {S.ranked(S.tfidf(S.postings('documents', 'doc_id', e, 2, 4, whole=False), S.postings('benchmark', 'item_id', e, 2, 4, whole=False), ITEMS), 3)}" for n, e in (("opening", HEAD), ("rest", TAIL))))
def tfidf_field_scores(spark, d):
    out = None
    for name, text in (("opening", F.regexp_extract("text", "^[^.!?。！？]*", 0)), ("rest", F.regexp_replace("text", "^[^.!?。！？]*", ""))):
        pairs = best_pairs(spark, d, [(scores.by_tfidf, 3)], text, methods=["tfidf"]).select("query_id", "item_id", F.col("tfidf").alias("score"))
        part = rank.top_k(pairs, 3).select(F.lit(name).alias("field"), "query_id", "item_id", "rank", F.col("score"))
        out = part if out is None else out.unionByName(part)
    return out



FEATURES = S.postings("(select item_id as id, text from benchmark union all select 1000000 + conv_id * 1000 + turn, text from conversations)", "id", "text", 2, 5, whole=False, normalise=False)


@query(f"select gram, sum(tf)::bigint as tf, row_number() over (order by sum(tf) desc, gram) as feature_rank from {FEATURES} group by gram order by tf desc, gram limit 100000")
def tfidf_max_features(spark, d):
    both = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text").unionByName(table(spark, d, "conversations").select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    return index.most_used(index.gram_counts(both, "id", F.col("text"), 2, 5, False, normalise=False).withColumnRenamed("n", "tf"), 100_000)


METHODS = f"""(select 'bm25' as method, query_id, item_id, rank from {BM25_TOP} union all select 'tfidf', query_id, item_id, rank from {TFIDF_TOP})"""


@query(f"with r as (select m.*, {HIT} as hit from {METHODS} m join {KEYS} using (query_id) join {ITEM_KEYS} using (item_id)), p as (select method, query_id, max(case when rank = 1 and hit then 1 else 0 end) as one, max(case when hit then 1 else 0 end) as ten from r group by all) select method, (select count(*) from documents) as queries, count(*) as nonempty_top10, sum(one)::bigint as top1_hits, sum(ten)::bigint as top10_hits from p group by method")
def method_metrics(spark, d):
    return rank.method_metrics(lexical_ranks(spark, d, holds=True), table(spark, d, "documents").select(F.col("doc_id").alias("query_id")))


HELD = f"(select query_id, item_id, 1.0::double as score from {KEYS}, {ITEM_KEYS} where {HIT})"
SCALE = lambda c: f"case when max({c}) over (partition by query_id) > 0 then {c} / max({c}) over (partition by query_id) else 0 end"
PARTS = f"(select query_id, item_id, coalesce(max(score) filter (component = 'identity'), 0) as identity, coalesce(max(score) filter (component = 'tfidf'), 0) as tfidf, coalesce(max(score) filter (component = 'bm25'), 0) as bm25 from (select 'identity' as component, * from {HELD} union all select 'tfidf', * from {TFIDF} union all select 'bm25', * from {BM25}) group by all)"
SCALED = f"(select query_id, item_id, identity, {SCALE('tfidf')} as tfidf, {SCALE('bm25')} as bm25 from {PARTS})"
HYBRID = f"(select *, round(0.2::double * identity + 0.5::double * tfidf + 0.3::double * bm25, 9) as score from {SCALED})"
WEIGHTS = {"identity": 0.2, "tfidf": 0.5, "bm25": 0.3}


def scaled_components(spark, d, orders):
    """query_id, item_id, identity, tfidf, bm25, scaled by a query's largest, of its best pairs by the given orders."""
    best = best_pairs(spark, d, [*orders, (scores.by_tfidf, 1), (scores.by_bm25, 1)], holds=True)  # each query's largest score is among them
    parts = best.select("query_id", "item_id", "identity", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tfidf", "bm25")))
    return parts.select("query_id", "item_id", "identity", rank.scaled("tfidf").alias("tfidf"), rank.scaled("bm25").alias("bm25"))


BY_HYBRID = scores.by_weights(WEIGHTS)


def hybrid(spark, d, orders=((BY_HYBRID, K),)):
    return scaled_components(spark, d, orders).withColumn("score", rank.weighted(WEIGHTS))


@query(f"select query_id, item_id, rank, round(identity, 9) as identity, round(tfidf, 9) as tfidf, round(bm25, 9) as bm25, score from {S.ranked(HYBRID, K)}")
def scaled_hybrid(spark, d):
    return rank.top_k(hybrid(spark, d), K).select("query_id", "item_id", "rank", *(F.round(c, 9).alias(c) for c in ("identity", "tfidf", "bm25", "score")))


ABLATION = {"identity": "identity", "tfidf": "tfidf", "bm25": "bm25", "both": "round(0.6::double * tfidf + 0.4::double * bm25, 9)", "hybrid": "score"}


@query(f"select method, query_id, item_id, round(score, 9) as top1_score from (select *, row_number() over (partition by method, query_id order by score desc, item_id) as rank from ({' union all '.join(f'select {chr(39)}{n}{chr(39)} as method, query_id, item_id, {e} as score from h' for n, e in ABLATION.items())})) where rank = 1".replace("from (select *, row", f"from (with h as (select * from {HYBRID}) select *, row", 1))
def hybrid_ablation(spark, d):
    kept = (scores.by_weights({"identity": 1.0}), scores.by_weights({"tfidf": 1.0}), scores.by_weights({"bm25": 1.0}), scores.by_weights({"tfidf": 0.6, "bm25": 0.4}), BY_HYBRID)
    h = hybrid(spark, d, [(f, 1) for f in kept])
    methods = {"identity": F.col("identity"), "tfidf": F.col("tfidf"), "bm25": F.col("bm25"), "both": F.round(0.6 * F.col("tfidf") + 0.4 * F.col("bm25"), 9), "hybrid": F.col("score")}
    long = rank.methods_long(h.select("query_id", "item_id", "identity", "tfidf", "bm25", F.col("score").alias("hybrid")), {**methods, "hybrid": F.col("hybrid")})
    return rank.top_k(long.select("method", "query_id", "item_id", "score"), 1, by=("method", "query_id")).select("method", "query_id", "item_id", F.round("score", 9).alias("top1_score"))


STATUS = "case when identity = 1 and not dup and score >= 0.55 then 'exact' when identity = 1 or lead < 0.05 or score >= 0.35 then 'ambiguous' else 'weak' end"
DUPLICATE = f"(select item_id, count(*) over (partition by {S.key('text')}) > 1 as dup from benchmark)"


@query(f"with r as (select * from {S.ranked(HYBRID, K)}), m as (select *, round(score - coalesce(lead(score) over (partition by query_id order by rank), 0), 9) as lead from r) select query_id, item_id, rank, {STATUS} as status, round(lead, 9) as margin from m join {DUPLICATE} using (item_id)")
def candidate_status(spark, d):
    dup = table(spark, d, "benchmark").select("item_id", (F.count("*").over(Window.partitionBy(T.norm_key(F.col("text")))) > 1).alias("dup"))
    r = rank.top_k(hybrid(spark, d), K).withColumn("lead", F.round(rank.margin("last_zero"), 9)).join(dup, "item_id")
    return r.select("query_id", "item_id", "rank", rank.status(F.col("identity") == 1, F.col("dup"), F.col("score"), F.col("lead")).alias("status"), F.round("lead", 9).alias("margin"))


@query(f"with r as (select * from {S.ranked(HYBRID, K)}) select query_id, item_id, rank, round(score - coalesce(lead(score) over w, 0), 9) as last_zero, round(score - coalesce(lead(score) over w, score), 9) as last_self, round(score - coalesce(nth_value(score, 2) over (partition by query_id order by rank rows between unbounded preceding and unbounded following), 0), 9) as fixed_second from r window w as (partition by query_id order by rank)")
def margin_modes(spark, d):
    r = rank.top_k(hybrid(spark, d), K)
    return r.select("query_id", "item_id", "rank", *(F.round(rank.margin(m), 9).alias(m) for m in ("last_zero", "last_self", "fixed_second")))


VECTORS = "(select label, i as position, avg(x::double) as value from (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings) group by all)"
MEANS = f"(select label, list(value order by position) as vector from {VECTORS} group by label)"
DENSE = f"(select m.label as query_id, e.vec_id as item_id, round(list_dot_product(m.vector::double[], e.embedding::double[]), 9) as score from {MEANS} m, embeddings e)"


def dense_label_pairs(spark, d):
    vectors = table(spark, d, "embeddings")
    means = index.packed_vector(index.mean_vector(vectors, "label", "embedding"), "label")
    return index.dense_pairs(means, vectors.select("vec_id", F.col("embedding").alias("vector")), "label", "vec_id")


@query(f"select query_id::bigint as query_id, item_id, rank, score from {S.ranked(DENSE, K)}")
def dense_topk(spark, d):
    return rank.top_k(dense_label_pairs(spark, d), K).select(F.col("query_id").cast("long").alias("query_id"), "item_id", "rank", F.col("score"))


@query(f"select label::bigint as label, position::bigint as position, round(value, 9) as value from {VECTORS}")
def dense_mean_pool(spark, d):
    return index.mean_vector(table(spark, d, "embeddings"), "label", "embedding").select(F.col("label").cast("long").alias("label"), F.col("position").cast("long").alias("position"), F.round("value", 9).alias("value"))


@query(f"select e.label::bigint as label, p.query_id::bigint as query_id, arg_min(item_id, item_id) filter (score = best) as best_item, round(max(best), 9) as best_score from (select *, max(score) over (partition by query_id, (select label from embeddings x where x.vec_id = item_id)) as best from {DENSE}) p join embeddings e on e.vec_id = p.item_id group by all")
def dense_argmax(spark, d):
    pairs = dense_label_pairs(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    best = F.max_by(F.struct("item_id", "score"), F.struct("score", F.negative("item_id")))
    return pairs.groupBy(F.col("label").cast("long").alias("label"), F.col("query_id").cast("long").alias("query_id")).agg(best.alias("b")).select("label", "query_id", F.col("b.item_id").alias("best_item"), F.round("b.score", 9).alias("best_score"))


GATE, OUT = 20, 10
UNIT = "(select vec_id, embedding::double[] as v from embeddings)"
GATED = f"(select t.query_id, t.item_id, t.score as lexical, coalesce(list_dot_product(a.v, b.v), 0) as dense from (select * from {S.ranked(TFIDF, GATE)}) t left join {UNIT} a on a.vec_id = t.query_id left join {UNIT} b on b.vec_id = t.item_id)"
GATED_HYBRID = f"(select *, round(0.5::double * {SCALE('lexical')} + 0.5::double * dense, 9) as score from {GATED})"


def gate(spark, d, **how):
    """query_id, item_id, lexical, dense, score of each query's GATE best, besides (with ``holds``) the items that it holds
    whole, which have identity 1 and no lexical score if they are outside."""
    vectors = table(spark, d, "embeddings")
    of = lambda n: vectors.select(F.col("vec_id").alias(n), F.col("embedding").alias(f"v_{n}"))
    best = best_pairs(spark, d, [(scores.by_tfidf, GATE)], methods=["tfidf"], **how).withColumn("place", _place("tfidf"))
    best = best.withColumn("lexical", F.when(F.col("place") <= GATE, F.col("tfidf"))).where("lexical is not null or identity = 1")
    catalogue = table(spark, d, "benchmark").select("item_id").distinct()
    few = catalogue.count() <= 20_000
    items = of("item_id").join(F.broadcast(catalogue) if few else catalogue, "item_id", "left_semi")
    both = best.select("query_id", "item_id", "lexical", "identity").join(of("query_id"), "query_id", "left").join(F.broadcast(items) if few else items, "item_id", "left")
    dense = F.coalesce(index.dot(F.col("v_query_id"), F.col("v_item_id")), F.lit(0.0))
    both = both.select("query_id", "item_id", "identity", "lexical", dense.alias("dense"))
    return both.withColumn("s", rank.scaled("lexical")).withColumn("score", F.when(F.col("lexical").isNotNull(), F.round(0.5 * F.col("s") + 0.5 * F.col("dense"), 9))).drop("s")


def gated(spark, d):
    return gate(spark, d).where(F.col("lexical").isNotNull()).drop("identity")


@query(f"select query_id, item_id, rank, lexical, round(dense, 9) as dense, score from {S.ranked(GATED_HYBRID, OUT)}")
def lexical_dense_hybrid_gate(spark, d):
    return rank.top_k(gated(spark, d), OUT).select("query_id", "item_id", "rank", *(F.round(c, 9).alias(c) for c in ("lexical", "dense", "score")))


TRUE_PAIRS = f"(select query_id, item_id from {KEYS}, {ITEM_KEYS} where contains(dk, ik))"
FLAGS = f"(select d.doc_id as query_id, exists (select 1 from {TRUE_PAIRS} t where t.query_id = d.doc_id) as in_catalogue, exists (select 1 from {TRUE_PAIRS} t join g using (query_id, item_id) where t.query_id = d.doc_id) as in_gate, exists (select 1 from {TRUE_PAIRS} t join o using (query_id, item_id) where t.query_id = d.doc_id) as in_top, exists (select 1 from {TRUE_PAIRS} t join o using (query_id, item_id) where t.query_id = d.doc_id and o.rank = 1) as at_top from documents d)"
STAGES = f"with g as (select query_id, item_id from {GATED}), o as (select * from {S.ranked(GATED_HYBRID, OUT)}), f as (select * from {FLAGS}) select query_id, case when not in_catalogue then 'no_exact' when not in_gate then 'excluded_by_gate' when not in_top then 'reranked_out' else 'survives' end as stage, case when at_top then 'proxy_top1_exact' when in_top then 'proxy_ranker_miss_exact_in_top10' else 'proxy_identity_or_catalog_coverage_miss' end as category from f"


@query(STAGES)
def error_stage(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"))
    pool = gate(spark, d, holds=True).withColumn("place", _place("score"))
    in_gate = F.col("lexical").isNotNull()
    per = pool.where("identity = 1").groupBy("query_id").agg(F.bool_or(in_gate).alias("in_gate"), F.bool_or(in_gate & (F.col("place") <= OUT)).alias("in_top"), F.bool_or(in_gate & (F.col("place") == 1)).alias("at_top"))
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = docs.select("query_id").join(per.withColumn("in_catalogue", F.lit(True)), "query_id", "left")
    return joined.select("query_id", audit.error_stage(off("in_catalogue"), off("in_gate"), off("in_top")).alias("stage"), audit.failure_category(off("at_top"), off("in_top")).alias("category"))


@query(f"select stage, category, count(*) as n from ({STAGES}) group by all")
def failure_localisation(spark, d):
    return error_stage(spark, d).groupBy("stage", "category").agg(F.count("*").alias("n"))


PACKS = f"(select 'EP-' || query_id || '-' || item_id as evidence_pack_id, query_id, item_id, rank, array_to_string(list_filter(['human_adjudication_required', 'independent_cross_source_validation_missing', case when score >= 0.35 then 'ambiguous_candidate_requires_review' end, case when dense = 0 then 'dense_evidence_missing' end], lambda x: x is not null), ',') as blockers, 'blocked' as pack_status, 'blocked' as promotion_status from {S.ranked(GATED_HYBRID, OUT)})"


@query(f"select * from {PACKS}")
def evidence_packs(spark, d):
    rules = {"ambiguous_candidate_requires_review": F.col("score") >= 0.35, "dense_evidence_missing": F.col("dense") == 0}
    return audit.evidence_packs(rank.top_k(gated(spark, d), OUT), rules).select("evidence_pack_id", "query_id", "item_id", "rank", "blockers", "pack_status", "promotion_status")


@query(f"select blocker, count(*) as n from (select unnest(string_split(blockers, ',')) as blocker from {PACKS}) group by blocker")
def blocker_counts(spark, d):
    return evidence_packs(spark, d).select(F.explode(F.split("blockers", ",")).alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


@query(f"select query_id, item_id, rank, score from {S.ranked(f'(select query_id, item_id, round(sum(1.0::double / (60 + rank)), 9) as score from {METHODS} group by all)', K)}")
def planned_rrf(spark, d):
    fused = rank.reciprocal_rank_fusion(lexical_ranks(spark, d).drop("hit"))
    return rank.top_k(fused, K)


POOLS = f"(select 'original' as pool, query_id, item_id, score from (select * from {S.ranked(TFIDF, 3)}) union all select distinct 'expanded', query_id, item_id, score from (select query_id, item_id, score from {S.ranked(TFIDF, 3)} union select t.query_id, t.item_id, t.score from {TFIDF} t join {S.ranked(BM25, 3)} b using (query_id, item_id)))"


@query(f"with r as (select p.*, {HIT} as hit, row_number() over (partition by pool, query_id order by score desc, item_id) as rank from {POOLS} p join {KEYS} using (query_id) join {ITEM_KEYS} using (item_id)), q as (select query_id, max(case when pool = 'original' and hit then 1 else 0 end) as o, max(case when pool = 'expanded' and hit then 1 else 0 end) as e, count(*) filter (pool = 'original') as n_original, count(*) filter (pool = 'expanded') as n_expanded from r group by query_id) select sum(o)::bigint as original_hits, sum(e)::bigint as expanded_hits, sum(case when e = 1 and o = 0 then 1 else 0 end)::bigint as recovered, sum(n_original)::bigint as original_pairs, sum(n_expanded)::bigint as expanded_pairs from q")
def pool_comparison(spark, d):
    best = best_pairs(spark, d, [(scores.by_tfidf, 3), (scores.by_bm25, 3)], holds=True).withColumns({"t": _place("tfidf"), "b": _place("bm25")}).where("tfidf is not null")
    first = F.col("t") <= 3
    pools = best.select("query_id", (F.col("identity") == 1).alias("hit"), first.alias("original"), (first | (F.col("b") <= 3) & F.col("bm25").isNotNull()).alias("expanded"))
    hit_in = lambda p: F.max((F.col(p) & F.col("hit")).cast("int"))
    per = pools.groupBy("query_id").agg(hit_in("original").alias("o"), hit_in("expanded").alias("e"), F.count_if("original").alias("n_original"), F.count_if("expanded").alias("n_expanded"))
    return per.agg(F.sum("o").alias("original_hits"), F.sum("e").alias("expanded_hits"), F.sum(F.when((F.col("e") == 1) & (F.col("o") == 0), 1).otherwise(0)).cast("long").alias("recovered"), F.sum("n_original").alias("original_pairs"), F.sum("n_expanded").alias("expanded_pairs"))


@query()
def title_similarity_top5(spark, d):
    names = table(spark, d, "part").select(T.norm_key(F.col("p_name")).alias("k")).where("k != ''").distinct()
    return identity.similar_titles(names.select(F.col("k").alias("left_key")), names.select(F.col("k").alias("right_key")))


BRIDGE = f"(select a.p_partkey as record_id, count(b.p_partkey) as n_exact from part a left join (select min(p_partkey) as p_partkey, p_brand, p_name from part group by p_brand, p_name) b on {S.key('a.p_name')} = {S.key('b.p_name')} group by 1)"


@query(f"select record_id, n_exact, case when n_exact = 1 then 'exact' when n_exact > 1 then 'ambiguous' else 'weak' end as status, case when n_exact = 1 then 'unique_exact_normalized_subject' when n_exact > 1 then 'exact_name_has_multiple_outline_variants' else 'no_unique_exact_or_strong_alias' end as reason from {BRIDGE}")
def identity_bridge_pool(spark, d):
    part = table(spark, d, "part")
    catalogue = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("item_id")).groupBy(T.norm_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"))
    joined = part.select(F.col("p_partkey").alias("record_id"), T.norm_key(F.col("p_name")).alias("key")).join(catalogue, "key", "left")
    n = F.coalesce("n", F.lit(0))
    status, reason = rank.bridge_status(n, F.lit(None).cast("double"))
    return joined.select("record_id", n.alias("n_exact"), status.alias("status"), reason.alias("reason"))


SENT = "(select item_id, i as sentence, s as text from (select item_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?。！？\\n]+'), lambda x: trim(x)), lambda x: x <> '')) as s, unnest(range(0, len(list_filter(list_transform(string_split_regex(text, '[.!?。！？\\n]+'), lambda x: trim(x)), lambda x: x <> '')))) as i from benchmark))"


def _sentences(spark, d):
    """Benchmark sentences (the items) of each candidate; chunks are the same candidate's conversation-free text pieces."""
    pieces = F.filter(F.transform(F.split("text", "[.!?。！？\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "benchmark").select("item_id", F.posexplode(pieces).alias("sentence", "text"))


SENT_ID = f"(select item_id * 10000 + sentence as sid, item_id, text from {SENT})"
SENT_POST = S.postings(SENT_ID, "sid", "text", 2)
SENT_PAIRS = f"(select * from {S.tfidf(SENT_POST, SENT_POST, f'select count(*) from {SENT}')} where query_id // 10000 <> item_id // 10000)"
COVER_BASE = f"(select a.item_id as record_id, b.item_id as candidate_id, a.n as n_chunks, b.n as n_items from (select item_id, count(*) as n from {SENT} group by 1) a join (select item_id, count(*) as n from {SENT} group by 1) b on a.item_id <> b.item_id)"
THETA = "(select unnest([0.30, 0.42, 0.55, 0.65])::double as threshold)"
COVERAGE = f"""(with s as (select query_id // 10000 as record_id, item_id // 10000 as candidate_id, query_id as chunk_id, item_id as sentence_id, score from {SENT_PAIRS}),
  i as (select record_id, candidate_id, threshold, count(*) filter (best >= threshold) as hit from (select record_id, candidate_id, sentence_id, max(score) as best from s group by all), {THETA} group by all),
  c as (select record_id, candidate_id, threshold, count(*) filter (best >= threshold) as hit from (select record_id, candidate_id, chunk_id, max(score) as best from s group by all), {THETA} group by all),
  b as (select b.record_id, b.candidate_id, threshold, round(coalesce(i.hit, 0)::double / n_items, 9) as syllabus_to_outline, round(coalesce(c.hit, 0)::double / n_chunks, 9) as outline_to_syllabus from (select * from {COVER_BASE}, {THETA}) b left join i using (record_id, candidate_id, threshold) left join c using (record_id, candidate_id, threshold))
  select *, ((round(syllabus_to_outline * 1000000)::bigint + round(outline_to_syllabus * 1000000)::bigint + 1) // 2) / 1000000.0::double as bidirectional from b)"""


def coverage_scores(spark, d):
    sid = (F.col("item_id") * 10000 + F.col("sentence")).cast("long")
    sentences = _sentences(spark, d).withColumn("sid", sid)
    posted = index.postings(sentences, "sid", F.col("text"), 2).persist()
    pairs = index.tfidf_pairs(posted, index.tfidf_weights(posted, sentences.count()).persist())
    own = lambda c: F.floor(F.col(c) / 10000).cast("long")
    return pairs.select(own("query_id").alias("record_id"), own("item_id").alias("candidate_id"), F.col("query_id").alias("chunk_id"), "item_id", "score").where("record_id <> candidate_id")


def coverage_by_threshold(spark, d):
    counts = _sentences(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    a = counts.select(F.col("item_id").alias("record_id"), F.col("n").alias("n_chunks"))
    b = counts.select(F.col("item_id").alias("candidate_id"), F.col("n").alias("n_items"))
    # the pool of candidates: every other benchmark item
    pool = a.join(F.broadcast(b) if b.count() <= 10_000 else b, F.col("record_id") != F.col("candidate_id"))
    return coverage.bidirectional(coverage.matrix(coverage_scores(spark, d)), pool)


@query(f"select record_id, candidate_id, threshold, syllabus_to_outline, outline_to_syllabus, bidirectional from {COVERAGE}")
def coverage_thresholds(spark, d):
    return coverage_by_threshold(spark, d)


TOPICS = f"(select record_id, candidate_id as item_id, c.bidirectional as coverage, coalesce(m.best, 0) as lexical from {COVERAGE} c left join (select query_id // 10000 as record_id, item_id // 10000 as candidate_id, max(score) as best from {SENT_PAIRS} group by all) m using (record_id, candidate_id) where threshold = 0.42::double)"


def _topics(spark, d):
    best = coverage_scores(spark, d).groupBy("record_id", "candidate_id").agg(F.max("score").alias("best"))
    joined = coverage_by_threshold(spark, d).where(F.col("threshold") == 0.42).join(best, ["record_id", "candidate_id"], "left")
    return joined.select("record_id", F.col("candidate_id").alias("item_id"), F.col("bidirectional").alias("coverage"), F.coalesce("best", F.lit(0.0)).alias("lexical"))


@query(f"select record_id, item_id, rank, coverage, lexical, score from {S.ranked(f'(select *, round(0.45::double * lexical + 0.55::double * coverage, 12) as score from {TOPICS})', K, 'record_id')}")
def coverage_rerank(spark, d):
    scored = _topics(spark, d).withColumn("score", coverage.rerank_score({"lexical": 0.45, "coverage": 0.55}))
    return rank.top_k(scored, K, by=("record_id",)).select("record_id", "item_id", "rank", "coverage", F.col("lexical"), F.col("score"))


CONFIGS = {n: (w[1] + w[2], w[3]) for n, w in coverage.WEIGHTS.items()}


@query(f"select config, record_id, item_id, score from (select *, row_number() over (partition by config, record_id order by score desc, item_id) as rank from (select c.config, record_id, item_id, round(c.a * lexical + c.b * coverage, 12) as score from {TOPICS}, (values {', '.join(f'({chr(39)}{n}{chr(39)}, {a}::double, {b}::double)' for n, (a, b) in CONFIGS.items())}) c(config, a, b))) where rank = 1")
def weight_ablation(spark, d):
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, (a, b) in CONFIGS.items()))).alias("c")
    scored = _topics(spark, d).select("*", each).select("c.config", "record_id", "item_id", F.round(F.col("c.a") * F.col("lexical") + F.col("c.b") * F.col("coverage"), 12).alias("score"))
    return rank.top_k(scored, 1, by=("config", "record_id")).select("config", "record_id", "item_id", F.col("score"))


@query(f"select config, query_id, item_id, score from (select *, row_number() over (partition by config, query_id order by hard desc, score desc, item_id) as rank from (select c.config, query_id, item_id, case when c.config = 'hard_exact' then identity else 0 end as hard, round(score + c.boost * identity, 9) as score from {HYBRID}, (values ('current', 0.0::double), ('boost_020', 0.2::double), ('boost_050', 0.5::double), ('hard_exact', 0.0::double)) c(config, boost))) where rank = 1")
def title_boost_variants(spark, d):
    boosts = {"current": 0.0, "boost_020": 0.2, "boost_050": 0.5, "hard_exact": 0.0}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.lit(b).alias("boost")) for n, b in boosts.items()))).alias("c")
    kept = [scores.by_weights(WEIGHTS, x) for x in (*boosts.values(), 10.0)]  # no score outweighs 10 for the exact title
    scored = hybrid(spark, d, [(f, 1) for f in kept]).select("*", each).select("c.config", "query_id", "item_id", F.when(F.col("c.config") == "hard_exact", F.col("identity")).otherwise(0.0).alias("hard"), F.round(F.col("score") + F.col("c.boost") * F.col("identity"), 9).alias("score"))
    first = F.row_number().over(Window.partitionBy("config", "query_id").orderBy(F.desc("hard"), F.desc("score"), "item_id"))
    return scored.withColumn("rank", first).where("rank = 1").select("config", "query_id", "item_id", F.col("score"))
