"""Queries over keys, presence, duplicates and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import audit, identity, profile
from lodestone.sources.io import contract, manifest, table, unify
from lodestone.streaming.lanes import event_windows

from . import sql as S
from .registry import query

FIELDS = ["lang", "source", "text", "quality", "toxic"]
MARKED = "(select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id))"
LONG = f"(select doc_id, source as grp, unnest([{{'f': 'lang', 'v': lang}}, {{'f': 'source', 'v': source}}, {{'f': 'text', 'v': text}}, {{'f': 'quality', 'v': quality::varchar}}, {{'f': 'toxic', 'v': toxic::varchar}}], recursive := true) from {MARKED})"
PRESENCE = f"""(select grp as source, f as field, count(*) filter (v is not null and v <> '') as present, count(*) filter (v is null or v = '') as empty, round((count(*) filter (v is not null and v <> ''))::double / count(*), 6) as rate,
  case when count(*) filter (v is not null and v <> '') = 0 then 'schema_absence_candidate' when count(*) filter (v is not null and v <> '') = count(*) then 'source_consistently_present' else 'source_heterogeneous_or_record_missing' end as availability from {LONG} group by all)"""
MISSING = f"""(select l.doc_id, l.grp as source, l.f as field, p.availability, case when len(c) = 0 then ['cause_unresolved'] else c end as causes from {LONG} l join {PRESENCE} p on p.source = l.grp and p.field = l.f join documents d using (doc_id),
  lateral (select list_sort(list_filter([case when p.availability = 'schema_absence_candidate' then 'structural_schema_candidate' end, case when p.availability = 'schema_absence_candidate' then 'other_causes_not_excluded' end,
    case when l.f in ('quality', 'toxic') then 'label_not_collected_or_unresolved' end, case when l.f = 'toxic' and d.lang <> 'en' then 'language_not_reviewed_or_unresolved' end], lambda x: x is not null)) as c) where l.v is null or l.v = '')"""
CLASSES = {"text": "content", "lang": "identity", "source": "provenance", "quality": "gate", "toxic": "gate"}


def marked(spark: SparkSession, d: str) -> DataFrame:
    """documents with their labels, one row a document."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


@query(f"select k.query_id, k.item_id, k.rank, 1.0::double as score from (select a.p_partkey as query_id, b.item_id, row_number() over (partition by a.p_partkey order by b.item_id) as rank from (select p_partkey, {S.key('p_name')} as key from part) a join (select min(p_partkey) as item_id, {S.key('max(p_name)')} as key from part group by p_brand, p_name) b on a.key = b.key and a.key <> '') k where rank <= 10")
def exact_title_match(spark, d):
    part = table(spark, d, "part")
    catalogue = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("item_id")).select("item_id", T.norm_key(F.col("p_name")).alias("key"))
    queries = part.select(F.col("p_partkey").alias("query_id"), "p_name").repartition("query_id")  # even tasks, however few files there are
    return identity.exact_matches(queries.select("query_id", T.norm_key(F.col("p_name")).alias("key")), catalogue)


@query(f"select doc_id, md5({S.strip('text')}) as raw_text, md5({S.display('text')}) as display, md5({S.canonical('text')}) as canonical, md5(upper(regexp_replace({S.display('text')}, '{S.SPACE}', '', 'g'))) as code, md5({S.key('text')}) as norm_key, md5({S.collapse('text')}) as collapsed, md5({S.topic('text')}) as topic from documents")
def normalize_text_variants(spark, d):
    t = F.col("text")
    kinds = {"raw_text": T.raw_text, "display": T.display, "canonical": T.canonical_key, "code": T.code, "norm_key": T.norm_key, "collapsed": T.collapse, "topic": T.topic_norm}
    return table(spark, d, "documents").select("doc_id", *(F.md5(f(t)).alias(n) for n, f in kinds.items()))


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then '1' else o_orderpriority end as mapped, lower(o_orderstatus) in ('f') as finished, 'unknown' as family from orders")
def mapped_labels(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.mapped(F.col("o_orderpriority"), {"1-URGENT": "1"}).alias("mapped"), (F.lower("o_orderstatus") == "f").alias("finished"), T.department_family(F.col("o_orderpriority")).alias("family"))


@query(f"select f as field, case when f in ('quality', 'toxic') then 'int' else 'str' end as type, count(*) filter (v is null) as null_count, count(*) filter (regexp_replace(v, '{S.SPACE}', '', 'g') = '') as blank_count, count(v) as nonnull_count, count(distinct v) as distinct_count from {LONG} group by all")
def field_profile(spark, d):
    return profile.field_profile(marked(spark, d), FIELDS)


@query(f"select * from {PRESENCE}")
def grouped_presence(spark, d):
    return profile.grouped_presence(marked(spark, d), "source", FIELDS)


@query(f"select source, max(case when field = 'lang' then availability end) as lang, max(case when field = 'text' then availability end) as text, max(case when field = 'quality' then availability end) as quality, max(case when field = 'toxic' then availability end) as toxic from {PRESENCE} group by source")
def availability_matrix(spark, d):
    return profile.availability_matrix(grouped_presence(spark, d), "source", ["lang", "text", "quality", "toxic"])


@query(f"select field, availability, count(*) as groups from {PRESENCE} group by all")
def availability_histogram(spark, d):
    return profile.availability_histogram(grouped_presence(spark, d))


def _events(spark, d):
    docs = marked(spark, d)
    rules = {"label_not_collected_or_unresolved": F.col("field").isin("quality", "toxic"), "language_not_reviewed_or_unresolved": (F.col("field") == "toxic") & (F.col("lang") != "en")}
    return profile.missing_events(docs, "doc_id", "source", FIELDS, profile.grouped_presence(docs, "source", FIELDS), rules)


@query(f"select doc_id, source, field, availability, array_to_string(causes, ',') as causes, case field when 'text' then 'content' when 'lang' then 'identity' when 'source' then 'provenance' else 'gate' end as semantic_class from {MISSING}")
def missing_events(spark, d):
    return _events(spark, d).withColumns({"causes": F.array_join("causes", ","), "semantic_class": profile.semantic_class(F.col("field"), CLASSES)})


@query(f"select label, count(*) as n from (select unnest(causes) as label from {MISSING}) group by label")
def missing_cause_counts(spark, d):
    return profile.label_counts(_events(spark, d), "causes")


@query("select count(*) as records, count(distinct (p_name, p_brand, p_type)) as distinct_rows, count(*) - count(distinct (p_name, p_brand, p_type)) as duplicates from part")
def exact_row_duplicates(spark, d):
    return identity.exact_row_duplicates(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query("select sha256(text) as value, count(*) as n, min(doc_id) as first_id from documents group by text having count(*) > 1")
def content_hash_duplicates(spark, d):
    return identity.duplicate_values(table(spark, d, "documents"), F.sha2("text", 256), "doc_id")


SPECS = {"name": ["p_name"], "brand_name": ["p_brand", "p_name"], "type_size": ["p_type", "p_size"], "brand_type_size": ["p_brand", "p_type", "p_size"]}


@query("select key_name, count(*) as groups, count(*) filter (n = 1) as unique_groups, count(*) filter (n > 1) as duplicate_groups, coalesce(sum(n) filter (n > 1), 0)::bigint as duplicate_records from ("
       + " union all ".join(f"select '{name}' as key_name, {' || {0} || '.format(chr(39) + '|' + chr(39)).join(S.canonical(f'{c}::varchar') for c in cols)} as k, count(*) as n from part group by 2" for name, cols in SPECS.items()) + ") group by key_name")
def composite_key_quality(spark, d):
    return identity.key_quality(table(spark, d, "part"), SPECS)


@query(f"select *, array_to_string(list_filter([case when distinct_p_brand > 1 then 'p_brand' end, case when distinct_p_size > 1 then 'p_size' end, case when distinct_p_type > 1 then 'p_type' end], lambda x: x is not null), ',') as varying from (select {S.canonical('p_name')} as key, count(*) as n, min(p_partkey) as first_id, count(distinct p_brand) as distinct_p_brand, count(distinct p_size) as distinct_p_size, count(distinct p_type) as distinct_p_type from part group by 1 having count(*) > 1)")
def key_collisions(spark, d):
    return identity.collisions(table(spark, d, "part"), T.canonical_key(F.col("p_name")), "p_partkey", ["p_brand", "p_size", "p_type"])


@query(f"select {S.key('p_name')} as key, array_to_string(list_sort(list(p_partkey)), ',') as ids from part group by 1 having count(*) > 1")
def duplicate_name_groups(spark, d):
    return identity.group_index(table(spark, d, "part"), T.norm_key(F.col("p_name")), "p_partkey").where(F.size("ids") > 1).select("key", F.array_join("ids", ",").alias("ids"))


@query(f"""with m as (select doc_id, quality, sha256(text) as h, source || '|' || md5({S.key('text')}) as c from {MARKED}),
  s as (select * from m where quality is distinct from 1), p as (select * from m where quality = 1),
  f as (select doc_id, h in (select h from p) as in_h, c in (select c from p) as in_c, count(*) over (partition by h) > 1 as dup_h, count(*) over (partition by c) > 1 as dup_c from s)
  select doc_id, array_to_string(list_filter([case when in_h then 'content_hash' end, case when in_c then 'source_key' end], lambda x: x is not null), ',') as match_keys,
  array_to_string(list_filter([case when dup_h then 'content_hash' end, case when dup_c then 'source_key' end], lambda x: x is not null), ',') as duplicate_keys,
  case when in_h or in_c then 'overlap_primary_review_required' when dup_h or dup_c then 'duplicate_within_staged_review_required' else 'unique_against_primary_and_staged_keys' end as decision from f""")
def overlap_dedupe_decision(spark, d):
    keyed = marked(spark, d).select("doc_id", "quality", F.sha2("text", 256).alias("h"), F.concat_ws("|", "source", F.md5(T.norm_key(F.col("text")))).alias("c"))
    first = F.coalesce(F.col("quality") == 1, F.lit(False))
    return identity.overlap_decisions(keyed.where(~first), keyed.where(first), {"content_hash": "h", "source_key": "c"}, "doc_id")


@query("select source, count(*) as documents, count(*) filter (toxic is not null) as labelled, sum(n_chars)::bigint as chars, grouping(source)::bigint as overall from " + MARKED + " group by rollup (source)")
def lane_comparison(spark, d):
    return audit.sliced_summary(marked(spark, d), "source", F.count("*").alias("documents"), F.count("toxic").alias("labelled"), F.sum("n_chars").cast("long").alias("chars"))


@query(f"select coalesce(nullif(toxic::varchar, ''), '<missing>') as value, count(*) as n from {MARKED} group by 1")
def value_histogram(spark, d):
    return audit.histogram(marked(spark, d), F.col("toxic"), "value")


GAPS = {"missing_url": lambda: F.nullif(F.col("url"), F.lit("")).isNull(), "insecure_or_relative_url": lambda: ~F.col("url").startswith("https://"), "page_without_title": lambda: ~F.lower("html").contains("<title"), "short_page": lambda: F.length("html") < 1000}


@query("select page_id, array_to_string(codes, ',') as gap_reason_codes, 'review_required' as review_status, 'blocked' as release_status from (select page_id, list_filter([case when coalesce(url, '') = '' then 'missing_url' end, case when not starts_with(url, 'https://') then 'insecure_or_relative_url' end, case when not contains(lower(html), '<title') then 'page_without_title' end, case when length(html) < 1000 then 'short_page' end], lambda x: x is not null) as codes from pages) where len(codes) > 0")
def provenance_gaps(spark, d):
    return audit.gap_queue(table(spark, d, "pages"), {n: c() for n, c in GAPS.items()}, "page_id")


@query("select doc_id, n_chars, length(text)::bigint as actual_chars from documents where n_chars is distinct from length(text)")
def mismatch_quarantine(spark, d):
    actual = F.length("text").cast("long")
    return table(spark, d, "documents").where(~F.col("n_chars").eqNullSafe(actual)).select("doc_id", "n_chars", actual.alias("actual_chars"))


@query(f"""select doc_id, source, array_to_string(codes, ',') as replacement_blockers, case when len(codes) > 0 then 'blocked_pending_formalization' else 'eligible_for_independent_review' end as review_status from
  (select doc_id, source, list_filter([case when quality is null then 'quality_missing' end, case when quality = 0 then 'quality_low' end, case when toxic = 1 then 'toxic' end, case when count(*) over (partition by text) > 1 then 'content_duplicated' end], lambda x: x is not null) as codes from {MARKED})""")
def replacement_blockers(spark, d):
    counts = table(spark, d, "documents").groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg((F.count("*") > 1).alias("many"))
    docs = marked(spark, d).withColumns({"h": F.xxhash64("text"), "m": F.md5("text")}).join(counts, ["h", "m"])
    rules = {"quality_missing": F.col("quality").isNull(), "quality_low": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "content_duplicated": F.col("many")}
    return audit.blocked(docs, rules, "doc_id", "source")


@query(f"select lang, coalesce(toxic::varchar, '<missing>') as toxic, count(*) as n from {MARKED} group by all")
def crosstab_status(spark, d):
    return marked(spark, d).groupBy("lang", F.coalesce(F.col("toxic").cast("string"), F.lit("<missing>")).alias("toxic")).agg(F.count("*").alias("n"))


@query("select 'documents' as side, (select count(*) from (select distinct text from documents intersect select distinct text from documents where doc_id in (select doc_id from labels))) as shared_texts, (select count(*) from (select doc_id from documents except select doc_id from labels)) as unlabelled")
def set_overlap_counts(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    shared = docs.select("text").intersect(docs.join(labels, "doc_id", "left_semi").select("text")).agg(F.count("*").alias("shared_texts"))
    rest = docs.select("doc_id").exceptAll(labels.select("doc_id")).agg(F.count("*").alias("unlabelled"))
    return shared.crossJoin(rest).select(F.lit("documents").alias("side"), "shared_texts", "unlabelled")  # one row each


@query(f"with m as (select * from {MARKED}), g as (select 'documents_present' as gate, count(*) > 0 as passed from m union all select 'ids_unique', count(*) = count(distinct doc_id) from m union all select 'texts_present', bool_and(coalesce(text, '') <> '') from m union all select 'all_labelled', bool_and(toxic is not null) from m) select * from g union all select 'all', bool_and(passed) from g")
def completion_gates(spark, d):
    m = marked(spark, d)
    one = m.agg((F.count("*") > 0).alias("documents_present"), (F.count("*") == F.countDistinct("doc_id")).alias("ids_unique"), F.bool_and(F.coalesce(F.col("text"), F.lit("")) != "").alias("texts_present"), F.bool_and(F.col("toxic").isNotNull()).alias("all_labelled"))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("gate"), F.col(c).alias("passed")) for c in one.columns))).alias("g")).select("g.*")
    return audit.gates(rows)


@query("select k as field, count(*) as n, count(distinct v) as distinct_values, min(t) as type from (select unnest(json_keys(props)) as k, json_extract_string(props, '$.' || unnest(json_keys(props))) as v, case when regexp_full_match(json_extract_string(props, '$.' || unnest(json_keys(props))), '-?[0-9]+') then 'int' else 'str' end as t from events) group by k")
def json_props_profile(spark, d):
    return profile.json_types(table(spark, d, "events"), "props").groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"), F.min("type").alias("type"))


@query("select 'documents' as dataset, count(*) as records, count(distinct text) as distinct_contents from documents union all select 'benchmark', count(*), count(distinct text) from benchmark")
def input_manifest(spark, d):
    of = lambda n: manifest(contract(table(spark, d, n), {"negative ids": (F.count_if(F.col("doc_id" if n == "documents" else "item_id") < 0), 0)}), F.col("text")).select(F.lit(n).alias("dataset"), "records", "distinct_contents")
    return of("documents").unionByName(of("benchmark"))


@query("select 'documents' as source_id, doc_id as native_id, 'D-' || substr(sha256('documents|' || doc_id::varchar), 1, 20) as record_id, lang from documents union all select 'benchmark', item_id, 'D-' || substr(sha256('benchmark|' || item_id::varchar), 1, 20), null from benchmark")
def source_union(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("source_id"), F.col("doc_id").alias("native_id"), "lang")
    b = table(spark, d, "benchmark").select(F.lit("benchmark").alias("source_id"), F.col("item_id").alias("native_id"))
    return unify(a, b).select("source_id", "native_id", T.content_id("D-", F.col("source_id"), F.col("native_id")).alias("record_id"), "lang")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_windows_batch(spark, d):
    return event_windows(table(spark, d, "events"))


YEARLY = "(select year(o_orderdate)::bigint as year, o_orderpriority as category, count(*) as n, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as sd, min(o_totalprice) as low, max(o_totalprice) as high from orders group by all)"


@query(f"select year, category, n, round(mean, 2) as mean_price, round(sd, 2) as sd_price, low, high, n - lag(n) over w as change, round((n - lag(n, 3) over w)::double / nullif(lag(n, 3) over w, 0), 6) as change_rate_3y from {YEARLY} window w as (partition by category order by year)")
def planned_yearly_category_stats(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    base = o.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    w = Window.partitionBy("category").orderBy("year")
    third = F.lag("n", 3).over(w)
    return base.select("year", "category", "n", F.round("mean", 2).alias("mean_price"), F.round("sd", 2).alias("sd_price"), "low", "high", (F.col("n") - F.lag("n").over(w)).alias("change"), F.round((F.col("n") - third).cast("double") / F.nullif(third, F.lit(0)), 6).alias("change_rate_3y"))


@query("select n_name, c_custkey, revenue, rank from (select n_name, c_custkey, round(sum(o_totalprice), 2) as revenue, row_number() over (partition by n_name order by round(sum(o_totalprice), 2) desc, c_custkey) as rank from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name, c_custkey) where rank <= 3")
def planned_selection_rank(spark, d):
    from pyspark.sql import Window

    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("r"))
    named = spent.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = named.select("n_name", "c_custkey", F.round("r", 2).alias("revenue"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("revenue"), "c_custkey")).cast("long")).where("rank <= 3")
