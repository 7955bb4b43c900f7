"""Queries over chunks, sections, topics and lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import audit, chunk, views
from lodestone.sources.io import table

from . import sql as S
from .registry import query

SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({S.collapse('text')}, '([。！？.!?；;])[\s\p{{Z}}]*', '\1' || chr(1), 'g'), chr(1)), lambda x: {S.strip('x')}), lambda x: x <> '')"
STATES = f"list_transform({SENTENCES}, lambda s: {{'now': s, 'out': []::varchar[]}})"
FULL = "length(a.now) > 0 and length(a.now) + length(b.now) + 1 > 420"
PACKED = f"list_reduce({STATES}, lambda a, b: {{'now': {S.strip(f'(case when {FULL} then right(a.now, 60) else a.now end) || chr(32) || b.now')}, 'out': case when {FULL} then list_append(a.out, a.now) else a.out end}})"
CHUNKS = f"(select doc_id, source, unnest(cs) as chunk, unnest(range(0, len(cs))) as chunk_index from (select doc_id, source, case when p is null then [] else list_append(p.out, p.now) end as cs from (select doc_id, source, case when len({SENTENCES}) = 0 then null else {PACKED} end as p from documents)))"


def chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.posexplode(chunk.sentence_pack(F.col("text"))).alias("chunk_index", "chunk"))


@query(f"select doc_id, chunk_index::bigint as chunk_index, length(chunk)::bigint as char_count, md5(chunk) as chunk_md5 from {CHUNKS}")
def sentence_pack_chunks(spark, d):
    return chunks(spark, d).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("char_count"), F.md5("chunk").alias("chunk_md5"))


@query(f"select source, count(*) as chunks, min(length(chunk))::bigint as shortest, round(sum(length(chunk))::double / count(*), 2) as mean, max(length(chunk))::bigint as longest from {CHUNKS} group by source")
def chunk_length_stats(spark, d):
    size = F.length("chunk").cast("long")
    return chunks(spark, d).groupBy("source").agg(F.count("*").alias("chunks"), F.min(size).alias("shortest"), F.round(F.sum(size).cast("double") / F.count("*"), 2).alias("mean"), F.max(size).alias("longest"))


LABELS = ("system", "user", "assistant")
TALK = "(select conv_id, string_agg(role || ': ' || coalesce(text, ''), ' ' order by turn, role, text) as content from conversations group by conv_id)"
PIECES = rf"list_filter(list_transform(string_split(regexp_replace({S.collapse('content')}, '(?i)((?:system|user|assistant):)', chr(1) || '\1', 'g'), chr(1)), lambda x: {S.strip('x')}), lambda x: x <> '')"


def talks(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), " ").alias("content"))


@query(f"select conv_id as id, i::bigint as chunk_index, conv_id || ':chunk:' || lpad(i::varchar, 4, '0') as chunk_id, coalesce(nullif(regexp_extract(p, '^([a-z_]+):', 1), ''), 'document') as section, length(p)::bigint as char_count, sha256(p) as sha256 from (select conv_id, unnest({PIECES}) as p, unnest(range(0, len({PIECES}))) as i from {TALK})")
def label_sections(spark, d):
    return chunk.label_sections(talks(spark, d), "conv_id", F.col("content"), LABELS)


@query(rf"select conv_id, md5(regexp_extract(content, '(?is)(?:user:)(.*?)(?:assistant:|system:|$)', 1)) as first_question, contains(lower(content), 'user:') as has_question from {TALK}")
def extracted_sections(spark, d):
    found = T.extract_section(F.col("content"), ("user:",), ("assistant:", "system:"))
    return talks(spark, d).select("conv_id", F.md5(found).alias("first_question"), F.lower("content").contains("user:").alias("has_question"))


NUM = "[一二三四五六七八九十]+"
MARK = rf"第{NUM}[章節]|{NUM}、|[0-9]+\.[0-9]+\.[0-9]+|[0-9]+\.[0-9]+|[0-9]+[\.、)]"
LINES = rf"(select doc_id as id, i as line_no, {S.strip('l')} as line from (select doc_id, unnest(string_split_regex(text, '[\r\n]')) as l, generate_subscripts(string_split_regex(text, '[\r\n]'), 1) as i from documents) where {S.strip('l')} <> '')"
MARKED_LINES = rf"(select *, nullif(regexp_extract(line, '^({MARK})[\s\p{{Z}}]*(.+)$', 1), '') as marker, regexp_extract(line, '^({MARK})[\s\p{{Z}}]*(.+)$', 2) as rest from {LINES})"
LEVEL = rf"case when marker is null then 0 when regexp_full_match(marker, '第{NUM}章') then 1 when regexp_full_match(marker, '第{NUM}節') then 2 when regexp_full_match(marker, '{NUM}、') then 1 when regexp_full_match(marker, '[0-9]+\.[0-9]+\.[0-9]+') then 3 when regexp_full_match(marker, '[0-9]+\.[0-9]+') then 2 else 1 end"
ATOMIC = rf"""(with a as (select *, {LEVEL} as level, case when marker is not null then {S.topic('rest')} end as body from {MARKED_LINES}),
  b as (select *, sum(case when level = 1 then 1 else 0 end) over w as run, last_value(case when level = 1 then body end ignore nulls) over w as chapter from a window w as (partition by id order by line_no)),
  c as (select *, last_value(case when level = 2 then body end ignore nulls) over (partition by id, run order by line_no) as topic, case when marker is not null then [body] else string_split_regex(line, '[；;。！？!?]') end as ps from b),
  e as (select id, line_no, level, marker, chapter, topic, unnest(ps) as piece, generate_subscripts(ps, 1) as piece_no from c),
  f as (select *, {S.topic(rf"regexp_replace({S.topic('piece')}, '^(?:[-*•]|[0-9]+[\.、)]|{NUM}、)[\s\p{{Z}}]*', '')")} as text from e),
  g as (select *, row_number() over (partition by id, text order by line_no, piece_no) as n from f where length(text) between 3 and 300)
  select id, row_number() over (partition by id order by line_no, piece_no) - 1 as position, level, marker, chapter, topic, text from g where n = 1)"""


def topics(spark, d):
    return chunk.atomic_topics(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"select id, position::bigint as position, level::bigint as level, marker, chapter, topic, md5(text) as text_md5 from {ATOMIC}")
def atomic_topics(spark, d):
    return topics(spark, d).select("id", "position", "level", "marker", "chapter", "topic", F.md5("text").alias("text_md5"))


FLAGS = "list_filter([" + ", ".join(f"case when regexp_matches(text, '(?i){p}') then '{n}' end" for n, p in chunk.CONTAMINATION.items()) + "], lambda x: x is not null)"


@query(f"select id, position::bigint as position, array_to_string({FLAGS}, ',') as labels, case when len({FLAGS}) > 0 then 'contamination' else 'content' end as lane from {ATOMIC}")
def contamination_lanes(spark, d):
    labels = chunk.contamination(F.col("text"))
    return topics(spark, d).select("id", "position", F.array_join(labels, ",").alias("labels"), chunk.lane(labels).alias("lane"))


@query(f"select case when len({FLAGS}) > 0 then 'contamination' else 'content' end as lane, count(*) as units, count(distinct id) as documents, count(*) filter (chapter is null) as unresolved_chapter, count(*) filter (topic is not null) as with_topic from {ATOMIC} group by 1")
def lane_counts(spark, d):
    rows = topics(spark, d).withColumn("lane", chunk.lane(chunk.contamination(F.col("text"))))
    return rows.groupBy("lane").agg(F.count("*").alias("units"), F.countDistinct("id").alias("documents"), F.count_if(F.col("chapter").isNull()).alias("unresolved_chapter"), F.count("topic").alias("with_topic"))


@query(rf"select item_id, md5(case when len(w) > 0 then array_to_string(w[1:5], ' / ') else left(text, 80) end) as label_md5 from (select item_id, text, list_filter(regexp_extract_all(text, '[一-鿿A-Za-z][一-鿿A-Za-z0-9+#-]{{1,30}}'), lambda x: not ({' or '.join(f'regexp_matches(x, {chr(39)}(?i){p}{chr(39)})' for p in chunk.CONTAMINATION.values())})) as w from benchmark)")
def topic_labels(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(chunk.topic_label(F.col("text"))).alias("label_md5"))


@query("select url_host as source_label, count(*) as n from (select regexp_extract(url, '^https?://([^/]+)', 1) as url_host from pages) group by 1")
def corroboration_counts(spark, d):
    return audit.histogram(table(spark, d, "pages"), F.regexp_extract("url", "^https?://([^/]+)", 1), "source_label")


ROLES = "(select conv_id, coalesce(string_agg(text, ' ' order by turn, text) filter (role = 'system'), '') as system, coalesce(string_agg(text, ' ' order by turn, text) filter (role = 'user'), '') as user_, coalesce(string_agg(text, ' ' order by turn, text) filter (role = 'assistant'), '') as assistant from conversations group by conv_id)"


@query(f"select conv_id, md5(concat_ws(chr(10), nullif(user_, ''), nullif(assistant, ''))) as topic_text, md5(concat_ws(chr(10), nullif(system, ''), nullif(user_, ''), nullif(assistant, ''))) as content_text, system <> '' as has_system, user_ <> '' as has_user_, assistant <> '' as has_assistant from {ROLES}")
def section_views(spark, d):
    of = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    sections = table(spark, d, "conversations").groupBy("conv_id").agg(of("system").alias("system"), of("user").alias("user_"), of("assistant").alias("assistant"))
    seen = views.section_views(sections, "conv_id", {"topic_text": ("user_", "assistant"), "content_text": ("system", "user_", "assistant")}, ("system", "user_", "assistant"))
    return seen.withColumns({c: F.md5(c) for c in ("topic_text", "content_text")})


@query(f"select p_partkey, p_name, p_brand, {S.display('p_name')} as p_name_normalised, upper(regexp_replace({S.display('p_brand')}, '{S.SPACE}', '', 'g')) as p_brand_normalised from part")
def normalised_records(spark, d):
    return views.normalised_records(table(spark, d, "part"), ["p_partkey"], {"p_name": T.display, "p_brand": T.code})


@query("select doc_id, md5(concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(lang, ''), nullif(text, ''))) as document_md5 from documents")
def weighted_document_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(views.weighted_document({"source": 1, "lang": 2, "text": 1})).alias("document_md5"))


@query("select doc_id, source, 'label_missing' as abstention_reason, 'abstained' as retrieval_status, 'blocked' as promotion_status from documents where doc_id not in (select doc_id from labels)")
def abstention_queue(spark, d):
    marked = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return audit.abstentions(marked, F.col("known").isNull(), "label_missing", "doc_id", "source")
