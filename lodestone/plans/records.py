"""Queries over the literal record sets: label lookups, identity, hybrids with the published formulas, headings, lanes."""

from __future__ import annotations

import difflib
import re
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestone.functions import text as T
from lodestone.operators import audit, chunk, coverage, hybrid, identity, index, profile, rank, views
from lodestone.sources import io

from . import sql as S
from . import texts
from .cases import CASES, frame, relation
from .registry import query

COURSES, OUTLINES, CANDIDATES, CHUNKS, LINES = (relation(n) for n in ("courses", "outlines", "candidates", "chunks", "lines"))
#: What NFKC changes in the literal rows.
FORMS = {"Ｃ": "C", "＋": "+", "ﬁ": "fi", "①": "1", "③": "3", "（": "(", "）": ")", "　": " ", "：": ":", "；": ";", "，": ",", "！": "!"}
STRINGS = ArrayType(StringType())


def nf(x: str) -> str:
    x = f"coalesce({x}, '')"
    for a, b in FORMS.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def key(x: str) -> str:
    return S.key(nf(x))


def json_list(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda x: '\"' || replace(x, '\"', '\\\"') || '\"'), ', ') || ']'"


def case(x: str, table: dict[str, str]) -> str:
    return f"coalesce(case {' '.join(f'when {x} = {chr(39)}{k}{chr(39)} then {chr(39)}{v}{chr(39)}' for k, v in table.items())} end, {x})"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


# ---------------------------------------------------------------- labels and texts


@query(f"""select query_id, {case(S.display('semester'), T.SEMESTERS)} as semester, {case(S.key('semester'), T.SEMESTERS_WIDE)} as semester_wide, {case(S.display('degree'), T.DEGREES)} as degree,
  case when department is null then 'unknown' when {any_of('department', T.TECHNICAL)} then 'technical_candidate' when {any_of('department', T.ADMINISTRATIVE)} then 'administrative_candidate' else 'unknown' end as family,
  case lower(flag) when 'true' then true when 'false' then false end as flag, nullif(lower({S.strip('raw_sha256')}), '') as hash_key, coalesce(nullif(outline, ''), nullif(description, '')) as first_text, coalesce(objectives <> '', false) as has_objectives from {COURSES}""")
def record_labels(spark, d):
    c = F.col
    return frame(spark, "courses").select(
        "query_id", T.semester(c("semester")).alias("semester"), T.semester_wide(c("semester")).alias("semester_wide"), T.degree(c("degree")).alias("degree"), T.department_family(F.coalesce(c("department"), F.lit(""))).alias("family"),
        T.parse_bool(c("flag")).alias("flag"), T.lookup_hash(c("raw_sha256")).alias("hash_key"), T.first_nonempty(c("outline"), c("description")).alias("first_text"), F.coalesce(T.nonempty(c("objectives")), F.lit(False)).alias("has_objectives"),
    )


@query(f"""select item_id, array_to_string(list_sort(list_filter([case when len(list_filter(coalesce(types, []::varchar[]), lambda t: contains(t, '行政'))) > 0 then 'administrative_candidate' end, case when len(list_filter(coalesce(types, []::varchar[]), lambda t: contains(t, '技術'))) > 0 then 'technical_candidate' end], lambda x: x is not null)), ',') as families,
  coalesce(len(core) > 0, false) as has_core, {key('subject')} as retrieval_key, {S.key('subject')} as error_key, {S.collapse(nf('remarks'))} as collapsed, {S.display(nf('subject'))} as display, case when page > 5 then page::varchar else '' end as page_key from {OUTLINES}""")
def outline_labels(spark, d):
    o = frame(spark, "outlines")
    families = F.array_join(T.type_family(F.coalesce("types", F.array().cast("array<string>"))), ",")
    page = F.when(F.col("page") > 5, F.col("page")).otherwise(0)
    return o.select("item_id", families.alias("families"), T.nonempty(F.col("core"), "array").alias("has_core"), T.retrieval_key(F.col("subject")).alias("retrieval_key"), T.norm_key(F.col("subject")).alias("error_key"), T.collapse(T.nfkc(F.coalesce("remarks", F.lit("")))).alias("collapsed"), T.display(T.nfkc(F.col("subject"))).alias("display"), T.identity_key(page, o.schema["page"].dataType).alias("page_key"))


RECORD = StructType([StructField("subject_name", StringType()), StructField("core_knowledge", STRINGS), StructField("outline", ArrayType(StructType([StructField("text", StringType())]))), StructField("remarks", StringType())])


def outlined(spark):
    items = F.transform("outline", lambda x: F.struct(x.alias("text")))
    return frame(spark, "outlines").select("*", F.struct(F.col("subject").alias("subject_name"), F.col("core").alias("core_knowledge"), items.alias("outline"), "remarks").alias("record"))


_TEXTS = "'[' || array_to_string(list_transform(outline, lambda x: '{\"text\": \"' || x || '\"}'), ', ') || ']'"
_JSON = f"'{{\"core_knowledge\": ' || coalesce({json_list('core')}, 'null') || ', \"outline\": ' || coalesce({_TEXTS}, 'null')"
_WORDS = "concat_ws(' ', nullif(subject, ''), nullif(array_to_string(core, ' '), ''), nullif(array_to_string(outline, ' '), ''), nullif(remarks, ''))"


@query(f"""select item_id, coalesce(subject, '') as subject_name, coalesce({json_list('core')}, '') as core_knowledge, coalesce({_TEXTS}, '') as outline, coalesce(remarks, '') as remarks, {_WORDS} as document_text,
  'OUT-' || substr(sha256({_JSON} || ', "remarks": ' || coalesce('"' || remarks || '"', 'null') || ', "subject_name": "' || replace(subject, '"', '\\"') || '"}}'), 1, 20) as record_id, substr(sha256({_JSON} || '}}'), 1, 16) as content_signature from {OUTLINES}""")
def outline_texts(spark, d):
    r, kind = F.col("record"), RECORD
    of = lambda n: T.as_text(r[n], kind[n].dataType).alias(n)
    signed = StructType([kind["core_knowledge"], kind["outline"]])
    empty = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    text = views.joined(" ", F.col("subject"), F.array_join(empty(F.col("core")), " "), F.array_join(empty(F.transform(r["outline"], lambda x: x["text"])), " "), F.col("remarks"))
    return outlined(spark).select("item_id", of("subject_name"), of("core_knowledge"), of("outline"), of("remarks"), text.alias("document_text"), T.json_id("OUT-", r, kind).alias("record_id"), T.json_id("", F.struct(r["core_knowledge"].alias("core_knowledge"), r["outline"].alias("outline")), signed, 16).alias("content_signature"))


@query(f"select query_id, concat_ws(' ', nullif(title, ''), nullif(department, '')) as title_department, concat_ws(' ', nullif(title, ''), nullif(department, ''), nullif(description, ''), nullif(outline, '')) as with_content, concat_ws(chr(10), nullif({S.strip('outline')}, ''), nullif({S.strip('description')}, '')) as topic_text, concat_ws(chr(10), nullif({S.strip('description')}, ''), nullif({S.strip('outline')}, ''), nullif({S.strip('objectives')}, '')) as content_text from {COURSES}")
def query_texts(spark, d):
    c = F.col
    topic, content = course_views()
    return frame(spark, "courses").select("query_id", views.joined(" ", c("title"), c("department")).alias("title_department"), views.joined(" ", c("title"), c("department"), c("description"), c("outline")).alias("with_content"), topic.alias("topic_text"), content.alias("content_text"))


def course_views():
    field = lambda n: T.strip(T.as_text(F.col(n), StringType()))
    return views.joined("\n", field("outline"), field("description")), views.joined("\n", field("description"), field("outline"), field("objectives"))


LABELS = {"outline": (("課程大綱：",), ("授課進度：", "課程目標：")), "objectives": (("課程目標：",), ("課程大綱：", "授課進度：")), "schedule": (("授課進度：",), ("課程大綱：",))}
_PART = {n: f"trim(regexp_extract(coalesce(blob, ''), '(?is)(?:{'|'.join(a)})(.*?)(?:{'|'.join(b)}|$)', 1))" for n, (a, b) in LABELS.items()}
_OUT = f"coalesce(nullif({_PART['outline']}, ''), nullif(outline, ''))"


@query(f"select rec, concat_ws(chr(10), {_OUT}, nullif({_PART['objectives']}, ''), nullif({_PART['schedule']}, '')) as topic_text, concat_ws(chr(10), nullif({_PART['objectives']}, ''), {_OUT}, nullif({_PART['schedule']}, '')) as content_text, {_PART['outline']} = '' as parser_fallback_outline from {relation('blobs')}")
def curated_sections(spark, d):
    found = views.curated_views(F.coalesce("blob", F.lit("")), F.col("outline"), LABELS, clean=F.trim)
    return frame(spark, "blobs").select("rec", *(c.alias(n) for n, c in found.items()))


# ---------------------------------------------------------------- identity


def _norm(x):
    return re.sub(r"[^\w]", "", unicodedata.normalize("NFKC", x or "").casefold())


_ROWS = {n: [dict(zip((f.split(" ")[0] for f in CASES[n][0].split(", ")), r)) for r in CASES[n][1]] for n in ("courses", "outlines")}
#: The library's own ratio for every pair of titles, as SQL has none.
SIMILAR = "(select * from (values " + ", ".join(f"({c['query_id']}::bigint, {o['item_id']}::bigint, {round(difflib.SequenceMatcher(None, _norm(c['title']), _norm(o['subject'])).ratio(), 8)}::double)" for c in _ROWS["courses"] for o in _ROWS["outlines"]) + ") as t(query_id, item_id, similarity))"
_FAMILY = f"case when department is null then 'unknown' when {any_of('department', T.TECHNICAL)} then '技術' when {any_of('department', T.ADMINISTRATIVE)} then '行政' else 'unknown' end"
_SCORED = f"""(select c.query_id, c.item_id, c.score, {key('k.title')} = {key('o.subject')} as exact, len(list_filter(coalesce(o.types, []::varchar[]), lambda t: contains(t, {_FAMILY}))) > 0 as compatible, s.similarity, o.dup from {CANDIDATES} c join {COURSES} k using (query_id) join (select *, count(*) over (partition by {key('subject')}) > 1 as dup from {OUTLINES}) o using (item_id) join {SIMILAR} s using (query_id, item_id))"""
_AUDIT = f"""(with a as (select *, round(score + case when compatible then 0.05::double else 0 end + case when exact then 0.02::double else 0 end, 8) as advisory from {_SCORED}),
  r as (select *, row_number() over w as n, lead(advisory) over w as next from a window w as (partition by query_id order by advisory desc, item_id)),
  x as (select query_id, count(*) filter (exact) as n_exact, coalesce(bool_or(exact and dup), false) as shared from a group by query_id),
  j as (select k.query_id, r.item_id as top_item, r.advisory as advisory_score, coalesce(round(coalesce(r.advisory - r.next, r.advisory), 8), 0) as top_margin, r.similarity, r.exact as top_exact, coalesce(x.n_exact, 0) as n_exact, coalesce(x.shared, false) as shared, coalesce(r.dup, false) as dup from {COURSES} k left join (select * from r where n = 1) r using (query_id) left join x using (query_id)),
  s as (select *, case when n_exact = 1 and not shared then 'exact' when n_exact > 0 or (similarity >= 0.7 and top_margin < 0.05) or dup then 'ambiguous' else 'weak' end as status from j)
  select query_id, top_item, advisory_score, top_margin, similarity, top_exact, status, case status when 'exact' then 'unique_exact_title_match' when 'ambiguous' then 'duplicate_variant_or_close_candidate_margin' else 'no_unique_exact_or_strong_alias_evidence' end as reason from s)"""


def named(spark):
    """Courses and outlines with their retrieval keys; outlines know whether their name is shared."""
    from pyspark.sql import Window

    courses = frame(spark, "courses").withColumn("key", T.retrieval_key(F.col("title")))
    outlines = frame(spark, "outlines").withColumn("key", T.retrieval_key(F.col("subject")))
    return courses, outlines.withColumn("duplicate", F.count("*").over(Window.partitionBy("key")) > 1)


def audited(spark):
    courses, outlines = named(spark)
    family = F.create_map(F.lit("technical_candidate"), F.lit("技術"), F.lit("administrative_candidate"), F.lit("行政"))[T.department_family(F.coalesce("department", F.lit("")))]
    left = courses.select("query_id", F.col("key").alias("left_key"), family.alias("family"))
    right = outlines.select("item_id", F.col("key").alias("right_key"), "types", "duplicate")
    both = frame(spark, "candidates").join(left, "query_id").join(right, "item_id")
    fits = F.coalesce(F.exists("types", lambda t: F.coalesce(t.contains(F.col("family")), F.lit(False))), F.lit(False))
    rows = both.select("query_id", "item_id", "score", (F.col("left_key") == F.col("right_key")).alias("exact"), fits.alias("compatible"), F.round(identity.title_similarity("left_key", "right_key"), 8).alias("similarity"), "duplicate")
    return hybrid.identity_audit(rows, courses)


@query(f"select * from {_AUDIT}")
def identity_status(spark, d):
    return audited(spark)


@query(f"select query_id, top_item as item_id, similarity, advisory_score, 'machine_candidate_review_required' as alias_status, 'not_human_adjudicated' as human_review_status from {_AUDIT} where top_item is not null and not top_exact")
def alias_candidates(spark, d):
    return hybrid.alias_candidates(audited(spark))


_BRIDGE = f"""(with e as (select k.query_id, o.item_id from {COURSES} k join {OUTLINES} o on {key('k.title')} = {key('o.subject')}),
  f as (select *, row_number() over (partition by query_id order by similarity desc, item_id) as r from {SIMILAR} where similarity > 0),
  x as (select query_id, item_id from {CANDIDATES} union select query_id, item_id from e union select query_id, item_id from f where r <= 5),
  n as (select k.query_id, (select count(*) from e where e.query_id = k.query_id) as n_exact, (select count(*) from {CANDIDATES} c where c.query_id = k.query_id) as n_current, (select count(*) from x where x.query_id = k.query_id) as n_expanded, (select count(*) from e where e.query_id = k.query_id and not exists (select 1 from {CANDIDATES} c where c.query_id = e.query_id and c.item_id = e.item_id)) as recovered, (select max(similarity) from f where f.query_id = k.query_id) as best from {COURSES} k)
  select *, case when n_exact = 1 then 'exact' when n_exact > 1 or best >= 0.7 then 'ambiguous' else 'weak' end as status, case when n_exact = 1 then 'unique_exact_normalized_subject' when n_exact > 1 then 'exact_name_has_multiple_outline_variants' when best >= 0.7 then 'strong_machine_alias_requires_review' else 'no_unique_exact_or_strong_alias' end as reason from n)"""


def bridged(spark):
    """Exact, current and five nearest titles of every course."""
    courses, outlines = named(spark)
    exact = courses.join(outlines, "key").select("query_id", "item_id")
    near = identity.similar_titles(courses.where("key != ''").select(F.col("key").alias("left_key")).distinct(), outlines.select(F.col("key").alias("right_key")).distinct(), 8)
    fuzzy = courses.join(near, F.col("key") == F.col("left_key")).select("query_id", "right_key", "similarity").join(outlines.select("item_id", F.col("key").alias("right_key")), "right_key")
    best = rank.top_k(fuzzy.select("query_id", "item_id", F.col("similarity").alias("score")), 5)
    current = frame(spark, "candidates")
    return courses, exact, current, best, audit.union_pool(current, exact, best)


@query(f"select * from {_BRIDGE}")
def identity_bridge(spark, d):
    courses, exact, current, best, pool = bridged(spark)
    count = lambda df, n: df.groupBy("query_id").agg(F.count("*").alias(n))
    gone = exact.join(current.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    out = courses.select("query_id")
    for df, n in ((exact, "n_exact"), (current, "n_current"), (pool, "n_expanded"), (gone, "recovered")):
        out = out.join(count(df, n), "query_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    out = out.join(best.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left")
    status, reason = rank.bridge_status(F.col("n_exact"), F.col("best"))
    return out.withColumns({"status": status, "reason": reason})


@query(f"with e as (select k.query_id, o.item_id from {COURSES} k join {OUTLINES} o on {key('k.title')} = {key('o.subject')}), f as (select *, row_number() over (partition by query_id order by similarity desc, item_id) as r from {SIMILAR} where similarity > 0) select query_id, item_id, string_agg(p::varchar, ',' order by p) as pools from (select query_id, item_id, 0 as p from {CANDIDATES} union all select query_id, item_id, 1 from e union all select query_id, item_id, 2 from f where r <= 5) group by all")
def bridge_pool(spark, d):
    return bridged(spark)[-1]


# ---------------------------------------------------------------- hybrids

_SCALE = lambda c: f"case when max({c}) over (partition by query_id) > 0 then {c} / max({c}) over (partition by query_id) else 0 end"
_VIEWS = f"(select query_id, title, concat_ws(' ', nullif({S.strip('outline')}, ''), nullif({S.strip('description')}, '')) as topic, concat_ws(' ', nullif({S.strip('description')}, ''), nullif({S.strip('outline')}, ''), nullif({S.strip('objectives')}, '')) as content from {COURSES})"
_FIELDS = f"(select item_id, coalesce(subject, '') as subject, coalesce({json_list('core')}, '') as core, coalesce({_TEXTS}, '') as outline, coalesce(remarks, '') as remarks from {OUTLINES})"
_N = "select 8"


def _cos(left: str, a: str, right: str, b: str) -> str:
    return S.tfidf(S.postings(f"(select query_id as id, {nf(a)} as text from {left})", "id", "text", 2, 4, whole=False), S.postings(f"(select item_id as id, {nf(b)} as text from {right})", "id", "text", 2, 4, whole=False), _N)


_WEIGHTED = " || ' ' || ".join(["subject", "subject", "core", "core", "outline", "outline", "remarks"])
_BM25 = S.bm25(S.postings(f"(select query_id as id, {nf('content')} as text from {_VIEWS})", "id", "text", 2), S.postings(f"(select item_id as id, {nf(_WEIGHTED)} as text from {_FIELDS})", "id", "text", 2), _N)
_EXACT = f"(select k.query_id, o.item_id, 1.0::double as score from {COURSES} k join {OUTLINES} o on {key('k.title')} = {key('o.subject')})"
_PARTS = {"identity": _EXACT, "title": _cos(_VIEWS, "title", _FIELDS, "subject"), "core": _cos(_VIEWS, "topic", _FIELDS, "core"), "outline": _cos(_VIEWS, "topic", _FIELDS, "outline"), "remarks": _cos(_VIEWS, "content", _FIELDS, "remarks"), "bm25": _BM25}
_ALL = f"(select k.query_id, o.item_id, {', '.join(f'coalesce({n}.score, 0) as {n}' for n in _PARTS)} from {COURSES} k cross join {OUTLINES} o " + " ".join(f"left join {p} {n} on {n}.query_id = k.query_id and {n}.item_id = o.item_id" for n, p in _PARTS.items()) + ")"
_SECTION = f"""(with p as (select * from {_ALL}), s as (select query_id, item_id, identity, {', '.join(f'{_SCALE(n)} as {n}' for n in _PARTS if n != 'identity')} from p),
  t as (select *, greatest(title, identity) as title_similarity, round(0.6::double * core + 0.4::double * outline, 9) as topic from s)
  select *, round(0.3::double * identity + 0.2::double * title_similarity + 0.2::double * topic + 0.2::double * bm25 + 0.1::double * remarks, 9) as hybrid from t)"""
_SHOWN = ("identity", "title_similarity", "topic", "core", "outline", "bm25", "remarks", "hybrid")


def sections(spark):
    topic, content = course_views()
    c = frame(spark, "courses").select("query_id", T.nfkc(F.coalesce("title", F.lit(""))).alias("title"), T.nfkc(topic).alias("topic"), T.nfkc(content).alias("content"))
    r = F.col("record")
    o = outlined(spark).select("item_id", *(T.nfkc(T.as_text(r[n], RECORD[n].dataType)).alias(n) for n in RECORD.names))
    asked = index.field_postings(c, "query_id", {"title": F.col("title"), "core": F.col("topic"), "outline": F.col("topic"), "remarks": F.col("content")}, 2, 4, False)
    held = index.field_postings(o, "item_id", {"title": F.col("subject_name"), "core": F.col("core_knowledge"), "outline": F.col("outline"), "remarks": F.col("remarks")}, 2, 4, False)
    n = o.count()
    scored = index.tfidf_pairs(asked, index.tfidf_weights(held, n, ["field"]), ["field"])
    weighted = o.select("item_id", views.weighted_document({"subject_name": 2, "core_knowledge": 2, "outline": 2, "remarks": 1}).alias("text"))
    bm25 = index.weighted_pairs(index.postings(c, "query_id", F.col("content"), 2), index.bm25_weights(index.postings(weighted, "item_id", F.col("text"), 2), n))
    courses, outlines = named(spark)
    exact = courses.join(outlines, "key").select("query_id", "item_id", F.lit(1.0).alias("score"))
    every = rank.fill_zero(scored.where("field = 'title'"), courses, outlines, 10)  # so that ten candidates are ranked
    return hybrid.section_hybrid(identity=exact, title=every, **{f: scored.where(F.col("field") == f) for f in ("core", "outline", "remarks")}, bm25=bm25)


def _best(relation_: str, by: str = "query_id") -> str:
    return f"(select *, row_number() over (partition by {by} order by score desc, item_id) as rank from {relation_} qualify rank <= 10)"


@query(f"select query_id, item_id, rank, {', '.join(f'round({n}, 6) as {n}' for n in _SHOWN)} from {_best(f'(select *, hybrid as score from {_SECTION})')}")
def section_hybrid(spark, d):
    return rank.top_k(sections(spark), 10, score="hybrid").select("query_id", "item_id", "rank", *(F.round(n, 6).alias(n) for n in _SHOWN))


_METHODS = f"(with s as (select * from {_SECTION}) select query_id, item_id, 'title_identity' as method, identity as score from s union all select query_id, item_id, 'topic_only', topic from s union all select query_id, item_id, 'content_topic', round(0.55::double * topic + 0.35::double * bm25 + 0.1::double * remarks, 9) from s union all select query_id, item_id, 'hybrid', hybrid from s)"


@query(f"with r as (select m.*, x.score is not null as hit from {_best(_METHODS, 'method, query_id')} m left join {_EXACT} x using (query_id, item_id)), q as (select method, query_id, max(case when rank = 1 and hit then 1 else 0 end) as one, max(case when hit then 1 else 0 end) as ten from r group by all) select method, count(*) as queries, sum(one)::bigint as top1_hits, sum(ten)::bigint as top10_hits from q group by method")
def section_ablation(spark, d):
    s = sections(spark)
    ranked = rank.top_k(hybrid.section_methods(s), 10, by=("method", "query_id")).join(s.select("query_id", "item_id", (F.col("identity") > 0).alias("hit")), ["query_id", "item_id"])
    return rank.method_metrics(ranked, frame(spark, "courses")).select("method", "queries", "top1_hits", "top10_hits")


_DUP = f"(select item_id, count(*) over (partition by {key('subject')}) > 1 as dup from {OUTLINES})"
_STATUS = "case when identity = 1 and not dup and score >= 0.55 then 'exact' when identity = 1 or margin < 0.05 or score >= 0.35 then 'ambiguous' else 'weak' end"
_SECTION_STATUS = f"(with r as (select * from {_best(f'(select *, hybrid as score from {_SECTION})')}), m as (select *, round(score - coalesce(lead(score) over (partition by query_id order by rank), 0), 9) as margin from r) select query_id, item_id, rank, score, margin, {_STATUS} as status from m join {_DUP} using (item_id))"


def section_statuses(spark):
    _, outlines = named(spark)
    r = rank.top_k(sections(spark), 10, score="hybrid").withColumn("margin", F.round(rank.margin("last_zero", "hybrid"), 9)).join(outlines.select("item_id", "duplicate"), "item_id")
    return r.select("query_id", "item_id", "rank", F.col("hybrid").alias("score"), "margin", rank.status(F.col("identity") > 0, F.col("duplicate"), F.col("hybrid"), F.col("margin")).alias("status"))


@query(f"select query_id, item_id, rank, round(score, 6) as score, round(margin, 6) as margin, status from {_SECTION_STATUS}")
def section_status(spark, d):
    return section_statuses(spark).withColumns({c: F.round(c, 6) for c in ("score", "margin")})


@query(f"select query_id, item_id, status, null::varchar as reviewer_decision, 'unreviewed' as review_status from {_SECTION_STATUS} where rank = 1 and status <> 'exact'")
def section_review_queue(spark, d):
    return audit.review_queue(section_statuses(spark).where("rank = 1").select("query_id", "item_id", "status"), F.col("status") != "exact")


_DOCS = f"(select item_id, concat_ws(' ', subject, core, outline, remarks) as doc from {_FIELDS})"
_COURSE_TEXT = f"(select query_id, title || ' ' || topic || ' ' || content as text from (select query_id, coalesce(title, '') as title, topic, content from {_VIEWS}))"
_CHUNK_LEX = S.tfidf(S.postings(f"(select query_id * 100 + chunk_no as id, {nf('text')} as text from {CHUNKS})", "id", "text", 2, 4, whole=False), S.postings(f"(select item_id as id, {nf('doc')} as text from {_DOCS})", "id", "text", 2, 4, whole=False), _N)
_CHUNK_DENSE = f"(select query_id, chunk_no, item_id, round(list_dot_product(c.vector, o.vector), 9) as score from {CHUNKS} c cross join {OUTLINES} o)"
_MEAN = f"(select query_id, list(x order by i) as vector from (select query_id, i, avg(x) as x from (select query_id, unnest(vector) as x, generate_subscripts(vector, 1) as i from {CHUNKS}) group by all) group by query_id)"
_CHUNK_HYBRID = f"""(with p as (select k.query_id, o.item_id, coalesce(e.score, 0) as identity, coalesce(c.score, 0) as course, coalesce(x.score, 0) as chunk, coalesce(round(list_dot_product(m.vector, o.vector), 9), 0) as mean, coalesce(n.score, 0) as near, n.evidence_chunk
    from {COURSES} k cross join {OUTLINES} o left join {_EXACT} e using (query_id, item_id) left join {_cos(_COURSE_TEXT, 'text', _DOCS, 'doc')} c using (query_id, item_id)
    left join (select query_id // 100 as query_id, item_id, max(score) as score from {_CHUNK_LEX} group by all) x using (query_id, item_id) left join {_MEAN} m using (query_id)
    left join (select query_id, item_id, max(score) as score, arg_min(chunk_no, (-score, chunk_no)) as evidence_chunk from {_CHUNK_DENSE} group by all) n using (query_id, item_id)),
  a as (select query_id, item_id, identity, chunk, evidence_chunk, {', '.join(f'{_SCALE(n)} as {n}' for n in ('course', 'mean', 'near'))}, {_SCALE('chunk')} as s_chunk from p),
  b as (select *, 0.65::double * course + 0.35::double * s_chunk as l, 0.5::double * mean + 0.5::double * near as d from a),
  c as (select query_id, item_id, identity, chunk, evidence_chunk, round(course, 9) as course, {_SCALE('l')} as lexical, {_SCALE('d')} as dense from b),
  g as (select *, row_number() over (partition by query_id order by course desc, item_id) as gate from c qualify gate <= 5)
  select *, round(0.2::double * identity + 0.4::double * lexical + 0.4::double * dense, 9) as score from g)"""


def chunk_hybrid(spark, gate=5):
    topic, content = course_views()
    c = frame(spark, "courses").select("query_id", T.nfkc(F.concat_ws(" ", F.coalesce("title", F.lit("")), topic, content)).alias("text"))
    r = F.col("record")
    o = outlined(spark).select("item_id", "vector", T.nfkc(F.concat_ws(" ", *(T.as_text(r[n], RECORD[n].dataType) for n in RECORD.names))).alias("text"))
    pieces = frame(spark, "chunks").withColumn("cid", F.col("query_id") * 100 + F.col("chunk_no"))
    weights = index.tfidf_weights(index.postings(o, "item_id", F.col("text"), 2, 4, False), o.count())
    course = index.tfidf_pairs(index.postings(c, "query_id", F.col("text"), 2, 4, False), weights)
    of_chunk = lambda pairs: pairs.select(F.floor(F.col("query_id") / 100).cast("long").alias("query_id"), (F.col("query_id") % 100).alias("chunk_no"), "item_id", "score")
    lexical = of_chunk(index.tfidf_pairs(index.postings(pieces.withColumn("text", T.nfkc(F.col("text"))), "cid", F.col("text"), 2, 4, False), weights))
    dense = of_chunk(index.dense_pairs(pieces, o, "cid", "item_id"))
    means = index.packed_vector(index.mean_vector(pieces, "query_id", "vector"), "query_id")
    mean = index.dense_pairs(means, o, "query_id", "item_id")
    courses, outlines = named(spark)
    exact = courses.join(outlines, "key").select("query_id", "item_id", F.lit(1.0).alias("score"))
    return hybrid.chunk_dense_hybrid(exact, rank.fill_zero(course, courses, outlines, 10), lexical, mean, dense, gate)


@query(f"select query_id, item_id, rank, identity, round(lexical, 6) as lexical, round(dense, 6) as dense, round(chunk, 6) as chunk_max, c.section as evidence_section, c.text as evidence_text, round(score, 6) as hybrid, round(score - coalesce(lead(score) over (partition by query_id order by rank), score), 6) as margin from {_best(_CHUNK_HYBRID)} b left join (select query_id, chunk_no as evidence_chunk, section, text from {CHUNKS}) c using (query_id, evidence_chunk)")
def chunk_dense_hybrid(spark, d):
    r = rank.top_k(chunk_hybrid(spark), 10, score="hybrid").withColumn("margin", rank.margin("last_self", "hybrid"))
    spans = frame(spark, "chunks").select("query_id", F.col("chunk_no").alias("evidence_chunk"), F.col("section").alias("evidence_section"), F.col("text").alias("evidence_text"))
    found = r.join(spans, ["query_id", "evidence_chunk"], "left")
    return found.select("query_id", "item_id", "rank", "identity", *(F.round(c, 6).alias(c) for c in ("lexical", "dense", "chunk_max")), "evidence_section", "evidence_text", *(F.round(c, 6).alias(c) for c in ("hybrid", "margin")))


# ---------------------------------------------------------------- topic coverage

MOST_FEATURES = 60
_UNITS = f"(select query_id * 100 + chunk_no as id, text from {CHUNKS} union all select 100000 + item_id * 100 + i, u from (select item_id, unnest(core) as u, generate_subscripts(core, 1) as i from {OUTLINES}))"
_UPOST = S.postings(_UNITS, "id", "text", 2, 5, whole=False, normalise=False)
_JOINT = f"""(with p as (select * from {_UPOST}), v as (select gram from p group by gram order by sum(tf) desc, gram limit {MOST_FEATURES}), k as (select p.* from p semi join v using (gram)),
  idf as (select gram, ln((1.0::double + (select count(*) from {_UNITS})) / (1.0::double + count(*))) + 1.0::double as idf from k group by gram), w as (select id, gram, tf * idf as raw from k join idf using (gram)), n as (select id, sqrt(sum(raw * raw)) as norm from w group by id),
  u as (select id, gram, raw / norm as w from w join n using (id)) select a.id as chunk, b.id as item, round(sum(a.w * b.w), 9) as score from u a join u b using (gram) where a.id < 100000 and b.id >= 100000 group by all)"""
_LANE = f"(select query_id, chunk_no, case when {' or '.join(f'regexp_matches(text, {chr(39)}(?i){p}{chr(39)})' for p in chunk.CONTAMINATION.values())} then 'contamination' else 'content' end as lane from {CHUNKS})"
_CELLS = f"""(select c.query_id, c.item_id, k.chunk_no, u.i as item_no, l.lane, coalesce(j.score, 0) as lexical, round(list_dot_product(k.vector, o.vector), 9) as dense from {CANDIDATES} c join {CHUNKS} k using (query_id) join {OUTLINES} o using (item_id) join (select item_id, unnest(core) as u, generate_subscripts(core, 1) as i from {OUTLINES}) u using (item_id)
  join {_LANE} l using (query_id, chunk_no) left join {_JOINT} j on j.chunk = c.query_id * 100 + k.chunk_no and j.item = 100000 + c.item_id * 100 + u.i)"""


def cells(spark):
    """Lexical and dense scores of each chunk and core item of the candidate pairs, and the chunks' lanes."""
    pieces = frame(spark, "chunks")
    items = frame(spark, "outlines").select("item_id", "vector", F.posexplode("core").alias("item_no", "text")).withColumn("item_no", F.col("item_no") + 1)
    left, right = pieces.select((F.col("query_id") * 100 + F.col("chunk_no")).alias("id"), "text"), items.select((F.lit(100_000) + F.col("item_id") * 100 + F.col("item_no")).alias("id"), "text")
    units = left.unionByName(right)
    posted = index.postings(units, "id", F.col("text"), 2, 5, False, normalise=False)
    kept = posted.join(index.most_used(posted, MOST_FEATURES).select("gram"), "gram", "left_semi")
    w = index.tfidf_weights(kept, units.count())
    joint = index.weight_products(w.join(left.select("id"), "id", "left_semi"), w.join(right.select("id"), "id", "left_semi"))
    pairs = frame(spark, "candidates").select("query_id", "item_id").join(pieces.select("query_id", "chunk_no", F.col("vector").alias("a")), "query_id").join(items.select("item_id", "item_no", F.col("vector").alias("b")), "item_id")
    ids = pairs.withColumns({"left_id": F.col("query_id") * 100 + F.col("chunk_no"), "right_id": F.lit(100_000) + F.col("item_id") * 100 + F.col("item_no")})
    keys = [F.col("query_id").alias("record_id"), F.col("item_id").alias("candidate_id"), F.col("chunk_no").alias("chunk_id"), F.col("item_no").alias("item_id")]
    found = ids.join(joint, ["left_id", "right_id"], "left")
    lexical = found.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"))
    dense = found.select(*keys, F.round(index.dot(F.col("a"), F.col("b")), 9).alias("score"))
    lanes = pieces.select(F.col("query_id").alias("record_id"), F.col("chunk_no").alias("chunk_id"), chunk.lane(chunk.contamination(F.col("text"))).alias("lane"))
    return lexical, dense, lanes


MODES = ("all", "content_only", "downweight")
_MODE_CELLS = f"(select m.mode, x.*, round((lexical + dense) / 2 * case when m.mode = 'downweight' and lane = 'contamination' then 0.25::double else 1 end, 9) as score from {_CELLS} x, (values ('all'), ('content_only'), ('downweight')) m(mode) where m.mode <> 'content_only' or lane = 'content')"


@query(f"select mode, query_id as record_id, item_id as candidate_id, chunk_no as chunk_id, item_no::bigint as item_id, round(score, 6) as score from {_MODE_CELLS}")
def topic_matrix(spark, d):
    lexical, dense, lanes = cells(spark)
    out = None
    for mode in MODES:
        part = coverage.matrix(lexical, dense, lanes, mode).select(F.lit(mode).alias("mode"), "record_id", "candidate_id", "chunk_id", F.col("item_id").cast("long").alias("item_id"), F.round(F.round("score", 9), 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"select query_id as record_id, item_id as candidate_id, chunk_no as chunk_id, item_no::bigint as item_id, round(score, 6) as score, match_rank from (select *, row_number() over (partition by query_id, item_id order by score desc, chunk_no, item_no) as match_rank from (select * from {_MODE_CELLS} where mode = 'all' and score >= 0.42)) where match_rank <= 5")
def topic_matches(spark, d):
    lexical, dense, _ = cells(spark)
    best = coverage.best_matches(coverage.matrix(lexical, dense).withColumn("score", F.round("score", 9)), 0.42)
    return best.select("record_id", "candidate_id", "chunk_id", F.col("item_id").cast("long").alias("item_id"), F.round("score", 6).alias("score"), "match_rank")


_COVER = f"""(with x as (select * from {_MODE_CELLS} where mode = 'all'), i as (select query_id, item_id, avg((best >= 0.42)::int) as a from (select query_id, item_id, item_no, max(score) as best from x group by all) group by all), c as (select query_id, item_id, avg((best >= 0.42)::int) as b from (select query_id, item_id, chunk_no, max(score) as best from x group by all) group by all),
  m as (select query_id, item_id, max(lexical) as lexical, max(dense) as dense from x group by all)
  select c0.query_id, c0.item_id, c0.score as identity, coalesce(m.lexical, 0) as lexical, coalesce(m.dense, 0) as dense, floor((round(round(coalesce(a, 0), 6) * 1000000)::bigint + round(round(coalesce(b, 0), 6) * 1000000)::bigint + 1) / 2) / 1000000.0::double as coverage from {CANDIDATES} c0 left join i using (query_id, item_id) left join c using (query_id, item_id) left join m using (query_id, item_id))"""


def covered(spark):
    """query_id, item_id and the four components: candidate score, lexical and dense maxima, coverage at 0.42."""
    lexical, dense, _ = cells(spark)
    pair = ["record_id", "candidate_id"]
    counts = lexical.groupBy(*pair).agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("item_id").alias("n_items"))
    share = coverage.bidirectional(coverage.matrix(lexical, dense).withColumn("score", F.round("score", 9)), counts, (0.42,)).select(*pair, F.col("bidirectional").alias("coverage"))
    most = lambda df, n: df.groupBy(*pair).agg(F.max("score").alias(n))
    base = frame(spark, "candidates").select(F.col("query_id").alias("record_id"), F.col("item_id").alias("candidate_id"), F.col("score").alias("identity"))
    out = base.join(most(lexical, "lexical"), pair, "left").join(most(dense, "dense"), pair, "left").join(share, pair, "left")
    return out.select(F.col("record_id").alias("query_id"), F.col("candidate_id").alias("item_id"), "identity", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lexical", "dense", "coverage")))


PARTS = ("identity", "lexical", "dense", "coverage")


@query(f"select query_id, item_id, rank, {', '.join(f'round({c}, 6) as {c}' for c in PARTS)}, round(score, 6) as score from {_best(f'(select *, round(0.2::double * identity + 0.25::double * lexical + 0.25::double * dense + 0.3::double * coverage, 9) as score from {_COVER})')}")
def topic_rerank(spark, d):
    scored = covered(spark).withColumn("score", F.round(coverage.rerank_score(dict(zip(PARTS, coverage.WEIGHTS["current"]))), 9))
    return rank.top_k(scored, 10).select("query_id", "item_id", "rank", *(F.round(c, 6).alias(c) for c in (*PARTS, "score")))


_CONFIGS = ", ".join(f"('{n}', {', '.join(f'{x}::double' for x in w)})" for n, w in coverage.WEIGHTS.items())


@query(f"with s as (select c.config, query_id, item_id, round(c.a * identity + c.b * lexical + c.c * dense + c.d * coverage, 9) as score from {_COVER}, (values {_CONFIGS}) c(config, a, b, c, d)), r as (select s.*, x.score is not null as hit, row_number() over (partition by config, query_id order by s.score desc, item_id) as rank from s left join {_EXACT} x using (query_id, item_id) qualify rank <= 10), q as (select config, query_id, max((rank = 1 and hit)::int) as one, max(hit::int) as ten from r group by all) select config, count(*) as queries, sum(one)::bigint as top1, sum(ten)::bigint as top10 from q group by config")
def rerank_metrics(spark, d):
    courses, outlines = named(spark)
    exact = courses.join(outlines, "key").select("query_id", "item_id", F.lit(True).alias("exact"))
    return hybrid.config_metrics(covered(spark).join(exact, ["query_id", "item_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(False))), coverage.WEIGHTS, PARTS)


# ---------------------------------------------------------------- headings, lanes, audits

_HEAD = texts.ATOMIC.replace(f"from documents) where {S.strip('l')} <> ''", f"from {LINES}) where {S.strip('l')} <> ''")


@query(f"select id, position::bigint as position, level::bigint as level, marker, chapter, topic, text from {_HEAD}")
def heading_units(spark, d):
    return chunk.atomic_topics(frame(spark, "lines"), "doc_id", F.col("text")).select("id", "position", "level", "marker", "chapter", "topic", "text")


@query(f"select id, position::bigint as position, array_to_string({texts.FLAGS}, ',') as labels, case when len({texts.FLAGS}) > 0 then 'contamination' else 'content' end as lane from {_HEAD}")
def heading_lanes(spark, d):
    units = chunk.atomic_topics(frame(spark, "lines"), "doc_id", F.col("text"))
    labels = chunk.contamination(F.col("text"))
    return units.select("id", "position", F.array_join(labels, ",").alias("labels"), chunk.lane(labels).alias("lane"))


@query(f"with u as (select id, text, chapter, coalesce(topic, '') as topic, array_to_string({texts.FLAGS}, ',') as labels, position from {_HEAD}) select l.doc_id, case when u.id is null then 'present_but_no_atomic_split' else 'extracted' end as status, 'A-' || substr(sha256(l.doc_id || '|text|' || coalesce(u.position::varchar, '∅')), 1, 20) as chunk_id, u.chapter, u.text, coalesce(u.labels, '') as labels from (select * from {LINES} where coalesce(text, '') <> '') l left join u on u.id = l.doc_id")
def atomised_records(spark, d):
    lines = frame(spark, "lines").where(T.nonempty(F.col("text")))
    return chunk.atomised(lines, "doc_id", F.col("text"), "text").select("doc_id", "status", "chunk_id", "chapter", "text", "labels")


@query(f"select query_id as id, section, 0::bigint as section_index, query_id || '-' || section || '-000' as chunk_id, text as chunk from (select query_id, 'description' as section, {S.collapse('description')} as text from {COURSES} union all select query_id, 'outline', {S.collapse('outline')} from {COURSES} union all select query_id, 'objectives', {S.collapse('objectives')} from {COURSES}) where coalesce(text, '') <> ''")
def section_chunk_rows(spark, d):
    rows = chunk.section_chunks(frame(spark, "courses"), "query_id", {n: F.col(n) for n in ("description", "outline", "objectives")})
    return rows.withColumn("section_index", F.col("section_index").cast("long"))


@query(f"select field, string_agg(distinct type, ',' order by type) filter (type <> 'null') as types, count(distinct type) filter (type <> 'null') > 1 as drifts from {relation('observed')} group by field")
def type_drift(spark, d):
    return profile.type_drift(frame(spark, "observed")).withColumn("types", F.nullif("types", F.lit("")))


@query(f"select a.artifact, f.path is not null as present, coalesce(f.sha256 = lower(a.sha256), false) as hash_verified from {relation('artifacts')} a left join (select regexp_replace(path, '^file:/*', '/') as path, sha256 from {relation('files')}) f on f.path = a.artifact")
def artifact_check(spark, d):
    return io.verify_artifacts(frame(spark, "artifacts"), frame(spark, "files"))


_DECLARED = ("url", "raw_sha256", "status", "flag")


@query(" union all ".join(f"select '{f}' as field, count({f}) as non_null_count, count(*) filter ({S.strip(f)} = '') as blank_count from {COURSES}" for f in _DECLARED))
def provenance_completeness(spark, d):
    return profile.field_profile(frame(spark, "courses"), _DECLARED).select("field", F.col("nonnull_count").alias("non_null_count"), "blank_count")


@query(f"select count(*) as records, count(*) filter (status = 'verified') as hash_verified, count(*) filter (status = 'mismatch') as hash_mismatch, count(*) filter (coalesce(url, '') = '') as url_missing, count(*) filter (status is null) as status_null, count(*) filter (coalesce(description, '') = '') as zero_content from {COURSES}")
def lanes_manifest(spark, d):
    return audit.lanes_manifest(frame(spark, "courses"), {"hash_verified": F.col("status") == "verified", "hash_mismatch": F.col("status") == "mismatch", "url_missing": ~T.nonempty(F.col("url")), "status_null": F.col("status").isNull(), "zero_content": ~T.nonempty(F.col("description"))})


@query(f"select {', '.join(f'count(*) filter (coalesce({c}, {chr(39) * 2}) <> {chr(39) * 2}) as {c}' for c in ('description', 'outline', 'objectives'))} from {COURSES}")
def presence_sums(spark, d):
    return profile.presence_sums(frame(spark, "courses"), ("description", "outline", "objectives"))


@query(f"select o.item_id as excluded_id, 'types_missing' as reason, 'excluded' as scope from {OUTLINES} o where coalesce(len(types), 0) = 0 union all select item_id, 'source_missing', 'excluded' from {OUTLINES} where coalesce(source, '') = ''")
def exclusion_manifest(spark, d):
    return audit.exclusions(frame(spark, "outlines"), "item_id", {"types_missing": ~T.nonempty(F.col("types"), "array"), "source_missing": ~T.nonempty(F.col("source"))})


_LEFT = f"(select {key('title')} as t, nullif(lower({S.strip('raw_sha256')}), '') as h from {COURSES})"
_RIGHT = f"(select {key('subject')} as t, 'cd34' as h from {OUTLINES})"


@query(f"select (select count(*) from (select t from {_LEFT} intersect select t from {_RIGHT})) as shared_titles, (select count(*) from (select h from {_LEFT} where h is not null intersect select h from {_RIGHT})) as shared_hashes, (select count(*) from {_LEFT} where t in (select t from {_RIGHT})) as left_records, (select count(*) from {_RIGHT} where t in (select t from {_LEFT})) as right_records, 'do_not_replace' as decision")
def replacement_decision(spark, d):
    courses, outlines = named(spark)
    left = courses.select(F.col("key").alias("title"), T.lookup_hash(F.col("raw_sha256")).alias("hash"))
    return audit.replacement(left, outlines.select(F.col("key").alias("title"), F.lit("cd34").alias("hash")))


@query(f"select {S.key('department')} is not null as grouped, query_id, title, row_number() over (order by coalesce(department, ''), query_id) as line from {COURSES}")
def sorted_courses(spark, d):
    rows = audit.in_global_order(frame(spark, "courses").withColumn("department", F.coalesce("department", F.lit(""))), "department", "query_id", name="line")
    return rows.select(F.lit(True).alias("grouped"), "query_id", "title", "line")


@query(f"select department_ as category, query_id, sample_no from (select coalesce(status, '<missing>') as department_, query_id, row_number() over (partition by coalesce(status, '<missing>') order by query_id) as sample_no from {COURSES}) where sample_no <= 2")
def status_samples(spark, d):
    rows = frame(spark, "courses").select(F.coalesce("status", F.lit("<missing>")).alias("category"), "query_id")
    return audit.samples(rows, "category", "query_id", 2).withColumn("sample_no", F.col("sample_no").cast("long"))


@query(f"select 'outlines' as check_name, count(*) = 8 as passed from {OUTLINES} union all select 'titles_present', bool_and(coalesce(title, '') <> '') from {COURSES} union all select 'verified_only', bool_and(coalesce(status = 'verified', false)) from {COURSES}")
def scope_validation(spark, d):
    courses, outlines = frame(spark, "courses"), frame(spark, "outlines")
    return audit.scope({"outlines": (outlines, F.count("*") == 8), "titles_present": (courses, F.bool_and(T.nonempty(F.col("title")))), "verified_only": (courses, F.bool_and(F.coalesce(F.col("status") == "verified", F.lit(False))))})
