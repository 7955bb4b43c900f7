"""SQL for the queries of this part that SQL can express, over whole tables."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

#: Exact Jaccard links over shared shingles, then the smallest id that links reach.
NEAR_DEDUP = rf"""
with recursive w as (select doc_id, {WORDS} as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 2 then [array_to_string(w, ' ')] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b using (shingle) where a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 80 * (na.n + nb.n - common)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a as node, a as seen from (select a from both_ways) union select r.node, l.b from reach r join both_ways l on l.a = r.seen),
component as (select node, min(seen) as component_id from reach group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join component c on c.node = d.doc_id"""

#: Every 400-byte window by its digest; windows that occur twice cover bytes; runs of covered bytes are cut out.
SUFFIX_DEDUP = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
blocks as (select doc_id, n, unnest(range(0, n - 399, 512)) as b, h from h where n >= 400),
cut as (select doc_id, n, b, substring(h, 2 * b + 1, 1824) as part from blocks),
windows as (select doc_id, b, unnest(range(b, least(b + 512, n - 399))) as i, part from cut),
digests as (select doc_id, i, md5(substring(part, 2 * (i - b) + 1, 800)) as m from windows),
twice as (select m from digests group by m having count(*) > 1),
starts as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap from digests semi join twice using (m)),
runs as (select doc_id, i, sum(case when gap is null or gap > 400 then 1 else 0 end) over (partition by doc_id order by i) as run from starts),
spans as (select doc_id, min(i) as b, max(i) + 400 as e from runs group by doc_id, run),
edges as (select doc_id, b, e, lag(e, 1, 0) over (partition by doc_id order by b) as before from spans),
kept as (select doc_id, sum(e - b) as removed, count(*) as n_spans, string_agg(substring(h, 2 * before + 1, 2 * (b - before)), '' order by b) as head, max(e) as last, max(h) as h from edges join h using (doc_id) group by doc_id)
select h.doc_id, h.n::bigint as n_bytes, coalesce(k.removed, 0)::bigint as n_removed, coalesce(k.n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when k.doc_id is null then h.h else k.head || substring(h.h, 2 * k.last + 1) end)) as kept_sha256
from h left join kept k using (doc_id)"""

ORACLES = {"op5_near_dedup": NEAR_DEDUP, "op6_suffix_dedup": SUFFIX_DEDUP}
