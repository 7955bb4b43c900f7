"""SQL fragments for the oracles, written apart from the column expressions they check."""

from __future__ import annotations

EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
SPACE = r"[\s\p{Z}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE}', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}', ' ', 'g')")


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def display(x: str) -> str:
    return fold(collapse(f"translate({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '（）［］【】，：；／－–—', '()[][],:;/---')"))


def canonical(x: str) -> str:
    return rf"regexp_replace({display(x)}, '[\s\p{{Z}}\-_,;:()\[\]/]+', '', 'g')"


def key(x: str) -> str:
    return rf"regexp_replace({fold(f'coalesce({x}, {chr(39)}{chr(39)})')}, '[^\p{{L}}\p{{N}}_]', '', 'g')"


def topic(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '{SPACE}', ' ', 'g'), '^[ \t\r\n,，;；:：]+|[ \t\r\n,，;；:：]+$', '', 'g')"


def postings(table: str, id_column: str, text: str, low: int, high: int | None = None, whole: bool = True, normalise: bool = True) -> str:
    """(id, gram, tf): characters by position, joined with those that follow."""
    high = high or low
    k = key(text) if normalise else rf"lower(regexp_replace({text}, '\s\s+', ' ', 'g'))"
    leads = ", ".join(f"lead(c, {i}) over w as c{i}" for i in range(1, high))
    grams = " union all ".join(f"select id, {' || '.join(['c', *(f'c{i}' for i in range(1, n))])} as gram from leads" for n in range(low, high + 1))
    short = " ".join(f"union all select id, k as gram from keyed where length(k) between 1 and {n - 1}" for n in range(low, high + 1)) if whole else ""
    return f"""(with keyed as (select {id_column} as id, {k} as k from {table}), chars as (select id, unnest(str_split(k, '')) as c, generate_subscripts(str_split(k, ''), 1) as i from keyed where k <> ''),
      leads as (select id, c, {leads} from chars window w as (partition by id order by i)), grams as ({grams} {short}) select id, gram, count(*) as tf from grams where gram is not null group by all)"""


def bm25(queries: str, catalogue: str, n: str) -> str:
    """(query_id, item_id, score) of two postings relations."""
    return f"""(with q as (select * from {queries}), p as (select * from {catalogue}), n as (select ({n})::double as n),
      len as (select id, sum(tf)::double as len from p group by id), m as (select greatest(sum(tf)::double / greatest(max(n), 1), 1e-9) as mean from p, n),
      df as (select gram, count(*)::double as df from p group by gram),
      w as (select p.id, p.gram, ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean))) as w from p join len using (id) join df using (gram), n, m)
      select q.id as query_id, w.id as item_id, round(sum(q.tf * w.w), 9) as score from q join w using (gram) group by all)"""


def tfidf(queries: str, catalogue: str, n: str) -> str:
    return f"""(with q as (select * from {queries}), p as (select * from {catalogue}), n as (select ({n})::double as n),
      idf as (select gram, ln((1.0::double + max(n)) / (1.0::double + count(*))) + 1.0::double as idf from p, n group by gram),
      pw as (select id, gram, tf * idf as raw from p join idf using (gram)), pn as (select id, sqrt(sum(raw * raw)) as norm from pw group by id),
      qw as (select id, gram, tf * idf as raw from q join idf using (gram)), qn as (select id, sqrt(sum(raw * raw)) as norm from qw group by id)
      select qw.id as query_id, pw.id as item_id, round(sum(qw.raw * (pw.raw / pn.norm)) / max(qn.norm), 9) as score from qw join pw using (gram) join pn on pn.id = pw.id join qn on qn.id = qw.id group by all)"""


def ranked(pairs: str, k: int, by: str = "query_id") -> str:
    return f"(select *, row_number() over (partition by {by} order by score desc, item_id) as rank from {pairs} qualify rank <= {k})"
