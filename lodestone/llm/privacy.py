"""Personal data: base patterns, and terms that corpus co-occurrence shows to reveal them. DataFrame functions only.

What is protected: each value of the four base kinds (lower-cased email, ip, digits of a card or phone), each group of
values (an email's domain, an ip's first three parts, a number's first digits), and each kind as such. A term is a run
of three letters or more, in lower case and outside base spans. Counts are of documents, over all N of them. With n(c)
documents that mention c, n(t) that hold t and n(t, c) that do both,

    PMI(t; c) = log(n(t, c) * N / (n(t) * n(c))),   IC(c) = log(N / n(c)),

and a term discloses c if one of two estimates exceeds its threshold:

* near: n(t, c) counts the documents where t stands within ``CONTEXT`` code points of a mention of c, and
  PMI >= IC / ``NEAR_ALPHA``. One document is enough here, so a name that occurs beside one address only is found.
* anywhere: n(t, c) counts all documents with both, at any distance, and PMI * d >= IC / ``ALPHA``, where
  d = n(t, c) / (n(t, c) + 1) * m / (m + 1), m = min(n(t), n(c)), discounts what few documents show. Entities with the
  same documents have the same counts, so they are counted once, as a class; a class of fewer than ``least_support``
  documents can't reach the threshold whatever its counts.

In documents that mention c, the terms that disclose it are marked wherever they stand, and ``sanitise`` generalises
marked spans to ``[KIND]`` (a term to ``[TERM]``).

Defined results: a null text is an empty one, without spans, and stays null when sanitised; positions are code points
and ends are exclusive; repeated rows count as often as they occur; rows whose id is null are handled like others;
an empty table gives an empty result; ``spans`` keeps every column of its input inside ``row``, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CONTEXT = 160
ALPHA = 2.0
NEAR_ALPHA = 1.1
TERM = r"[\p{L}\p{M}]{3,}"
RUN, CHUNK = 256, 2_048

# Kinds in their order, and the patterns that define them. A run of characters that can't start a match
# is passed over at once (look-behind, or the end of the last match), and repeats that can't give back are possessive,
# so time stays in proportion to the text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.transform(
        F.split(F.reverse(number), ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$"),
    "card": lambda m: F.length(digits(m)).between(13, 19) & luhn(digits(m)),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
}
VALUE = {"email": F.lower, "ip": lambda m: m, "card": digits, "phone": digits}
GROUP = {"email": lambda v: F.substring_index(v, "@", -1), "ip": lambda v: F.substring_index(v, ".", 3), "card": lambda v: F.substring(v, 1, 6), "phone": lambda v: F.substring(v, 1, 4)}
#: What a text must hold for a kind to occur in it at all.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
}
PLACE = "array<struct<start:int,end:int,value:string>>"


# ---------------------------------------------------------------- expressions over one text


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """``merge`` of 0 and all values up to each, in runs of ``RUN``, so that time isn't square in their number."""
    fold = lambda part: F.aggregate(part, F.lit(0), merge)

    def within(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / RUN).cast("int")), lambda r: F.slice(v, r * RUN + 1, F.lit(RUN)))
        return let(runs, lambda rs: let(F.transform(rs, fold), lambda totals: F.flatten(F.transform(rs, lambda part, r: let(fold(F.slice(totals, F.lit(1), r)), lambda head: F.transform(part, lambda x, i: merge(head, fold(F.slice(part, F.lit(1), i + 1)))))))))

    return let(values, within)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(pieces: Column, begin: Column, end: Column) -> Column:
    """The text from ``begin`` to ``end`` out of its ``chunks``; only the chunks that hold it are read."""
    first = F.floor(begin / CHUNK).cast("int")
    last = F.floor((F.greatest(end, F.lit(1)) - 1) / CHUNK).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(end > begin, held.substr(begin - first * CHUNK + 1, end - begin)).otherwise("")


def places(text: Column, kind: str) -> Column:
    """array of (start, end, value) of the valid matches of ``kind``."""
    pattern = F.lit(PATTERNS[kind])

    def found(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        steps = F.zip_with(gaps, matches, lambda gap, match: F.length(gap) + F.length(match))
        ends = running(steps, lambda a, x: a + x)
        every = F.zip_with(matches, ends, lambda match, end: F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match")))
        return F.transform(F.filter(every, lambda x: VALID[kind](x["match"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), VALUE[kind](x["match"]).alias("value")))

    none = F.array().cast(PLACE)
    listed = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, found(m).cast(PLACE)).otherwise(none))
    return F.when(NEEDS[kind](text), listed).otherwise(none).cast(PLACE)


def base(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """row (the input's columns), text, found: struct of the four kinds' arrays."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), text.alias("text")).select(
        "row", "text", F.struct(*(places(F.col("text"), k).alias(k) for k in KINDS)).alias("found")
    )


def _named(places_: Column, rank: int, kind: str) -> Column:
    return F.transform(places_, lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def _listed(found: Column) -> Column:
    """(kind number, kind, start, end, value) of all kinds."""
    return F.concat(*(_named(found[k], i, k) for i, k in enumerate(KINDS)))


def _some(found: Column) -> Column:
    return (F.size(found["email"]) + F.size(found["ip"]) + F.size(found["card"]) + F.size(found["phone"])) > 0


def rewritten(text: Column, items: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``mark(item, end of earlier items)`` for each (start, rank, end, kind); what lies between is kept."""

    def whole(ordered: Column, pieces: Column) -> Column:
        reach = running(F.transform(ordered, lambda m: m["end"]), lambda a, x: F.greatest(a, x))

        def spelt(reached: Column) -> Column:
            parts = F.transform(ordered, lambda m, i: let(F.when(i > 0, F.get(reached, i - 1)).otherwise(0), lambda before: F.concat(part(pieces, before, m["start"]), mark(m, before))))
            return F.concat(F.array_join(parts, ""), part(pieces, F.element_at(reached, -1), F.length(text)))

        return let(reach, spelt)

    ordered = F.array_sort(F.transform(items, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.when(F.size(items) > 0, let(ordered, lambda o: let(chunks(text), lambda c: whole(o, c)))).otherwise(text)


def sanitised(text: Column, items: Column) -> Column:
    """``text`` with each marked span replaced by its kind; where spans overlap, the first to start gives the name."""
    return rewritten(text, items, lambda m, before: F.when(m["start"] >= before, F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]"))).otherwise(""))


def blanked(text: Column, items: Column) -> Column:
    """``text`` with spaces in the place of each marked code point."""
    return rewritten(text, items, lambda m, before: F.repeat(F.lit(" "), F.greatest(m["end"] - F.greatest(m["start"], before), F.lit(0))))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _near(pieces: Column, length: Column, start: Column, end: Column) -> Column:
    """Terms within ``CONTEXT`` code points of a mention; what the far ends cut is left out."""
    letters = r"[\p{L}\p{M}]+"
    left, right = part(pieces, F.greatest(start - CONTEXT, F.lit(0)), start), part(pieces, end, F.least(end + CONTEXT, length))
    left = F.when(start > CONTEXT, F.regexp_replace(left, f"^{letters}", "")).otherwise(left)
    right = F.when(length - end > CONTEXT, F.regexp_replace(right, f"{letters}$", "")).otherwise(right)
    return F.array_distinct(F.concat(terms(left), terms(right)))


def _protected(kind: Column, value: Column) -> Column:
    """The value, its group and its kind, as names."""
    group = F.coalesce(*(F.when(kind == k, GROUP[k](value)) for k in KINDS))
    return F.array(F.concat_ws(":", kind, value), F.concat_ws("/", kind, group), kind)


# ---------------------------------------------------------------- counts over the corpus


def least_support(alpha: float) -> int:
    """The fewest documents with which the discount lets any PMI, which is IC at most, reach IC / ``alpha``."""
    n = 1
    while (n / (n + 1)) ** 2 < 1 / alpha:
        n += 1
    return n


def _classes(held: DataFrame, least: int) -> DataFrame:
    """key, mark for entities of ``least`` documents or more; entities with the same documents share a mark.

    ``held``: key, entity. Documents are told apart by their sums of two 64-bit hashes of the key.
    """
    total = lambda seed: F.sum(F.xxhash64("key", F.lit(seed)).cast("decimal(38,0)")).alias(f"h{seed}")
    signed = held.groupBy("entity").agg(F.count("*").alias("n"), total(0), total(1)).where(F.col("n") >= least)
    named = signed.select("entity", F.concat_ws(" ", F.lit("class"), "n", "h0", "h1").alias("mark"))
    return held.join(named, "entity").select("key", "mark").distinct()


def disclosing(mentions: DataFrame, docs: DataFrame, text_column: str, alpha: float = ALPHA, near_alpha: float = NEAR_ALPHA) -> tuple[DataFrame, DataFrame]:
    """(key, mark) of what each of ``mentions`` (key, text, rest, found) mentions, and (mark, term): terms that disclose it."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rest = F.col("rest")
    of_one = lambda c: F.transform(_listed(F.col("found")), lambda m: F.struct(_protected(m["kind"], m["value"]).alias("entities"), _near(c, F.length(rest), m["start"], m["end"]).alias("near")))
    each = stored(mentions.select("key", F.explode(let(chunks(rest), of_one)).alias("m")).select("key", F.explode("m.entities").alias("entity"), "m.near"), "mentioned")
    held = stored(each.select("key", "entity").distinct(), "held")
    classes = stored(_classes(held, least_support(alpha)), "held-classes")
    own = mentions.select("key", F.explode(F.array_distinct(terms(rest))).alias("term"))
    near = each.select("key", "entity", F.explode("near").alias("term")).distinct()
    anywhere = classes.join(own, "key").groupBy("mark", "term").agg(F.count("*").alias("n_joint"), F.lit(False).alias("near"))
    beside = near.groupBy(F.col("entity").alias("mark"), "term").agg(F.count("*").alias("n_joint"), F.lit(True).alias("near"))
    # counted over all whole texts; in those with mentions, what stands in base spans alone is taken off again
    signed = lambda df, t, sign: df.select(F.explode(F.array_distinct(terms(t))).alias("term"), F.lit(sign).alias("sign"))
    words = signed(docs, text, 1).unionByName(signed(mentions, F.col("text"), -1)).unionByName(own.select("term", F.lit(1).alias("sign")))
    counts = words.groupBy("term").agg(F.sum("sign").alias("n_term"))
    sizes = held.groupBy(F.col("entity").alias("mark")).agg(F.count("*").alias("n_entity")).unionByName(classes.groupBy("mark").agg(F.count("*").alias("n_entity")))
    n = float(max(docs.count(), 1))
    scored = anywhere.where(F.col("n_joint") >= least_support(alpha)).unionByName(beside).join(sizes, "mark").join(counts, "term")
    information = F.log(F.lit(n) / F.col("n_entity"))
    pmi = F.log(F.col("n_joint") * F.lit(n) / (F.col("n_term") * F.col("n_entity")))
    least = F.least("n_term", "n_entity")
    discount = F.col("n_joint") / (F.col("n_joint") + 1) * least / (least + 1)
    reached = F.when(F.col("near"), pmi >= information / near_alpha).otherwise(pmi * discount >= information / alpha)
    flagged = scored.where((information > 0) & reached).select("mark", "term").distinct()
    marks = held.select("key", F.col("entity").alias("mark")).unionByName(classes)
    return marks, stored(flagged, "disclosing")


def _occurrences(mentions: DataFrame, marks: DataFrame, flagged: DataFrame) -> DataFrame:
    """key, terms: (start, end) of each term of a document that discloses what the document mentions."""
    rest = F.col("rest")
    words, gaps = F.regexp_extract_all(rest, F.lit(TERM), F.lit(0)), F.split(rest, TERM, -1)
    by_term = flagged.groupBy("term").agg(F.collect_set("mark").alias("reveals"))  # a term discloses few, as its documents are shared among them
    mine = marks.groupBy("key").agg(F.collect_set("mark").alias("marks"))  # what one document mentions
    distinct = mentions.select("key", F.explode(F.array_distinct(terms(rest))).alias("term"))
    told = distinct.join(by_term, "term").join(mine, "key").where(F.arrays_overlap("reveals", "marks")).select("key", "term")
    told = stored(told, "told")
    tokens = mentions.join(told.select("key").distinct(), "key", "left_semi").select("key", F.posexplode(F.arrays_zip(words.alias("word"), gaps.alias("gap"))).alias("i", "x"))
    # the gap after the last word is no word's
    tokens = tokens.where(F.col("x.word").isNotNull()).select("key", "i", F.col("x.word").alias("word"), F.length("x.word").alias("size"), F.length("x.gap").alias("before"))
    end = F.sum(F.col("before") + F.col("size")).over(Window.partitionBy("key").orderBy("i")).cast("int")
    placed = tokens.select("key", F.lower("word").alias("term"), (end - F.col("size")).alias("start"), end.alias("end"))
    hits = placed.join(told, ["key", "term"], "left_semi")
    return hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("terms"))


def spans(docs: DataFrame, text_column: str = "text", alpha: float = ALPHA, near_alpha: float = NEAR_ALPHA) -> DataFrame:
    """row (the input's columns), text, found (struct of the base kinds' places), terms (places of disclosing terms)."""
    marked = base(docs, text_column)
    none = F.array().cast("array<struct<start:int,end:int>>")
    some = marked.where(_some(F.col("found"))).withColumns({"key": F.monotonically_increasing_id(), "rest": blanked(F.col("text"), _listed(F.col("found")))})
    mentions = stored(some, "mentions")
    marks, flagged = disclosing(mentions, docs, text_column, alpha, near_alpha)
    placed = _occurrences(mentions, marks, flagged)
    with_terms = mentions.join(placed, "key", "left").select("row", "text", "found", F.coalesce("terms", none).alias("terms"))
    return marked.where(~_some(F.col("found"))).select("row", "text", "found", none.alias("terms")).unionByName(with_terms)


# ---------------------------------------------------------------- results


def listing(items: Column) -> Column:
    """kind:start:end, comma-joined, by kind in the listed order and then by start."""
    ordered = F.array_sort(F.transform(items, lambda m: F.struct(m["rank"].alias("rank"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def all_places(found: Column, terms: Column) -> Column:
    keep = lambda x: F.struct(x["rank"].alias("rank"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    return F.concat(F.transform(_listed(found), keep), F.transform(terms, lambda t: F.struct(F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"))))


def base_places(found: Column) -> Column:
    return _listed(found)


def sanitise(docs: DataFrame, text_column: str = "text", alpha: float = ALPHA, near_alpha: float = NEAR_ALPHA) -> DataFrame:
    """The input's columns, with ``text_column`` sanitised."""
    marked = spans(docs, text_column, alpha, near_alpha)
    clean = F.when(F.col(f"row.`{text_column}`").isNull(), F.lit(None)).otherwise(sanitised(F.col("text"), all_places(F.col("found"), F.col("terms"))))
    return marked.select(*((clean.alias(c) if c == text_column else F.col(f"row.`{c}`")) for c in docs.columns))
