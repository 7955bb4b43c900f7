"""Text normalisation as column expressions.

``\\w`` and ``\\s`` mean ASCII in Java's regular expressions, so classes are spelt with Unicode properties. NFKC has no
built-in: ``compatible`` maps every character whose NFKC form is one character, which covers full-width text;
``nfkc`` is the exact form, an Arrow UDF for columns that need it.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType

# The typographic punctuation that is folded, semesters, degrees, and words of two department families.
PUNCTUATION = {"（": "(", "）": ")", "［": "[", "］": "]", "【": "[", "】": "]", "，": ",", "：": ":", "；": ";", "／": "/", "－": "-", "–": "-", "—": "-"}
SEMESTERS = {"上學期": "1", "第一學期": "1", "1": "1", "下學期": "2", "第二學期": "2", "2": "2"}
SEMESTERS_WIDE = {"1": "1", "上學期": "1", "上半年": "1", "firstsemester": "1", "2": "2", "下學期": "2", "下半年": "2", "secondsemester": "2"}
DEGREES = {"bachelor": "bachelor", "undergraduate programme": "bachelor", "undergraduate program": "bachelor", "master": "master", "碩士": "master", "學士": "bachelor"}
ADMINISTRATIVE = ("行政", "法律", "政治", "經濟", "財政", "會計", "人事", "社會", "教育", "公共", "地政", "外交", "新聞", "文化", "勞工", "金融")
TECHNICAL = ("資工", "資訊", "電機", "電子", "機械", "土木", "化學", "生物", "醫", "環境", "材料", "建築", "工程", "農", "食品", "物理", "數學", "統計", "地質")

SPACE = r"[\s\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}_]"


@functools.cache
def _single_forms() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and ord(b) < 0x10000]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def compatible(text: Column) -> Column:
    return F.translate(text, *_single_forms())


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}|(?<![\s\p{{Z}}]){SPACE}$", "")


def collapse(text: Column) -> Column:
    """White space runs become one space, ends are stripped; case is kept."""
    return strip(F.regexp_replace(text, SPACE, " "))


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def raw_text(value: Column) -> Column:
    return F.coalesce(strip(value.cast("string")), F.lit(""))


def display(value: Column) -> Column:
    """Folded punctuation, single spaces, folded case."""
    return casefold(collapse(F.translate(raw_text(value), "".join(PUNCTUATION), "".join(PUNCTUATION.values()))))


def canonical_key(value: Column) -> Column:
    return F.regexp_replace(display(value), r"[\s\p{Z}\-_,;:()\[\]/]+", "")


def norm_key(value: Column) -> Column:
    """Letters, digits and underscores alone, case folded; null is empty."""
    return F.regexp_replace(casefold(F.coalesce(value.cast("string"), F.lit(""))), NOT_WORD, "")


def code(value: Column) -> Column:
    return F.upper(F.regexp_replace(display(value), SPACE, ""))


def topic_norm(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), SPACE, " "), r"^[ \t\r\n,，;；:：]+|[ \t\r\n,，;；:：]+$", "")


def mapped(value: Column, table: dict[str, str]) -> Column:
    """A fixed lookup that passes other values through."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[value], value)


def semester(value: Column) -> Column:
    return mapped(display(value), SEMESTERS)


def semester_wide(value: Column) -> Column:
    return mapped(norm_key(value), SEMESTERS_WIDE)


def degree(value: Column) -> Column:
    return mapped(display(value), DEGREES)


def department_family(department: Column) -> Column:
    any_of = lambda words: functools.reduce(lambda a, b: a | b, (department.contains(w) for w in words))
    return F.when(any_of(TECHNICAL), "technical_candidate").when(any_of(ADMINISTRATIVE), "administrative_candidate").otherwise("unknown")


def type_family(types: Column) -> Column:
    """Sorted labels of an array of type names."""
    return F.array_sort(F.array_compact(F.array(
        F.when(F.exists(types, lambda t: t.contains("行政")), F.lit("administrative_candidate")),
        F.when(F.exists(types, lambda t: t.contains("技術")), F.lit("technical_candidate")),
    )))


def parse_bool(value: Column) -> Column:
    return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)


def lookup_hash(value: Column) -> Column:
    return F.nullif(F.lower(strip(value)), F.lit(""))


def content_id(prefix: str, *fields: Column, size: int = 20) -> Column:
    """A content address of the fields in order; null differs from empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("∅")) for f in fields)), 256), 1, size))


def canonical_json(value: Column, kind: DataType) -> Column:
    """Text of a value as JSON with sorted keys, a space after commas and colons, and other scripts as they are."""
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    if isinstance(kind, ArrayType):
        inner = F.transform(value, lambda x: canonical_json(x, kind.elementType))
        found = F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    elif isinstance(kind, StructType):
        parts = [F.concat(F.lit(f'"{f.name}": '), canonical_json(value[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        found = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, StringType):
        found = quoted(value)
    else:
        found = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(found)


def as_text(value: Column, kind: DataType) -> Column:
    """Null is empty, arrays and structs are canonical JSON, other values their text."""
    if isinstance(kind, (ArrayType, StructType)):
        return F.when(value.isNull(), "").otherwise(canonical_json(value, kind))
    if isinstance(kind, BooleanType):
        return F.when(value, "True").when(~value, "False").otherwise("")
    return F.coalesce(value.cast("string"), F.lit(""))


def json_id(prefix: str, record: Column, kind: StructType, size: int = 20) -> Column:
    """The content address of a record: the first digits of the SHA-256 of its canonical JSON."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(record, kind), 256), 1, size))


def retrieval_key(value: Column) -> Column:
    """``norm_key`` after exact NFKC; false and 0 as text are kept, null is empty."""
    return norm_key(nfkc(F.coalesce(value.cast("string"), F.lit(""))))


def identity_key(value: Column, kind: DataType | None = None) -> Column:
    """``retrieval_key`` in which a number 0 and a false flag are empty, as an absent value is."""
    if kind is not None and not isinstance(kind, StringType):
        value = F.when(value.cast("boolean"), value)
    return retrieval_key(value)


def nonempty(value: Column, kind: str = "string") -> Column:
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull() & (value.cast("string") != "") if kind == "string" else value.isNotNull()


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def grams(key: Column, low: int, high: int | None = None, whole_if_short: bool = True) -> Column:
    """Character n-grams with repetition, for n from ``low`` to ``high``.

    One pass of a regular expression that consumes a character and looks ahead at n; code points are never cut. A key
    no longer than n is one gram (``whole_if_short``), or has none of that n when it is shorter.
    """
    length, none = F.length(key), F.array().cast("array<string>")

    def of(n: int) -> Column:
        found = F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
        if whole_if_short:
            return F.when(length == 0, none).when(length <= n, F.array(key)).otherwise(found)
        return found

    parts = [of(n) for n in range(low, (high or low) + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def extract_section(text: Column, starts: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """What follows the first start label, up to the first stop label after it."""
    return F.regexp_extract(text, rf"(?is)(?:{'|'.join(starts)})(.*?)(?:{'|'.join(stops)}|\z)", 1)
