import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first())


def test_normalisers(spark):
    x = F.col("x")
    got = one(spark, " 　Ａ（b）  Straße–1_x； ", T.raw_text(x), T.display(x), T.canonical_key(x), T.norm_key(x), T.code(x), T.topic_norm(x))
    assert got == ("Ａ（b）  Straße–1_x；", "ａ(b) strasse-1_x;", "ａbstrasse1x", "ａbstrasse1_x", "Ａ(B)STRASSE-1_X;", "Ａ（b） Straße–1_x")
    assert one(spark, None, T.raw_text(x), T.norm_key(x), T.display(x), T.topic_norm(x)) == ("", "", "", "")
    assert one(spark, "ＡＢ　１", T.compatible(x)) == ("AB 1",)


def test_lookups(spark):
    x = F.col("x")
    assert one(spark, "上學期", T.semester(x), T.semester_wide(x), T.degree(x)) == ("1", "1", "上學期")
    assert one(spark, "Second Semester", T.semester_wide(x), T.semester(x)) == ("2", "second semester")
    assert one(spark, "Undergraduate  Program", T.degree(x)) == ("bachelor",)
    assert one(spark, "資訊行政", T.department_family(x)) == ("technical_candidate",)
    assert one(spark, "財政", T.department_family(x)) == ("administrative_candidate",)
    assert one(spark, ["行政類", "技術類"], T.type_family(x), kind="array<string>") == (["administrative_candidate", "technical_candidate"],)
    assert one(spark, "TRUE", T.parse_bool(x)) == (True,) and one(spark, "yes", T.parse_bool(x)) == (None,)
    assert one(spark, " ", T.lookup_hash(x)) == (None,) and one(spark, " AB ", T.lookup_hash(x)) == ("ab",)


def test_nfkc(spark):
    rows = spark.createDataFrame([("ﬁ①Ａ½",), (None,)], "x string")
    assert [r[0] for r in rows.select(T.nfkc("x")).collect()] == [unicodedata.normalize("NFKC", "ﬁ①Ａ½"), None]


def test_sections(spark):
    x = F.col("x")
    text = "Intro. Course Objectives: learn\nmuch. NOTE: bring a pen"
    assert one(spark, text, T.extract_section(x, ("course objectives:",), ("note:",)), T.extract_section(x, ("missing",), ("note",))) == (" learn\nmuch. ", "")


@pytest.mark.parametrize("n", [2, 3, 5])
def test_grams(spark, n):
    texts: list[str] = []

    @settings(max_examples=60, deadline=None, database=None)
    @given(st.text(st.sampled_from("abß計\U0001f600_"), max_size=12))
    def gather(t):
        texts.append(t)

    gather()
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "x string").select("x", T.grams(F.col("x"), n).alias("g"), T.grams(F.col("x"), 2, n, whole_if_short=False).alias("h")).collect()
    for t, g, h in rows:
        assert g == ([] if not t else [t] if len(t) <= n else [t[i : i + n] for i in range(len(t) - n + 1)])
        assert h == [t[i : i + m] for m in range(2, n + 1) for i in range(len(t) - m + 1)]
