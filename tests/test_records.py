import difflib
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import audit, identity, index, profile
from lodestone.plans import records


def test_canonical_json_and_ids(spark):
    rows = [({"b": ["x", 'q"uo\\te', "換行\n"], "a": 3, "c": {"z": None, "y": "é"}},), ({"b": [], "a": None, "c": None},), ({"b": None, "a": -1, "c": {"z": 1, "y": ""}},)]
    df = spark.createDataFrame(rows, "r struct<b:array<string>,a:long,c:struct<z:long,y:string>>")
    kind = df.schema["r"].dataType
    got = df.select(T.canonical_json(F.col("r"), kind).alias("j"), T.json_id("P-", F.col("r"), kind).alias("i"), T.as_text(F.col("r.b"), kind["b"].dataType).alias("t")).collect()
    for (r,), g in zip(rows, got):
        want = json.dumps(r, ensure_ascii=False, sort_keys=True)
        assert g.j == want and g.i == "P-" + hashlib.sha256(want.encode()).hexdigest()[:20]
        assert g.t == ("" if r["b"] is None else json.dumps(r["b"], ensure_ascii=False))


def test_every_status_is_reached(spark):
    assert {r.status for r in records.audited(spark).collect()} == {"exact", "ambiguous", "weak"}
    assert {r.reason for r in records.identity_bridge(spark, "").collect()} == {"unique_exact_normalized_subject", "exact_name_has_multiple_outline_variants", "strong_machine_alias_requires_review", "no_unique_exact_or_strong_alias"}
    assert {r.status for r in records.section_statuses(spark).collect()} == {"exact", "ambiguous", "weak"}
    assert {r.level for r in records.heading_units(spark, "").collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("width", [2, 12])
def test_containing(spark, width):
    texts = {1: "abcdefghijklmnopqrstuvwxyz" * 3, 2: "xyz", 3: "", 4: "öüäßöüäß"}
    items = {10: "mnopqrstuvwxyzabcdef", 11: "z", 12: "", 13: "xyz", 14: "yzabcq", 15: "üäßö"}
    got = identity.containing(spark.createDataFrame(list(texts.items()), "query_id long, key string"), spark.createDataFrame(list(items.items()), "item_id long, key string"), width).collect()
    assert sorted(map(tuple, got)) == sorted((q, i) for q, t in texts.items() for i, x in items.items() if x and x in t)


def test_similar_titles_against_all_pairs(spark):
    names = ["resume", "resumes", "presume", "sum", "museum", "emus", "serum", "summer", "us", "zz", "measure", "m", "resumé", "erus", "uses", "seum"]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    got = identity.similar_titles(df.select(F.col("k").alias("left_key")), df.select(F.col("k").alias("right_key")), 2).collect()
    for a in names:
        every = sorted(((round(difflib.SequenceMatcher(None, a, b).ratio(), 8), b) for b in names), key=lambda x: (-x[0], x[1]))
        want = [(b, s) for s, b in every if s > 0][:2]
        assert [(r.right_key, r.similarity) for r in sorted(got, key=lambda r: r["rank"]) if r.left_key == a] == want


def test_dense_pairs_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.query_id, r.item_id): r.score for r in index.dense_pairs(df, df, "id", "id", block=4).collect()}
    assert got == {(a, b): sum(x * y for x, y in zip(u, v)) for a, u in rows for b, v in rows}


def test_global_order_over_partitions(spark):
    df = spark.createDataFrame([((i * 37) % 101, f"v{i}") for i in range(101)], "k long, v string").repartition(5)
    got = sorted(audit.in_global_order(df, "k", name="line").collect(), key=lambda r: r.line)
    assert [r.k for r in got] == list(range(101)) and [r.line for r in got] == list(range(1, 102))


def test_keys_with_dots(spark):
    df = spark.createDataFrame([('{"a.b": 1, "c d": "x", "e": null}',), (None,), ("not json",)], "p string")
    got = {(r.field, r.type) for r in profile.json_types(df, "p").collect()}
    assert got == {("a.b", "int"), ("c d", "str"), ("e", "null")}
