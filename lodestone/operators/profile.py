"""Observed schemas: field profiles, presence by group, missing values and their candidate causes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE_NAMES = {"string": "str", "bigint": "int", "int": "int", "double": "float", "float": "float", "boolean": "bool"}


def unpivot(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keep..., field, type, value: one row a field and record, values as text."""
    kinds = dict(df.dtypes)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(TYPE_NAMES.get(kinds[f], kinds[f])).alias("type"), F.col(f).cast("string").alias("value")) for f in fields))
    return df.select(*keep, F.explode(each).alias("u")).select(*keep, "u.field", "u.type", "u.value")


def field_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    long = unpivot(df, fields)
    return long.groupBy("field", "type").agg(
        F.count_if(F.col("value").isNull()).alias("null_count"),
        F.count_if(F.regexp_replace("value", r"[\s\p{Z}]+", "") == "").alias("blank_count"),
        F.count("value").alias("nonnull_count"),
        F.countDistinct("value").alias("distinct_count"),
    )


def type_drift(typed: DataFrame) -> DataFrame:
    """field, types, drifts from rows (field, type)."""
    real = F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type"))))
    return typed.groupBy("field").agg(F.array_join(real, ",").alias("types"), (F.size(real) > 1).alias("drifts"))


def present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def availability(rate: Column) -> Column:
    return F.when(rate == 0, "schema_absence_candidate").when(rate == 1, "source_consistently_present").otherwise("source_heterogeneous_or_record_missing")


def grouped_presence(df: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    long = unpivot(df, fields, (group,))
    counted = long.groupBy(group, "field").agg(F.count_if(present(F.col("value"))).alias("present"), F.count("*").alias("records"))
    rate = F.col("present") / F.col("records")
    return counted.select(group, "field", "present", (F.col("records") - F.col("present")).alias("empty"), F.round(rate, 6).alias("rate"), availability(rate).alias("availability"))


def availability_matrix(presence: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    return presence.groupBy(group).pivot("field", list(fields)).agg(F.first("availability"))


def availability_histogram(presence: DataFrame) -> DataFrame:
    return presence.groupBy("field", "availability").agg(F.count("*").alias("groups"))


def semantic_class(field: Column, classes: Mapping[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in classes.items() for x in kv))[field], F.lit("unclassified"))


def missing_events(df: DataFrame, id_column: str, group: str, fields: Sequence[str], presence: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row a record and empty field, with every cause that a rule finds.

    ``rules``: label to condition over the record, ``field`` and ``availability``. Without any the cause is unresolved;
    a schema candidate never rules out others. The presence table has a row a group and field, so it is broadcast
    when small by the optimizer alone.
    """
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    empty = df.select("*", F.explode(each).alias("u")).select(*df.columns, "u.field", "u.value").where(~present(F.col("value")) | F.col("value").isNull())
    joined = empty.join(presence.select(group, "field", "availability"), [group, "field"])
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    schema = F.col("availability") == "schema_absence_candidate"
    labels = F.array_compact(F.array(F.when(schema, F.lit("structural_schema_candidate")), F.when(schema, F.lit("other_causes_not_excluded"))))
    causes = F.array_sort(F.array_distinct(F.concat(labels, found)))
    return joined.select(F.col(id_column), F.col(group), "field", "availability", F.when(F.size(causes) > 0, causes).otherwise(F.array(F.lit("cause_unresolved"))).alias("causes"))


def label_counts(df: DataFrame, labels: str, name: str = "label") -> DataFrame:
    return df.select(F.explode(labels).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def presence_sums(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: how many records hold each field."""
    return df.agg(*(F.count_if(F.coalesce(present(F.col(f)), F.lit(False))).alias(f) for f in fields))


def json_types(df: DataFrame, column: str) -> DataFrame:
    """key, type of every top-level key of JSON objects held as text; keys may hold any character."""
    fields = F.from_json(F.col(column), "map<string,string>")
    rows = df.select(F.explode(fields).alias("field", "value"))
    typed = (
        F.when(F.col("value").isNull(), "null").when(F.col("value").rlike("^-?[0-9]+$"), "int").when(F.col("value").rlike("^-?[0-9]*\\.?[0-9]+([eE][+-]?[0-9]+)?$"), "float")
        .when(F.col("value").isin("true", "false"), "bool").when(F.col("value").startswith("["), "list").when(F.col("value").startswith("{"), "dict").otherwise("str")
    )
    return rows.select("field", typed.alias("type"), "value")
