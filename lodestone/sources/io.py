"""Sources and sinks: JSON in its three forms, checksummed files, contracts, manifests and JSON output."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines for ``.jsonl``, else one document a file: an array of records, or an object whose ``records`` are exploded."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").endswith(".jsonl"):
        return reader.json(path)
    found = reader.option("multiLine", True).json(path)
    if not schema and "records" in found.columns and dict(found.dtypes)["records"].startswith("array<struct"):
        return found.select(F.explode("records").alias("r")).select("r.*")
    return found


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The fields beside ``records`` of an object-form dataset; one row."""
    return spark.read.option("multiLine", True).json(path).drop("records")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_artifacts(declared: DataFrame, files: DataFrame) -> DataFrame:
    """declared (artifact, sha256) against files (path, sha256): present, hash_verified."""
    named = files.select(F.regexp_replace("path", "^file:/*", "/").alias("artifact"), F.col("sha256").alias("actual"))
    joined = declared.join(named, "artifact", "left")
    return joined.select("artifact", F.col("actual").isNotNull().alias("present"), F.coalesce(F.col("actual") == F.lower("sha256"), F.lit(False)).alias("hash_verified"))


def contract(df: DataFrame, expectations: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """Check named aggregates against expected values; raises on the first mismatch, else returns the input."""
    found = df.agg(*(c.alias(n) for n, (c, _) in expectations.items())).first()
    wrong = {n: (found[n], want) for n, (_, want) in expectations.items() if found[n] != want}
    if wrong:
        raise ValueError(f"contract mismatch (found, expected): {wrong}")
    return df


def unify(*sources: DataFrame) -> DataFrame:
    """Union of adapted sources by name; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, keys in order, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON text file."""
    df.coalesce(1).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_lanes(df: DataFrame, path: str, lane: str) -> None:
    df.write.mode("overwrite").partitionBy(lane).parquet(path)


def manifest(df: DataFrame, content: Column, **extra: Column) -> DataFrame:
    """records, distinct contents and an order-free digest of a dataset; one row."""
    digest = F.sha2(F.sum(F.conv(F.substring(F.sha2(content, 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string"), 256)
    return df.agg(F.count("*").alias("records"), F.countDistinct(content).alias("distinct_contents"), digest.alias("digest"), *(c.alias(n) for n, c in extra.items()))
