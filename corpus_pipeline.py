"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate group, sanitise personal data, mix the
sources to their target weights, and encode.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the mix decides the order of rows in the files it is written to, and the last stage returns
one row of ids for each document with its ``position`` in the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, neardup, pieces, privacy, toxicity
from lodestone.llm.common import fold, stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id") != 0)
    return toxicity.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, width=5, threshold=(80, 100))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = privacy.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.numbered(docs).select(F.struct("doc_id", "position").alias("key"), "text")
    encoded = pieces.encode(placed, public_tokenizers.path("piece_bpe_32k.model"), id_column="key")
    return encoded.select(
        "key.doc_id",
        "key.position",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("pii", private), ("mixing", mix), ("sentencepiece", encode)]

#: Learning, hashing and piece encoding can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
