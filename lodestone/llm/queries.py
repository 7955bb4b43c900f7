"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, lattice, mixing, neardup, oracles, pieces, privacy, sharding, suffixes, toxicity, webp
from .common import fold, table

N_SHARDS = 16


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(webp.store_column(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", *webp.DIGESTS)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id") != 0)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("sentences").alias("n_offending"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice.score(table(spark, sf_dir, "documents"), fold("doc_id") != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, threshold=(80, 100))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), N_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"),
    )


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = privacy.spans(table(spark, sf_dir, "documents"))
    found = F.col("found")
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        *(F.size(found[k]).cast("long").alias(f"n_{k}") for k in privacy.KINDS),
        F.sha2(privacy.listing(privacy.base_places(found)).cast("binary"), 256).alias("base_sha256"),
        privacy.listing(privacy.all_places(found, F.col("terms"))).alias("spans"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "source", "weight", "block", "phase", "release", "deadline", "slot", "position")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_webp": op1_webp, "op2_toxicity": op2_toxicity, "op3_ann": op3_ann, "op4_lattice_lm": op4_lattice_lm, "op5_near_dedup": op5_near_dedup, "op6_suffix_dedup": op6_suffix_dedup, "op7_sharding": op7_sharding, "op8_sentencepiece": op8_sentencepiece, "op9_privacy": op9_privacy, "op10_mixing": op10_mixing}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
