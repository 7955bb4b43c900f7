"""Sharding over fixed virtual slots.

Every record is hashed into one of ``n_slots`` slots for good. A slot's bytes are summed once, and a small versioned
table says which shard holds which slot. Version 1 fills shards with the largest slots first, each into the lightest
shard; rebalancing writes the next version, which moves only the slots that have to move. Only the slot table (as
many rows as there are slots, whatever the data) is ever brought together or broadcast.

Defined results: a null text has no bytes and crc32 0; a null id hashes like the text "null-id"; repeated rows share a
slot and get different ordinals; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SLOTS = 4096


def slot_of(id_column: str, n_slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("null-id"))), F.lit(n_slots)).cast("int")


def records(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n_slots: int = SLOTS) -> DataFrame:
    """The narrow rows that are dealt: id, size, text_crc32, virtual_slot."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_column),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(id_column, n_slots).alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def assign(sizes: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: virtual_slot, bytes, n_rows, shard, version.

    The slots, largest first, are folded over the shards' loads; each goes to the shard with the least load so far.
    """
    listed = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct("bytes", F.negative("virtual_slot").alias("key"), "virtual_slot", "n_rows")), asc=False).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def put(state, slot):
        target = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i == target - 1, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["shards"], F.array(target - 1)).alias("shards"))

    dealt = listed.select("slots", F.aggregate("slots", start, put, lambda state: state["shards"]).alias("shards"))
    rows = dealt.select(F.explode(F.arrays_zip("slots", "shards")).alias("x"))
    return rows.select(
        F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.slots.bytes").alias("bytes"),
        F.col("x.slots.n_rows").alias("n_rows"), F.col("x.shards").alias("shard"), F.lit(1).alias("version"),
    )


def rebalance(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version for ``n_shards`` shards: a slot keeps its shard while that shard stays within an even share.

    Within each shard the largest slots stay, as far as they fit into the share; the others move, largest first, each
    to the lightest shard. Slots of shards that no longer exist all move.
    """
    share = F.sum("bytes").over(Window.partitionBy()) / n_shards
    kept = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = slot_map.withColumn("stays", (F.col("shard") < n_shards) & (kept <= share))
    listed = marked.groupBy().agg(F.sort_array(F.collect_list(F.struct("stays", "bytes", F.negative("virtual_slot").alias("key"), "virtual_slot", "n_rows", "shard", "version")), asc=False).alias("slots"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def put(state, slot):
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        target = F.when(slot["stays"], slot["shard"]).otherwise(lightest)
        loads = F.transform(state["loads"], lambda x, i: F.when(i == target, x + slot["bytes"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["shards"], F.array(target)).alias("shards"))

    dealt = listed.select("slots", F.aggregate("slots", start, put, lambda state: state["shards"]).alias("shards"))
    rows = dealt.select(F.explode(F.arrays_zip("slots", "shards")).alias("x"))
    return rows.select(
        F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.slots.bytes").alias("bytes"), F.col("x.slots.n_rows").alias("n_rows"),
        F.col("x.shards").alias("shard"), (F.col("x.slots.version") + 1).alias("version"),
    )


def shard(docs: DataFrame, n_shards: int, id_column: str = "doc_id", text_column: str = "text", n_slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows, stored map). Rows: id, size, text_crc32, virtual_slot, shard, slot (ordinal in the shard from 0), version.

    A row's ordinal is the number of rows in earlier slots of its shard plus its place in its own slot, so no task
    sorts more than one slot.
    """
    rows = records(docs, id_column, text_column, n_slots)
    slot_map = stored(assign(slot_sizes(rows), n_shards), "slot-map")
    before = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n_rows")
    placed = slot_map.select("virtual_slot", "shard", "version", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(id_column), "text_crc32", "size")) - 1
    dealt = rows.withColumn("place", place).join(F.broadcast(placed), "virtual_slot")  # at most n_slots rows
    return dealt.select(id_column, "size", "text_crc32", "virtual_slot", "shard", (F.col("before") + F.col("place")).alias("slot"), "version"), slot_map
