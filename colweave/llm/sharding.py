"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots, once and for all. Bytes and
rows are summed by slot, and a small map says which shard holds each slot. The
map is a table with a version; rebalancing or growing writes the next version
and moves whole slots, never single records. Records are read once: the
summary table that is stored holds ids, sizes and slots, no text.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.llm.common import scratch_path, store, text_bytes

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192
#: Rows repeated by more than one HOT-th of all rows are spread over slots.
HOT = 1 << 14

SlotSums = dict[int, tuple[int, int]]


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size (UTF-8 bytes plus 1), text_crc32 and virtual_slot of each record, stored.

    The slot hashes id and text, so records that share an id spread out as
    well; null ids and texts hash like any value. Null text has no bytes. A row that is repeated
    by more than one ``HOT``-th of all rows has its copies told apart by a running number.
    """
    text = F.col(text_col).cast("string")
    keyed = store(docs.select(
        F.col(id_col),
        (text_bytes(text) + 1).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("__key"),
    ), "keyed-records")
    least = max(1, keyed.count() // HOT)
    hot = keyed.groupBy("__key").agg(F.count("*").alias("__n")).filter(F.col("__n") > least)  # fewer than HOT rows
    number = F.pmod(F.monotonically_increasing_id(), F.col("__n"))
    key = F.when(F.col("__n").isNull(), F.col("__key")).otherwise(F.xxhash64("__key", number))
    return store(
        keyed.join(F.broadcast(hot), "__key", "left").select(id_col, "size", "text_crc32", F.pmod(key, F.lit(slots)).cast("int").alias("virtual_slot")), "slots")


def slot_sums(records: DataFrame) -> SlotSums:
    """Slot -> (bytes, rows): at most as many entries as there are slots."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows}


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot while no sizes are known: slots in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(slot_map: list[int], sums: SlotSums, shards: int) -> list[int]:
    """The map edited for ``shards`` shards: slots move from the fullest to the emptiest shard
    while that brings the two closer, the heaviest slot that does so first."""
    out = list(slot_map)
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(shards)}
    loads = [0] * shards
    homeless = []
    for slot, k in enumerate(out):
        b = sums.get(slot, (0, 0))[0]
        if k >= shards:
            homeless.append((b, slot))
        else:
            held[k].append((b, slot))
            loads[k] += b
    for b, slot in sorted(homeless, reverse=True):
        k = min(range(shards), key=lambda x: (loads[x], x))
        out[slot] = k
        held[k].append((b, slot))
        loads[k] += b
    for x in held.values():
        x.sort()
    while True:
        low = min(range(shards), key=lambda x: (loads[x], x))
        high = max(range(shards), key=lambda x: (loads[x], -x))
        gap = loads[high] - loads[low]
        fit = [i for i, (b, _) in enumerate(held[high]) if 0 < b and 2 * b <= gap]
        if not fit:
            return out
        b, slot = held[high].pop(fit[-1])
        out[slot] = low
        held[low].append((b, slot))
        held[low].sort()
        loads[high] -= b
        loads[low] += b


def write_map(spark: SparkSession, path: str, version: int, slot_map: list[int], sums: SlotSums) -> DataFrame:
    """Store one version of the map: virtual_slot, shard, first_row (of the slot within its shard)."""
    first, rows = [], {}
    for slot, k in enumerate(slot_map):
        first.append(rows.get(k, 0))
        rows[k] = rows.get(k, 0) + sums.get(slot, (0, 0))[1]

    def column(values: list[int], kind: str):
        # one literal, folded once: the map is as long as there are slots
        return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col("id").cast("int") + 1)

    (
        spark.range(len(slot_map)).coalesce(1)
        .select(F.col("id").cast("int").alias("virtual_slot"), column(slot_map, "int").alias("shard"), column(first, "long").alias("first_row"))
        .write.mode("error").parquet(f"{path}/version={version}")
    )
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, first_row long").parquet(f"{path}/version={version}")


def rebalance(spark: SparkSession, path: str, version: int, sums: SlotSums, shards: int) -> tuple[int, DataFrame]:
    """Read a stored version of the map, edit it for the sizes at hand and store the result as the next version.

    Returns the version that holds and its map: the one given if no slot has to move.
    """
    held = read_map(spark, path, version)
    old = [r["shard"] for r in held.orderBy("virtual_slot").collect()]  # as many as there are slots
    new = rebalanced(old, sums, shards)
    return (version, held) if new == old else (version + 1, write_map(spark, path, version + 1, new, sums))


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add shard and the record's row in its shard, from 0 without gaps.

    The map has one row for each slot, which bounds what is broadcast.
    """
    within = Window.partitionBy("virtual_slot").orderBy(*[c for c in records.columns if c != "virtual_slot"])
    return (
        records.withColumn("__row", F.row_number().over(within) - 1)
        .join(F.broadcast(slot_map), "virtual_slot")
        .withColumn("row", F.col("first_row") + F.col("__row"))
        .drop("__row", "first_row")
    )


def shard_by_bytes(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record's shard, so that the shards' sizes are near equal (law ``bytes``).

    Returns doc_id, size, text_crc32, law, shard, slot (row within the shard),
    grown_shard (null: the map edited for one more shard also follows sizes),
    virtual_slot and map_version, one row per input row. Repeated rows are records each;
    an empty table gives an empty result. Version 1 of the map, below
    ``map_path``, deals slots in turn; it is edited for the sizes that are found, which gives version 2.
    """
    spark = docs.sparkSession
    records = slotted(docs, slots)
    sums = slot_sums(records)
    path = map_path or scratch_path(spark, "slot-map")
    write_map(spark, path, 1, first_map(shards, slots), sums)
    version, slot_map = rebalance(spark, path, 1, sums, shards)
    return place(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("row").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"))
