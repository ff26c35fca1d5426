"""Shards by fixed virtual slots.

Records are hashed into a fixed, large number of virtual slots. Bytes are added up per slot, and a
versioned table maps slots to shards. Balancing looks at slots only: the map has as many
rows as there are slots, whatever the number of records, and a new version moves slots,
never single records. The first map gives the largest slot to the emptiest shard, one slot after the
other; a later one moves only slots that an overfull shard must give away.

The position of a record in its shard is the number of records in the shard's earlier slots, which
the slot totals know, plus its rank within its slot. So no task ever sees a whole shard.

Cases: a null text has size 1 and the checksum of no bytes; a null identifier is hashed by its
text; repeated rows (same identifier, same text) share a slot and get different positions; empty
slots are mapped too; an empty table gives an empty result and a valid map; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stored

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def records(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifier, size, checksum and virtual slot of every document."""
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(key, text), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["bytes", "n_rows"])


def _dealt(slots: DataFrame, chosen: Column, loads: Column) -> DataFrame:
    """Give the chosen slots, largest first, to the shard with the least bytes so far.

    ``loads`` aggregates ``slots`` to the bytes each shard starts with. The rest is one fold over one
    array, whose length is bounded by the number of slots.
    """

    def give(state: Column, slot: Column) -> Column:
        emptiest = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        return F.struct(
            F.transform(
                state["loads"], lambda load, i: load + F.when(i == emptiest, slot["bytes"]).otherwise(0)
            ).alias("loads"),
            F.concat(state["owners"], F.array(emptiest.cast("int"))).alias("owners"),
        )

    slot = F.struct((-F.col("bytes")).alias("largest_first"), "virtual_slot", "bytes")
    none_yet = F.array().cast("array<int>").alias("owners")
    return (
        slots.agg(F.sort_array(F.collect_list(F.when(chosen, slot))).alias("slots"), loads.alias("loads"))
        .select("slots", F.struct("loads", none_yet).alias("start"))
        .select("slots", F.aggregate("slots", F.col("start"), give)["owners"].alias("owners"))
        .select(F.explode(F.arrays_zip("slots", "owners")).alias("x"))
        .select(F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.owners").alias("shard"))
    )


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """Version 1: every slot dealt by bytes."""
    nothing = F.array(*[F.sum(F.lit(0)).cast("long") for _ in range(shards)])
    return _dealt(totals, F.lit(True), nothing).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def next_map(current: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version for ``shards`` shards and today's slot totals.

    A shard keeps its slots, largest first, up to an equal share of the bytes and gives the rest away,
    as does a shard that no longer exists; what is given away is dealt by bytes.
    """
    share = F.ceil(F.sum("bytes").over(Window.partitionBy()) / shards)
    filled = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = totals.join(current, "virtual_slot").withColumn(
        "stays", (F.col("shard") < shards) & (F.sum("bytes").over(filled) <= share)
    )
    loads = F.array(
        *[F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes")).otherwise(0)) for s in range(shards)]
    )
    moved = _dealt(slots, ~F.col("stays"), loads)
    both = slots.where("stays").select("virtual_slot", "shard").union(moved)
    version = current.agg((F.max("version") + 1).alias("version")).first()[0]
    return both.select(F.lit(version).cast("int").alias("version"), "virtual_slot", "shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version; earlier ones stay, so that written shards can still be read by theirs."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest if none is named."""
    maps = spark.read.schema(MAP_SCHEMA).parquet(path).select("version", "virtual_slot", "shard")
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def placed(rows: DataFrame, totals: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position of every record under a map."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are slots, which is what makes the broadcast safe
    starts = totals.join(slot_map, "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    return rows.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(starts), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"),
        F.col("version").alias("map_version"),
    )


def sharded(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Shard and position of every document under a first map, which is stored in ``map_path``."""
    rows = stored(records(docs, slots), "slot-records")
    totals = stored(slot_totals(rows, slots), "slot-totals")
    save_map(first_map(totals, shards), map_path)
    return placed(rows, totals, load_map(docs.sparkSession, map_path))
