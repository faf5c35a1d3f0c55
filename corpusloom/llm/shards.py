"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record belongs to one of ``slots`` virtual slots for good: a hash of its
key decides. Only the map from slots to shards changes. It is a small stored table
(version, slot, shard) of at most ``slots`` rows a version, whatever the size of
the data; an edit appends a version that moves whole slots and leaves all others
where they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import let
from corpusloom.llm.tables import kept
from corpusloom.session import shared_folder

SLOTS = 4096
SHARDS = 8
# A slot of more than so many times the mean load is dealt anew by row.
HEAVY = 4
MAP = "version int, slot int, shard int"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: 0 to ``slots - 1``. A null key has a slot, too."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_loads(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    """Bytes and rows of each slot that has records: (slot, bytes, rows)."""
    return records.groupBy(F.col(slot).alias("slot")).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1, made before any size is known: slots are dealt round."""
    return loads.select(F.lit(1).alias("version"), "slot",
                        (F.col("slot") % shards).cast("int").alias("shard"))


def rebalanced(current: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map's next version, edited so that the shards' bytes come out near equal.

    Slots are placed largest first. A slot stays where it is as long as its shard
    stays within the mean load, else it goes to the lightest shard, so mostly small
    slots move. With more ``shards`` than before, the new ones fill up with what
    exceeds the new mean; with fewer, the slots of the dropped ones are placed anew.
    Ties go to the smaller slot and shard number, so an edit is reproducible. No
    shard exceeds the mean by more than its last placed slot.

    Input and output have at most one row a slot: the placing is one fold.
    """
    known = loads.join(current.select("slot", "shard", "version"), "slot", "left").select(
        "slot", (-F.col("bytes")).alias("size"), "version",
        F.when(F.col("shard") < shards, F.col("shard")).alias("shard"))
    one = known.agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"),
        (-F.sum("size") / shards).alias("mean"),
        F.sort_array(F.collect_list(F.struct("size", "slot", "shard"))).alias("slots"))

    def place(acc: Column, s: Column) -> Column:
        stays = F.get(acc["load"], s["shard"]) - s["size"] <= F.col("mean")
        lightest = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        return let(F.when(stays, s["shard"]).otherwise(lightest), lambda to: F.struct(
            _add(acc["load"], to, -s["size"]).alias("load"),
            F.concat(acc["placed"], F.array(to)).alias("placed")))

    start = F.struct(F.array(*[F.lit(0).cast("long")] * shards).alias("load"),
                     F.array().cast("array<int>").alias("placed"))
    placed = F.aggregate("slots", start, place, lambda acc: acc["placed"])
    return (one.withColumn("placed", placed)
            .select("version", F.explode(F.arrays_zip(
                F.col("slots")["slot"].alias("slot"), F.col("placed").alias("shard"))).alias("row"))
            .select("version", "row.slot", "row.shard"))


def _add(loads: Column, shard: Column, size: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == shard, x + size).otherwise(x))


def positions(records: DataFrame, mapping: DataFrame, loads: DataFrame, order: list[str],
              slot: str = "vslot") -> DataFrame:
    """Adds ``shard``, ``map_version`` and ``slot``, a record's place in its shard, gapless from 0.

    A shard lists its virtual slots in ascending order. So a place is the rows in
    the shard's earlier slots, from the small map, plus the rank within the slot:
    the one window over records is cut by virtual slot, never by shard.
    """
    earlier = Window.partitionBy("shard").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1)
    base = mapping.join(loads, "slot").select(
        F.col("slot").alias(slot), "shard", F.col("version").alias("map_version"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    ranked = records.withColumn(
        "rank", F.row_number().over(Window.partitionBy(slot).orderBy(*order)))
    # The map has at most as many rows as there are virtual slots.
    return ranked.join(F.broadcast(base), slot).withColumn(
        "slot", (F.col("base") + F.col("rank") - 1).cast("long")).drop("base", "rank")


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version of the map below ``path``; none if there is no map yet."""
    try:
        every = spark.read.schema(MAP).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return every.where(F.col("version") == every.agg(F.max("version")).scalar())


def store_map(mapping: DataFrame, path: str) -> None:
    """Appends one version; those before it stay."""
    mapping.select(F.col("version").cast("int"), F.col("slot").cast("int"), F.col("shard").cast("int")).coalesce(
        1).write.mode("append").parquet(path)


def levelled(records: DataFrame, slots: int) -> DataFrame:
    """``records`` (vslot, size, row), those of heavy slots dealt by their row number.

    A key that very many rows share would fill one slot, which no map can divide.
    """
    loads = slot_loads(records)
    mean = loads.agg(F.sum("bytes") / slots).scalar()
    heavy = loads.where(F.col("bytes") > HEAVY * mean).select(F.col("slot").alias("vslot"), F.lit(True).alias("heavy"))
    # At most as many rows as there are slots.
    return records.join(F.broadcast(heavy), "vslot", "left").withColumn(
        "vslot", F.when(F.col("heavy"), F.pmod(F.xxhash64("vslot", "row"), F.lit(slots)).cast("int")).otherwise(
            F.col("vslot"))).drop("heavy", "row")


def sharded_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS,
                      map_path: str | None = None) -> DataFrame:
    """Documents → (doc_id, size, text_crc32, vslot, map_version, shard, slot).

    The size is the text's UTF-8 bytes plus one; a missing text has none. The
    shards' sizes come out near equal. A record's key is its id and text. Rows of
    one key share a slot, unless they are so many that the slot is ``HEAVY`` times
    the mean: then each row has a slot by its number in the input. Empty tables
    give no rows, and repeated rows keep a place each.

    The map is read from ``map_path`` and its next version appended there; without
    a path, a new map is stored in the shared folder.
    """
    spark = docs.sparkSession
    path = map_path or shared_folder(spark, "shard-map")
    records = kept(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(slots)).cast("int").alias("vslot"),
        F.monotonically_increasing_id().alias("row")), "shard-records")
    records = levelled(records, slots)
    loads = kept(slot_loads(records), "slot-loads")
    current = stored_map(spark, path)
    if current is None:
        store_map(first_map(loads, shards), path)
        current = stored_map(spark, path)
    mapping = kept(rebalanced(current, loads, shards), "slot-map")
    store_map(mapping, path)
    return positions(records, mapping, loads, ["doc_id", "size", "text_crc32"])
