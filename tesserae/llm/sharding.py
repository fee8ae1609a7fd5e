"""Sharding by fixed virtual slots, in DataFrame operations only.

Records are hashed into a fixed number of slots; bytes and rows are summed per slot; a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map: version 1 deals the
slots round robin, and each later version moves only the slots that overload a shard. Versions
are kept in a folder, one below another; rebalancing loads the newest, edits it and stores the
next. A map has n_slots rows at most, so it can be joined by broadcast and folded in a single row.

Null ids and texts hash like any value, empty texts count one byte, equal rows take different
places in the same slot, and an empty table gives an empty result (and an empty map). Very long
texts count by their bytes only. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

N_SLOTS = 4096
#: Parts of a slot in which rows are numbered on their own.
N_PARTS = 8
#: A version's file has the map, and the loads of which it was made; versions are folders.
STORED = "vslot int, shard int, bytes bigint, rows bigint, version int"


def slot_of(*columns: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n_slots)).cast("int")


def slot_loads(records: DataFrame, size: str = "size") -> DataFrame:
    """(vslot, bytes, rows): partial sums before the shuffle, n_slots rows after it."""
    return records.groupBy("vslot").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(loads: DataFrame, n_shards: int) -> DataFrame:
    """Version 1: round robin, whatever the bytes."""
    return loads.select(F.lit(1).alias("version"), "vslot", (F.col("vslot") % n_shards).cast("int").alias("shard"), "bytes", "rows")


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """All versions in the folder, None without a folder."""
    try:
        return spark.read.schema(STORED).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def last_version(versions: DataFrame | None) -> int:
    """0 where no version has a slot."""
    return versions.agg(F.max("version")).first()[0] or 0 if versions is not None else 0


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version in the folder."""
    versions = stored(spark, folder)
    return versions.where(F.col("version") == last_version(versions))


def next_map(spark: SparkSession, loads: DataFrame, n_shards: int, folder: str) -> DataFrame:
    """Loads the newest map of the folder (or stores the first), edits it for the loads, stores and returns the edition.

    Versions are only added; of two editors at once, the second fails. Slots that the old map does
    not know are dealt round robin first. Without a load, there is nothing to edit.
    """
    keep = lambda slot_map, version: slot_map.select("vslot", "shard", "bytes", "rows").coalesce(1).write.mode("overwrite" if version == 1 else "error").parquet(f"{folder}/version={version}")
    version = last_version(stored(spark, folder))
    if not version:  # no folder, or one of an empty table
        keep(first_map(loads, n_shards), 1)
        version = last_version(stored(spark, folder))
    old = newest(spark, folder)
    if version:
        known = F.broadcast(old.select("vslot", "shard"))
        shard = F.coalesce("shard", F.col("vslot") % n_shards).cast("int")
        keep(rebalance(loads.join(known, "vslot", "left").select("vslot", shard.alias("shard"), "bytes", "rows"), n_shards, version + 1), version + 1)
    return newest(spark, folder)


def rebalance(slot_map: DataFrame, n_shards: int, version: int) -> DataFrame:
    """The next version of a map for n_shards shards, with near equal bytes.

    Each shard keeps its slots, largest first, while they fit the mean load; the slots beyond
    it go, largest first, to the shard with the least bytes. Shards of the old map that are
    n_shards or more give up all slots; new shards begin empty.
    """
    everything = Window.partitionBy("one")
    own = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.ceil(F.sum("bytes").over(everything) / n_shards)
    marked = slot_map.withColumn("one", F.lit(1)).withColumn("mean", mean).withColumn("stays", (F.sum("bytes").over(own) <= F.col("mean")) & (F.col("shard") < n_shards))
    slot = F.struct((-F.col("bytes")).alias("neg"), F.col("vslot"), F.col("rows"))
    kept = F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("vslot", "shard", "bytes", "rows"))))
    moved = F.sort_array(F.collect_list(F.when(~F.col("stays"), slot)))
    row = marked.groupBy("one").agg(kept.alias("kept"), moved.alias("moved"))
    zero = F.array_repeat(F.lit(0).cast("long"), n_shards)
    load = F.aggregate("kept", zero, lambda acc, s: F.transform(acc, lambda v, i: v + F.when(i == s["shard"], s["bytes"]).otherwise(0)))

    def place(acc: Column, s: Column) -> Column:
        to = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["load"], lambda v, i: v + F.when(i == to, -s["neg"]).otherwise(F.lit(0).cast("long"))).alias("load"),
            F.concat(acc["out"], F.array(F.struct(s["vslot"].alias("vslot"), to.alias("shard"), (-s["neg"]).alias("bytes"), s["rows"].alias("rows")))).alias("out"),
        )

    none = F.array().cast("array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint>>")
    placed = F.aggregate("moved", F.struct(load.alias("load"), none.alias("out")), place)["out"]
    both = row.select(F.explode(F.concat(F.col("kept").cast("array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint>>"), placed)).alias("s"))
    return both.select(F.lit(version).alias("version"), "s.vslot", "s.shard", "s.bytes", "s.rows")


def shard_records(records: DataFrame, slot_map: DataFrame, keys: list[str]) -> DataFrame:
    """Adds shard, map_version and slot, the place in the shard, gapless from 0.

    records: with vslot and part, an input-order salt below N_PARTS. Rows are numbered within
    a slot's part; parts and slots are stacked by their counts.
    """
    inside = Window.partitionBy("vslot", "part").orderBy(*keys)
    numbered = records.withColumn("rank", F.row_number().over(inside) - 1)
    parts = records.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"))
    stack = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.select("vslot", "shard", F.col("version").alias("map_version"))
    bases = parts.join(F.broadcast(placed), "vslot").withColumn("base", F.coalesce(F.sum("n").over(stack), F.lit(0))).select("vslot", "part", "shard", "map_version", "base")
    return numbered.join(F.broadcast(bases), ["vslot", "part"]).withColumn("slot", F.col("base") + F.col("rank")).drop("base", "rank")
