"""op8: all documents into 16 shards of near equal bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tesserae.llm import sharding
from tesserae.llm.common import materialize, shared_dir, table

N_SHARDS = 16


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), N_SHARDS)


def shard(docs: DataFrame, n_shards: int, folder: str | None = None) -> DataFrame:
    """folder: where the versions of the slot map are kept; by default a new one among the tables between steps."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        sharding.slot_of(F.col("doc_id"), F.col("text")).alias("vslot"),
        F.pmod(F.monotonically_increasing_id(), F.lit(sharding.N_PARTS)).cast("int").alias("part"),
    )
    records = materialize(records, "records")
    loads = materialize(sharding.slot_loads(records), "slot-loads")
    slot_map = sharding.next_map(spark, loads, n_shards, folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    placed = sharding.shard_records(records, slot_map, ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
