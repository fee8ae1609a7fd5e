"""What the text operators share: shared-folder tables, chunks and splits."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserae.session import reachable


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few megabytes, in which whole texts go to Python and back; results do not depend on it."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    """A temporary folder of this process, removed at its end."""
    path = tempfile.mkdtemp(prefix="tesserae-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{_own_dir()}"


#: Whether Spark removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of the scratch() blocks that are open, the tables written in each.
_SCRATCH: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that materialize() writes in the block at its end.

    What is read afterwards must have been taken out of the list that the block is given, or be
    written outside of it.
    """
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Removes the shuffle files of every query in the block as it ends, not when the driver happens to collect its garbage.

    Frames that callers act on are made after the block: a second action would have to run their stages again.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a whole text column; sizes partitions, never results."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def chunks_for(n_bytes: int, chunk_bytes: int = 8 << 20, least: int = 64) -> int:
    """How many chunks keep each one near chunk_bytes."""
    return max(least, -(-n_bytes // chunk_bytes))


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus (null ids count as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
