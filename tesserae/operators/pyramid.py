"""Pyramid levels in pixel form: repeated 2 x 2 means, and resizing by footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def mean_half_up() -> Column:
    """The mean of v, rounded half up in integers."""
    s, n = F.sum("v"), F.count(F.lit(1))
    return F.floor((2 * s + n) / (2 * n)).cast("long")


def halve(pixels: DataFrame, tile: int | None = None) -> DataFrame:
    """The next level: the mean of the one to four pixels under each.

    tile: rows are paired within bands of tile rows, which differs from global pairs if it is odd.
    """
    y = F.col("y")
    oy = F.floor(y / 2) if tile is None else F.floor(y / tile) * ((tile + 1) // 2) + F.floor(y % tile / 2)
    return pixels.groupBy(F.floor(F.col("x") / 2).cast("long").alias("x"), oy.cast("long").alias("y"), "c").agg(mean_half_up().alias("v"))


def level(pixels: DataFrame, n: int, tile: int | None = None) -> DataFrame:
    out = pixels.select("x", "y", "c", "v")
    for _ in range(n):
        out = halve(out, tile)
    return out


def footprint(spark, extent: int, new: int, name: str) -> DataFrame:
    """(name, out): which source places each of new places averages; nearest when enlarging."""
    o = F.col("out")
    start = F.least(F.floor(o * extent / new), F.lit(extent - 1))
    end = F.greatest(start + 1, F.least(F.floor((o + 1) * extent / new), F.lit(extent)))
    return spark.range(new).select(F.col("id").alias("out")).select(F.explode(F.sequence(start.cast("long"), (end - 1).cast("long"))).alias(name), o)


def resize(pixels: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """The mean of each footprint, with half the count added before the division.

    The footprints are small dimension tables (a row per source column and row).
    """
    spark = pixels.sparkSession
    fx = footprint(spark, width, new_width, "x").withColumnRenamed("out", "ox")
    fy = footprint(spark, height, new_height, "y").withColumnRenamed("out", "oy")
    met = pixels.join(F.broadcast(fx), "x").join(F.broadcast(fy), "y")
    s, n = F.sum("v"), F.count(F.lit(1))
    return met.groupBy(F.col("ox").alias("x"), F.col("oy").alias("y"), "c").agg(F.floor((s + F.floor(n / 2)) / n).cast("long").alias("v"))
