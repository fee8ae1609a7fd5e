"""Region reads in pixel form: rows (x, y, c, v) filtered, padded and joined with rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tile_range(x: int, y: int, width: int, height: int, tile: int) -> tuple[int, int, int, int]:
    """First and last tile column and row that a rectangle meets."""
    return x // tile, (x + width - 1) // tile, y // tile, (y + height - 1) // tile


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int, tile: int) -> DataFrame:
    """Pixels of a rectangle, moved to its origin.

    The rectangle becomes a range of tile indices first, which a partitioned store can prune by.
    """
    x0, x1, y0, y1 = tile_range(x, y, width, height, tile)
    inside = F.col("tx").between(x0, x1) & F.col("ty").between(y0, y1) & F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.where(inside).select((F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "c", "v")


def padded(spark, cropped: DataFrame, width: int, height: int) -> DataFrame:
    """A whole rectangle: places without a pixel (off the level, or of a sparse tile) are 0 in all channels."""
    cells = spark.range(width * height * 4).select((F.floor(F.col("id") / 4) % width).cast("long").alias("x"), F.floor(F.col("id") / (4 * width)).cast("long").alias("y"), (F.col("id") % 4).alias("c"))
    return cells.join(cropped, ["x", "y", "c"], "left").select("x", "y", "c", F.coalesce("v", F.lit(0).cast("long")).alias("v"))


def of_regions(regions: DataFrame, pixels: DataFrame, tile: int) -> DataFrame:
    """Pixels of many rectangles (region_id, x0, y0, w, h): a range join as an equi-join on tile indices."""
    span = lambda a, n: F.explode(F.sequence(F.floor(a / tile), F.floor((a + n - 1) / tile)))
    keyed = regions.withColumn("tx", span(F.col("x0"), F.col("w"))).withColumn("ty", span(F.col("y0"), F.col("h")))
    inside = F.col("x").between(F.col("x0"), F.col("x0") + F.col("w") - 1) & F.col("y").between(F.col("y0"), F.col("y0") + F.col("h") - 1)
    return keyed.join(pixels, ["tx", "ty"]).where(inside)


def totals(regions: DataFrame, pixels: DataFrame, tile: int) -> DataFrame:
    """(region_id, n, total) of rectangles (region_id, x0, y0, w, h) that meet pixels: their number, and the sum of v.

    Equal rectangles are read once, so that a much wanted place costs by its different rectangles.
    """
    box = ["x0", "y0", "w", "h"]
    sums = lambda n, v: (F.sum(n).alias("n"), F.sum(v).alias("total"))
    met = of_regions(regions.select(*box).distinct(), pixels, tile).groupBy(*box).agg(*sums(F.lit(1), "v"))
    return regions.join(met, box).groupBy("region_id").agg(*sums("n", "total"))
