"""The virtual slide: each row of `embeddings` is a tile of 4 x 4 RGBA pixels.

Tiles fill a grid ceil(sqrt(n)) wide in the order of vec_id; places past the last id are sparse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TILE = 4

#: The same slide in SQL: common table expressions `grid` (tw) and `pixels` (tx, ty, x, y, c, v).
PIXELS_SQL = """grid AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS tw, count(*) AS n FROM embeddings),
pixels AS (
  SELECT tx, ty, tx * 4 + (k // 4) % 4 AS x, ty * 4 + k // 16 AS y, k % 4 AS c,
         CAST(least(greatest(floor((CAST(e AS DOUBLE) + 0.5) * 255), 0), 255) AS BIGINT) AS v
  FROM (SELECT vec_id % tw AS tx, vec_id // tw AS ty, unnest(embedding) AS e, unnest(range(0, 64)) AS k FROM embeddings, grid))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_width(embeddings: DataFrame) -> int:
    """Tiles across; the count comes from the files' footers."""
    n = embeddings.count()
    w = int(n**0.5)
    return w if w * w >= n else w + 1


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, ty, embedding) of the tiles that exist."""
    e = table(spark, sf_dir, "embeddings")
    w = grid_width(e)
    return e.select((F.col("vec_id") % w).alias("tx"), F.floor(F.col("vec_id") / w).cast("long").alias("ty"), "embedding")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, ty, x, y, c, v), all bigint; one row a channel of a pixel."""
    p = tiles(spark, sf_dir).select("tx", "ty", F.posexplode("embedding").alias("k", "e"))
    k = F.col("k").cast("long")
    v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("long")
    return p.select("tx", "ty", (F.col("tx") * TILE + F.floor(k / 4) % 4).cast("long").alias("x"), (F.col("ty") * TILE + F.floor(k / 16)).cast("long").alias("y"), (k % 4).alias("c"), v.alias("v"))
