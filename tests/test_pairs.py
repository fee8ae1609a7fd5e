"""Operators on pairs: no more pairs than there are different members, and the same totals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import annotations as A
from tesserae.operators import interaction, region
from tesserae.plans import queries_interaction, queries_meta, queries_pixels


@pytest.mark.parametrize("query", [queries_interaction.grid_hits, queries_meta.hit_test_top])
def test_equal_taps_meet_equal_shapes_once(spark, tmp_path, monkeypatch, query):
    """100 taps and 200 shapes, all of one place each, are a pair and not 20,000."""
    k = (F.col("id") * 6000 + 1).alias
    spark.range(100).select(k("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(200).select(k("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    met, hits = [], interaction.hits
    monkeypatch.setattr(interaction, "hits", lambda *a: met.append(hits(*a)) or met[-1])
    rows = query(spark, str(tmp_path)).collect()
    last = 199 * 6000 + 1
    assert met[0].count() == 1 and len(rows) == 100
    assert {r[-1] for r in rows} <= {last} and all(r["n"] == 200 for r in rows if "n" in r)


def test_tallied_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    some = lambda n, most: [float(v) for v in rnd.integers(0, most, n)]
    taps = [(i, int(rnd.integers(0, 3)), *some(2, 9), float(rnd.integers(0, 3))) for i in range(120)]
    taps += [(7, 1, 4.0, 4.0, 1.0), (7, 1, 4.0, 4.0, 1.0), (500, 9, 1.0, 1.0, 2.0), (501, 1, None, 1.0, 2.0)]
    kinds = {"point": 1, "polyline": 3, "rectangle": 2, "polygon": 3}
    shapes = []
    for i in range(90):
        kind = list(kinds)[i % 4]
        shapes.append((int(rnd.integers(0, 3)), i, f"s{i}", kind, [tuple(some(2, 5)) for _ in range(kinds[kind])], bool(i % 3)))
    shapes += [(*s[:1], s[1] + 1000, f"again {s[2]}", *s[3:]) for s in shapes[::2]]
    p = spark.createDataFrame(taps, "probe long, slide long, px double, py double, tolerance double")
    s = spark.createDataFrame(shapes, f"slide long, ord long, id string, type string, points {A.POINTS}, filled boolean")
    pairs = p.crossJoin(s.withColumnRenamed("slide", "on")).where("slide = on").where(A.hit(*(F.col(c) for c in ("type", "points", "filled", "px", "py", "tolerance"))))
    want = {r["probe"]: (r["n"], r["id"]) for r in pairs.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", "ord").alias("id")).collect()}
    got = {r["probe"]: (r["n"], r["id"]) for r in interaction.tallied(p, s, 4.0, 2.0).collect()}
    assert got == want and len(want) > 50


def test_equal_rectangles_are_read_once(spark, tmp_path, monkeypatch, sf):
    """300 rectangles, all of one place and size, meet the pixels of one."""
    spark.range(300).select((F.col("id") * 300 + 7).alias("p_partkey"), F.lit(20).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    met, of_regions = [], region.of_regions
    monkeypatch.setattr(region, "of_regions", lambda *a: met.append(of_regions(*a)) or met[-1])
    rows = queries_pixels.regions_batch(spark, str(tmp_path)).collect()
    area = (20 % 9 + 1) * (20 % 7 + 1) * 4
    assert met[0].count() == area and len(rows) == 300 and {r["n"] for r in rows} == {area}


def test_region_totals_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    values = rnd.integers(0, 256, (12, 16))
    pixels = spark.createDataFrame([(x // 4, y // 4, x, y, 0, int(values[y, x])) for y in range(12) for x in range(16) if (x // 4, y // 4) != (1, 1)], "tx long, ty long, x long, y long, c long, v long")
    rects = [(i, *(int(v) for v in rnd.integers(-3, 18, 2)), *(int(v) for v in rnd.integers(1, 9, 2))) for i in range(60)]
    rects += [(i + 100, *r) for i, *r in rects[::3]] + [rects[0]]
    want: dict = {}
    for i, x0, y0, w, h in rects:
        some = [int(values[y, x]) for y in range(max(0, y0), min(12, y0 + h)) for x in range(max(0, x0), min(16, x0 + w)) if (x // 4, y // 4) != (1, 1)]
        if some:
            n, total = want.get(i, (0, 0))
            want[i] = (n + len(some), total + sum(some))
    got = region.totals(spark.createDataFrame(rects, "region_id long, x0 long, y0 long, w long, h long"), pixels, 4).collect()
    assert {r["region_id"]: (r["n"], r["total"]) for r in got} == want
