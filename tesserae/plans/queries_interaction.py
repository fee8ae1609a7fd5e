"""Catalogue: taps, drafts, selections, requests in flight, admissions to the cache, and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tesserae.functions import annotations as A, geometry as G
from tesserae.functions.adjust import Adjustments
from tesserae.operators import cache, interaction, viewport
from tesserae.plans.slide import table
from tesserae.streaming.viewports import under_pressure

MODES = ("none", "point", "rectangle", "polyline", "polygon")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("k"))


_E = "e AS (SELECT CAST(event_id AS BIGINT) AS k FROM events)"
double = lambda c: c.cast("double")


def tap_dispatch(spark, sf_dir):
    """What every tap of 40 sessions does, which change their modes every seventh event."""
    k = F.col("k")
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.floor(k / 7) % 5 + 1).cast("int"))
    log = _events(spark, sf_dir).select((k % 40).cast("string").alias("session"), k.alias("seq"), F.when(k % 7 == 0, "mode").otherwise("tap").alias("op"), F.when(k % 7 == 0, mode).alias("mode"))
    log = log.select("*", double(F.col("seq") * 13 % 1920).alias("x"), double(F.col("seq") * 17 % 1080).alias("y"), (F.lit(0.25) * (1 + F.col("seq") % 8)).alias("scale"), double(F.col("seq") * 3 % 999).alias("ox"), double(F.col("seq") % 777).alias("oy"))
    return interaction.dispatched(interaction.with_mode(log).where("op = 'tap'"))


_DISPATCH = f"""WITH {_E}, l AS (SELECT k, k % 40 AS s, CASE WHEN k % 7 = 0 THEN (['none', 'point', 'rectangle', 'polyline', 'polygon'])[k // 7 % 5 + 1] END AS mode, 0.25 * (1 + k % 8)::DOUBLE AS scale FROM e),
m AS (SELECT *, coalesce(last_value(mode IGNORE NULLS) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') AS cur FROM l)
SELECT CAST(s AS VARCHAR) AS session, k AS seq, CASE cur WHEN 'point' THEN 'commit_point' WHEN 'none' THEN 'hit_test' ELSE 'add_vertex' END AS action, CAST(k * 3 % 999 AS DOUBLE) + CAST(k * 13 % 1920 AS DOUBLE) / scale AS px, CAST(k % 777 AS DOUBLE) + CAST(k * 17 % 1080 AS DOUBLE) / scale AS py, 12 / scale AS tolerance
FROM m WHERE k % 7 <> 0 AND cur <> 'rectangle'"""


def draw_commits(spark, sf_dir):
    """Shapes that one session an event draws: a mode, some taps or a drag, and the end."""
    k = F.col("k")
    n = k % 5
    event = lambda seq, op, x, y, mode=None: F.struct(seq.cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(mode).cast("string").alias("mode") if not hasattr(mode, "cast") else mode.alias("mode"), double(x).alias("x"), double(y).alias("y"))
    zero = F.lit(0)
    mode = F.element_at(F.array(*(F.lit(m) for m in ("point", "polyline", "polygon", "rectangle"))), (k % 4 + 1).cast("int"))
    taps = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: event(i + 1, "tap", i * 10 + k % 7, i * 5))).otherwise(F.array().cast("array<struct<seq:bigint,op:string,mode:string,x:double,y:double>>"))
    drag = F.array(event(n + 2, "start", k % 7, zero), event(n + 3, "move", n, zero), event(n + 4, "end", zero, zero))
    log = F.concat(F.array(event(F.lit(1), "mode", zero, zero, mode)), taps, F.when(k % 4 == 3, drag).otherwise(F.array(event(n + 2, "finish", zero, zero))))
    rows = _events(spark, sf_dir).select(k.cast("string").alias("session"), F.explode(log).alias("e")).select("session", "e.*")
    return interaction.drawn(rows).select("session", "seq", "type", F.size("points").cast("long").alias("n_points"), F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["x"]).alias("sum_x"))


_DRAW = f"""WITH {_E}, t AS (SELECT k, k % 5 AS n, k % 4 AS m FROM e), p AS (SELECT k, m, n, unnest(range(1, n + 1)) AS i FROM t)
SELECT CAST(k AS VARCHAR) AS session, i + 1 AS seq, 'point' AS type, CAST(1 AS BIGINT) AS n_points, CAST(i * 10 + k % 7 AS DOUBLE) AS sum_x FROM p WHERE m = 0
UNION ALL SELECT CAST(k AS VARCHAR), n + 2, CASE m WHEN 1 THEN 'polyline' ELSE 'polygon' END, n, CAST(5 * n * (n + 1) + n * (k % 7) AS DOUBLE) FROM t WHERE m IN (1, 2) AND n >= m + 1
UNION ALL SELECT CAST(k AS VARCHAR), n + 4, 'rectangle', 2, CAST(k % 7 + n AS DOUBLE) FROM t WHERE m = 3 AND k % 7 <> n"""


def selected_annotation(spark, sf_dir):
    k = F.col("k")
    e = _events(spark, sf_dir)
    log = e.select((k % 60).cast("string").alias("session"), k.alias("seq"), F.lit("select").alias("op"), F.when(k % 11 != 0, (k * 7 % 50).cast("string")).alias("id"))
    live = e.where("k < 3000").select((k % 60).cast("string").alias("session"), (F.floor(k / 60)).cast("string").alias("id"), k.alias("payload"))
    return interaction.selection(log, live)


_SELECTED = f"""WITH {_E}, l AS (SELECT CAST(k % 60 AS VARCHAR) AS session, arg_max(struct_pack(id := CASE WHEN k % 11 <> 0 THEN CAST(k * 7 % 50 AS VARCHAR) END), k).id AS selected_id FROM e GROUP BY 1)
SELECT l.session, selected_id, v.k AS selected FROM l LEFT JOIN e v ON v.k < 3000 AND CAST(v.k % 60 AS VARCHAR) = l.session AND CAST(v.k // 60 AS VARCHAR) = selected_id"""


def annotation_copy(spark, sf_dir):
    """Copies with a new label for every third, a new width for every other one, and no new id or type."""
    k = F.col("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), "o_orderpriority")
    old = {"id": k, "type": F.lit("point"), "stroke_width": F.lit(2.0), "filled": F.lit(False), "label": F.col("o_orderpriority")}
    new = {"id": -k, "type": F.lit("polygon"), "stroke_width": F.when(k % 2 == 0, double(k % 9)), "filled": F.when(k % 5 == 0, True), "label": F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string")))}
    return o.select(*interaction.copy_with(old, new))


_COPY = "SELECT CAST(o_orderkey AS BIGINT) AS id, 'point' AS type, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS DOUBLE) ELSE 2.0::DOUBLE END AS stroke_width, o_orderkey % 5 = 0 AS filled, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_orderkey ELSE o_orderpriority END AS label FROM orders"


def annotation_ids(spark, sf_dir):
    """Ids are made of their keys and differ by row."""
    k = F.col("k")
    i = interaction.annotation_id(F.lit("s"), k)
    return _events(spark, sf_dir).select(k, i.alias("i")).groupBy(F.split("i", "-")[1].alias("session")).agg(F.count_distinct("i").alias("n"), F.sum(F.split("i", "-")[2].cast("long")).alias("total"))


def _requests(spark, sf_dir, shift: int) -> DataFrame:
    k = F.col("k")
    e = _events(spark, sf_dir)
    return e.select((k % 500).alias("vid"), ((k + shift) % 3).alias("level"), (k * 7 % 20).alias("tx"), (k * (3 + shift) % 13).alias("ty"), F.lit(0).cast("long").alias("span")).distinct()


def stale_requests(spark, sf_dir):
    return viewport.stale(_requests(spark, sf_dir, 0), _requests(spark, sf_dir, 1))


_R = "SELECT DISTINCT k % 500 AS vid, (k + {0}) % 3 AS level, k * 7 % 20 AS tx, k * (3 + {0}) % 13 AS ty, CAST(0 AS BIGINT) AS span FROM e"


def _results(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    e = _events(spark, sf_dir)
    return e.select((k % 30).alias("session"), k.alias("seq"), (k % 3).alias("level"), (k * 7 % 20).alias("tx"), (k * 5 % 13).alias("ty"), (k % 2).alias("span"), (k % 4).alias("reduction"), (k % 64 + 1).alias("byte_size"), (k % 5 != 0).alias("wanted"), (k % 3).alias("wanted_reduction"), F.when(k % 6 < 4, "visible").otherwise("prefetch").alias("priority"), (k % 7 == 0).alias("from_disk"))


def _admitted(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    e = _events(spark, sf_dir)
    budgets = e.where("k < 30").select(k.alias("session"), (k * 3).alias("used"), F.lit(100).cast("long").alias("max_bytes"))
    cached = e.where("k < 6000").select((k % 30).alias("session"), (k % 3).alias("level"), (k * 11 % 20).alias("tx"), (k * 5 % 13).alias("ty"), (k % 2).alias("span"), (k % 3).alias("reduction"))
    return cache.admitted(_results(spark, sf_dir), budgets, cached)


def store_results(spark, sf_dir):
    return _admitted(spark, sf_dir).select("session", "seq", "stored", "fetch_again", "persist")


def persist_queue(spark, sf_dir):
    return cache.persist_queue(_admitted(spark, sf_dir)).select("session", "seq", "turn")


_ADMITTED = f"""{_E}, c AS (SELECT k % 30 AS s, k % 3 AS level, k * 11 % 20 AS tx, k * 5 % 13 AS ty, k % 2 AS span, min(k % 3) AS have FROM e WHERE k < 6000 GROUP BY ALL),
r AS (SELECT k, k % 30 AS s, k % 5 <> 0 AS wanted, k % 4 AS red, (k % 5 <> 0 OR b.used + k % 64 + 1 <= 100) AND coalesce(c.have >= k % 4, true) AS stored, k % 30 AS session FROM e JOIN (SELECT k AS bs, k * 3 AS used FROM e WHERE k < 30) b ON b.bs = k % 30
LEFT JOIN c ON c.s = k % 30 AND c.level = k % 3 AND c.tx = k * 7 % 20 AND c.ty = k * 5 % 13 AND c.span = k % 2),
a AS (SELECT session, k AS seq, stored, stored AND wanted AND red > k % 3 AS fetch_again, stored AND wanted AND k % 7 <> 0 AND red = 0 AND k % 2 = 0 AND k % 6 < 4 AS persist FROM r)"""


def pressure_windows(spark, sf_dir):
    """Events within 30 seconds after a memory warning of their user."""
    k = F.col("k")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("k"), F.col("user_id").cast("string").alias("session"), "ts", F.when(F.col("event_id") % 5 == 0, "pressure").otherwise("get").alias("op"))
    return under_pressure(e).select(k, "pressed")


def wheel_zoom(spark, sf_dir):
    k = F.col("k")
    return _events(spark, sf_dir).select(k, F.round(G.wheel_factor(double(k % 400 - 200)), 9).alias("factor"))


def overview_match(spark, sf_dir):
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    w, h = k % 700 + 300, k * 7 % 600 + 300
    return p.select(k, G.overview_matches(w, h, F.lit(40000), F.lit(30000)).alias("matches"))


def thumbnail_size(spark, sf_dir):
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    w, h = G.fit_square(k * 13 % 3000 + 1, k * 7 % 2000 + 1, 256)
    return p.select(k, w.alias("width"), h.alias("height"))


def color_matrices(spark, sf_dir):
    """Rows of the colour matrix that some adjustments make, and none for the identity."""
    some = [Adjustments(), Adjustments(brightness=0.5), Adjustments(contrast=-0.5), Adjustments(shadows=1.0, highlights=0.5)]
    rows = [(i, a.is_identity, len(a.matrix() or []), *(round(x, 9) for x in (a.matrix() or [1.0, 0.0, 0.0, 0.0, 0.0])[:5:4])) for i, a in enumerate(some)]
    return spark.createDataFrame(rows, "k bigint, identity boolean, n bigint, slope double, shift double")


def segment_distances(spark, sf_dir):
    """Distance of a point from each segment of a line item, which may have no length."""
    k = F.col("k")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey").cast("long").alias("k"))
    at = lambda x, y: F.struct(double(x).alias("x"), double(y).alias("y"))
    d = A.segment_distance(double(k % 50), double(k % 30), at(k % 20, k % 10), at(k % 20 + k % 3 * 10, k % 10 + k % 3 * 5))
    return li.select("l_orderkey", "l_linenumber", F.round(d, 6).alias("distance"))


def polyline_hits(spark, sf_dir):
    """Taps on an open line of three points: the closing edge does not count."""
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    points = F.array(at(0, 0), at(100, 0), at(100, 100))
    return p.select(k, *(A.hit(F.lit(kind), points, F.lit(False), double(k % 110), double(k * 7 % 110), F.lit(3.0)).alias(kind) for kind in ("polyline", "polygon")))


def grid_hits(spark, sf_dir):
    """All rectangles that taps of a slide hit, by the cells of a grid."""
    k = F.col("k")
    e = _events(spark, sf_dir).select(k.alias("probe"), (k % 2000).alias("slide"), double(k * 7 % 100).alias("px"), double(k * 11 % 100).alias("py"), double(k % 3).alias("tolerance"))
    o = F.col("o_orderkey").cast("long")
    at = lambda x, y: F.struct(double(x).alias("x"), double(y).alias("y"))
    points = F.array(at(o * 3 % 80, o * 5 % 80), at(o * 3 % 80 + 10, o * 5 % 80 + 15))
    shapes = table(spark, sf_dir, "orders").select((o % 2000).alias("slide"), o.alias("ord"), o.alias("id"), F.lit("rectangle").alias("type"), points.alias("points"), F.lit(True).alias("filled"))
    return interaction.tallied(e, shapes, 16.0, 2.0).withColumnRenamed("id", "top")


def annotation_lists(spark, sf_dir):
    """The ordered list of a customer's annotations as JSON, and what a reader makes of it."""
    k = F.col("k")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("c"), F.col("o_orderkey").cast("long").alias("k"))
    point = F.array(F.struct(double(k % 100).alias("x"), double(k % 50).alias("y")))
    text = A.to_json(k.cast("string"), F.lit("point"), point, F.lit(1).cast("long"), F.lit(2.0), F.lit(False), F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))))
    lists = o.groupBy("c").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("k", text.alias("t"))))["t"], ","), F.lit("]")).alias("json"))
    back = lists.select("c", F.posexplode(F.from_json("json", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in A.JSON.split(', '))}>>")).alias("place", "a"))
    return back.select("c", F.col("place").cast("long").alias("place"), F.col("a.id").alias("id"), F.col("a.label").alias("label"), F.col("a.points")[0][0].alias("x"))


def level_downsamples(spark, sf_dir):
    """Each level's downsample from the widths of a slide's levels."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("slide"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    c = c.withColumn("width", F.call_function("shiftright", F.col("slide") * 37 % 5000 + 4000, F.col("level")))
    base = F.first("width").over(Window.partitionBy("slide").orderBy("level"))
    return c.select("slide", F.col("level").cast("long").alias("level"), F.round(base / F.col("width"), 9).alias("downsample"))


def minimap_taps(spark, sf_dir):
    k = F.col("k")
    return _events(spark, sf_dir).select(k, G.minimap_target(double(k % 300 - 20), F.lit(160.0), F.lit(40000.0)).alias("x"))


QUERIES = {
    "tap_dispatch": (tap_dispatch, _DISPATCH),
    "draw_commits": (draw_commits, _DRAW),
    "selected_annotation": (selected_annotation, _SELECTED),
    "annotation_copy": (annotation_copy, _COPY),
    "annotation_ids": (annotation_ids, f"WITH {_E} SELECT 's' AS session, count(DISTINCT k) AS n, CAST(sum(k) AS BIGINT) AS total FROM e"),
    "stale_requests": (stale_requests, f"WITH {_E} {_R.format(0)} EXCEPT {_R.format(1)}"),
    "store_results": (store_results, f"WITH {_ADMITTED} SELECT session, seq, stored, fetch_again, persist FROM a"),
    "persist_queue": (persist_queue, f"WITH {_ADMITTED} SELECT session, seq, turn FROM (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS turn FROM a WHERE persist) WHERE turn <= 8"),
    "pressure_windows": (
        pressure_windows,
        "SELECT CAST(event_id AS BIGINT) AS k, coalesce(epoch_ms(ts) - epoch_ms(max(CASE WHEN event_id % 5 = 0 THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) < 30000, false) AS pressed FROM events",
    ),
    "wheel_zoom": (wheel_zoom, f"WITH {_E} SELECT k, round(exp(-(k % 400 - 200) * 0.001), 9) AS factor FROM e"),
    "overview_match": (overview_match, "SELECT CAST(p_partkey AS BIGINT) AS k, abs(((p_partkey % 700 + 300)::DOUBLE / (p_partkey * 7 % 600 + 300)) / (40000.0::DOUBLE / 30000) - 1) < 0.02 AS matches FROM part"),
    "thumbnail_size": (
        thumbnail_size,
        """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_partkey * 13 % 3000 + 1 AS w, p_partkey * 7 % 2000 + 1 AS h FROM part), s AS (SELECT *, least(1.0::DOUBLE, 256.0::DOUBLE / greatest(w, h)) AS s FROM p)
SELECT k, greatest(1, CAST(round(w * s) AS BIGINT)) AS width, greatest(1, CAST(round(h * s) AS BIGINT)) AS height FROM s""",
    ),
    "color_matrices": (
        color_matrices,
        "SELECT CAST(k AS BIGINT) AS k, i AS identity, CAST(n AS BIGINT) AS n, CAST(a AS DOUBLE) AS slope, CAST(b AS DOUBLE) AS shift FROM (VALUES (0, true, 0, 1, 0), (1, false, 20, 1, 63.75), (2, false, 20, 0.5, 63.75), (3, false, 20, 0.55, 76.5)) t(k, i, n, a, b)",
    ),
    "segment_distances": (
        segment_distances,
        """WITH s AS (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (l_partkey % 50)::DOUBLE AS px, (l_partkey % 30)::DOUBLE AS py, (l_partkey % 20)::DOUBLE AS ax, (l_partkey % 10)::DOUBLE AS ay, (l_partkey % 3 * 10)::DOUBLE AS dx, (l_partkey % 3 * 5)::DOUBLE AS dy FROM lineitem),
t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) END AS t FROM s)
SELECT l_orderkey, l_linenumber, round(sqrt((px - ax - dx * t) * (px - ax - dx * t) + (py - ay - dy * t) * (py - ay - dy * t)), 6) AS distance FROM t""",
    ),
    "polyline_hits": (
        polyline_hits,
        """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, (p_partkey % 110)::DOUBLE AS x, (p_partkey * 7 % 110)::DOUBLE AS y FROM part),
d AS (SELECT k, sqrt((x - least(greatest(x, 0), 100)) ** 2 + y ** 2) AS a, sqrt((x - 100) ** 2 + (y - least(greatest(y, 0), 100)) ** 2) AS b, least(greatest((x + y) / 200, 0), 1) * 100 AS t, x, y FROM p)
SELECT k, a <= 3 OR b <= 3 AS polyline, a <= 3 OR b <= 3 OR sqrt((x - t) ** 2 + (y - t) ** 2) <= 3 AS polygon FROM d""",
    ),
    "grid_hits": (
        grid_hits,
        """WITH taps AS (SELECT CAST(event_id AS BIGINT) AS probe, event_id % 2000 AS slide, CAST(event_id * 7 % 100 AS DOUBLE) AS px, CAST(event_id * 11 % 100 AS DOUBLE) AS py, CAST(event_id % 3 AS DOUBLE) AS tol FROM events),
s AS (SELECT o_orderkey % 2000 AS slide, CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey * 3 % 80 AS DOUBLE) AS l, CAST(o_orderkey * 5 % 80 AS DOUBLE) AS t, CAST(o_orderkey * 3 % 80 + 10 AS DOUBLE) AS r, CAST(o_orderkey * 5 % 80 + 15 AS DOUBLE) AS b FROM orders),
d AS (SELECT probe, id, tol, px >= l AND px < r AND py >= t AND py < b AS inside, px - least(greatest(px, l), r) AS cx, py - least(greatest(py, t), b) AS cy, least(px - l, r - px, py - t, b - py) AS depth FROM taps JOIN s USING (slide))
SELECT probe, count(*) AS n, max(id) AS top FROM d WHERE inside OR (CASE WHEN depth >= 0 THEN depth ELSE sqrt(cx * cx + cy * cy) END) <= tol GROUP BY probe""",
    ),
    "annotation_lists": (
        annotation_lists,
        "SELECT CAST(o_custkey AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'n' || o_orderkey END AS label, CAST(o_orderkey % 100 AS DOUBLE) AS x FROM orders",
    ),
    "level_downsamples": (
        level_downsamples,
        "SELECT CAST(c_custkey AS BIGINT) AS slide, CAST(l AS BIGINT) AS level, round((c_custkey * 37 % 5000 + 4000)::DOUBLE / ((c_custkey * 37 % 5000 + 4000)::BIGINT >> l), 9) AS downsample FROM customer, range(0, 4) t(l)",
    ),
    "minimap_taps": (minimap_taps, f"WITH {_E} SELECT k, least(greatest((k % 300 - 20)::DOUBLE / 160, 0), 1) * 40000 AS x FROM e"),
}
