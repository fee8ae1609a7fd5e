"""Streams of viewports and cache results."""

import datetime as dt
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.functions.register import register_functions
from tesserae.streaming import viewports as V

T0 = dt.datetime(2024, 1, 1)


def event(session, ms, flush=False, scale=1.0):
    return (session, T0 + dt.timedelta(milliseconds=ms), 640.0, 480.0, scale, 0.0, 0.0, flush)


def test_settle():
    frame = lambda *e: pd.DataFrame(e, columns=[c.split()[0] for c in V.EVENT.split(", ")])
    out, left = V.settle(frame(event("a", 0), event("a", 50), event("a", 200)), None)
    assert [e[1].microsecond for e in out] == [50_000] and left[1].microsecond == 200_000
    out, left = V.settle(frame(event("a", 20, flush=True)), tuple(event("a", 0)))
    assert len(out) == 1 and out[0][7] and left is None


def stream(spark, path, schema, rows_by_file):
    for i, rows in enumerate(rows_by_file):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


def test_debounced_stream(spark, tmp_path):
    s = stream(spark, tmp_path, V.EVENT, [[event("a", 0), event("a", 30), event("b", 0, flush=True)], [event("a", 500)]])
    query = V.debounced(s).writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        end = time.time() + 60
        while time.time() < end:
            got = sorted((r["session"], r["ts"].microsecond // 1000) for r in spark.table("debounced").collect())
            if len(got) >= 3:
                break
            time.sleep(0.5)
        assert got == [("a", 30), ("a", 500), ("b", 0)]
    finally:
        query.stop()


def test_cache_stream(spark, tmp_path):
    row = lambda seq, op, tx, wanted=True, reduction=0, ms=0: ("a", seq, T0 + dt.timedelta(milliseconds=ms or seq), op, 0, tx, 0, 0, reduction, 10, wanted)
    s = stream(spark, tmp_path, V.RESULT, [[row(1, "put", 1), row(2, "put", 2), row(3, "get", 1)], [row(4, "late", 3, False), row(5, "put", 3), row(6, "get", 2)], [row(7, "pressure", 0), row(8, "get", 1)], [row(9, "put", 1), row(10, "put", 1), row(11, "put", 2), row(12, "put", 3, ms=31_000), row(13, "put", 4, ms=31_001)]])
    query = V.cached(s, 20).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = {r["seq"]: (r["hit"], r["stored"], r["evicted"]) for r in spark.table("cached").collect()}
    assert got == {1: (False, True, 0), 2: (False, True, 0), 3: (True, False, 0), 4: (False, False, 0), 5: (False, True, 1), 6: (False, False, 0), 7: (False, False, 2), 8: (False, False, 0), 9: (False, True, 0), 10: (False, True, 0), 11: (False, True, 1), 12: (False, True, 0), 13: (False, True, 1)}


def test_sessions_end_by_the_watermark(spark, tmp_path):
    row = lambda session, seq, op, minutes: (session, seq, T0 + dt.timedelta(minutes=minutes), op, 0, 1, 0, 0, 0, 10, True)
    s = stream(spark, tmp_path, V.RESULT, [[row("a", 1, "put", 0)], [row("b", 1, "put", 90)], [row("b", 2, "get", 91)], [row("a", 2, "get", 92)]])
    query = V.cached(s, 20).writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert {(r["session"], r["seq"]): r["hit"] for r in spark.table("ended").collect()} == {("a", 1): False, ("b", 1): False, ("b", 2): True, ("a", 2): False}


def test_requests_of_a_batch(spark):
    from tesserae.plans.queries_meta import LEVELS

    kept = {}
    batch = spark.createDataFrame([event("a", 0), event("a", 50, scale=0.05)], V.EVENT)
    V.request_writer(LEVELS, 10_000_000, lambda df, i: kept.update({i: df.collect()}))(batch, 7)
    assert {r["level"] for r in kept[7]} == {2} and {r["vid"] for r in kept[7]} == {"a"}


def test_sql_functions(spark, tmp_path):
    from tests.test_slides import make, picture

    register_functions(spark)
    path = f"{tmp_path}/a.svs"
    make(path, 70, 60, 64)
    assert spark.sql(f"SELECT text FROM slide_tags('{path}') WHERE tag_name = 'ImageWidth' AND ifd_index = 0").first()["text"] == "[70]"
    assert spark.sql("SELECT count(*) AS n FROM visible_tiles(0, 2, 0, 1, 1, 1) WHERE ring <= 1").first()["n"] == 6
    rgba = bytearray(picture(9, 5).tobytes())
    df = spark.createDataFrame([(9, 5, rgba), (1, 1, None)], "w int, h int, rgba binary")
    coded = df.select(F.expr("encode_image(w, h, rgba, 'jpeg', 95)").alias("d"))
    back = coded.select(F.expr("decode_tile(d, 7, 6, 0)").alias("r")).collect()
    assert back[0]["r"]["width"] == 9 and len(back) == 2
    with pytest.raises(Exception):
        df.select(F.expr("encode_image(w, h, rgba, 'gif', 1)")).collect()
