from __future__ import annotations

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.catalog.kernels import K35
from sparkgrid.catalog.restoration import rl_sql, taps_block
from sparkgrid.catalog.sources import shared_folder
from sparkgrid.core import CELL, TASK_ROWS, extents, rnd, settle
from sparkgrid.fixtures import with_sql
from sparkgrid.streaming import restoration as sr, telemetry as tm


def _stream(spark, sf):
    """The events table as a file stream with instants as event time."""
    schema = fx.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("proc"), "value")


def _drain(spark, start):
    out, chk = shared_folder(spark), shared_folder(spark)
    start(out, chk).awaitTermination()
    return spark.read.parquet(out)


@query("t1_telemetry_windows", with_sql("telemetry") + """
SELECT proc, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(avg(value), 5) AS avg, max(value) AS peak, count(*) AS n
FROM telemetry GROUP BY ALL HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM telemetry) - INTERVAL 1 HOUR""")
def _t1(spark, sf):
    w = _drain(spark, lambda o, c: tm.append_to(tm.telemetry_windows(_stream(spark, sf)), o, c))
    return w.select("proc", F.date_format("start", "yyyy-MM-dd").alias("day"), rnd("avg", 5).alias("avg"), "peak", "n")


@query("t2_peak_over_baseline", with_sql("telemetry") + """
SELECT proc, max(value) AS peak, arg_min(value, (ts, value)) AS baseline, round(max(value) - arg_min(value, (ts, value)), 5) AS delta
FROM telemetry GROUP BY proc""")
def _t2(spark, sf):
    p = _drain(spark, lambda o, c: tm.replace_at(tm.peak_over_baseline(_stream(spark, sf)), o, c))
    return p.select("proc", "peak", "baseline", rnd("delta", 5).alias("delta"))


@query("t3_running_levels", with_sql("telemetry") + """
SELECT proc, least(greatest(floor(value / 400 * 64), 0), 63)::INT AS bin, count(*) AS n, max(value) AS peak FROM telemetry GROUP BY ALL""")
def _t3(spark, sf):
    return _drain(spark, lambda o, c: tm.replace_at(tm.running_levels(_stream(spark, sf), 400.0), o, c))


T4 = rl_sql("cells_ti", K35, 2) + " SELECT img, c, z, y, x, round(greatest(xc - 5, 0), 6) AS v FROM s2 WHERE d IS NOT NULL"


@query("t4_restore_stream", T4)
def _t4(spark, sf):
    src = shared_folder(spark)
    frames = fx.cells_t(spark, sf)
    frames.write.mode("overwrite").parquet(src)
    live = spark.readStream.schema(frames.schema).parquet(src)
    r = _drain(spark, lambda o, c: sr.restore_stream(live, taps_block(K35), o, c, shared=True, niter=2))
    return r.select(F.concat_ws("#", "img", F.col("t").cast("string")).alias("img"), "c", "z", "y", "x", rnd("v").alias("v"))


@query("t4_restore_pieces", T4)
def _t4_pieces(spark, sf):
    """Every channel comes in pieces over three triggers and is solved once it is whole."""
    src = shared_folder(spark)
    frames = settle(fx.cells_t(spark, sf))
    sizes = settle(extents(frames, ["img", "t"]))
    files = -(-frames.count() // (3 * TASK_ROWS)) or 1
    for piece in range(3):
        frames.filter((F.col("y") + F.col("x")) % 3 == piece).repartition(files, *CELL).write.mode("append").parquet(src)
    live = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", files).parquet(src)
    r = _drain(spark, lambda o, c: sr.restore_stream(live, taps_block(K35), o, c, sizes, shared=True, niter=2))
    return r.select(F.concat_ws("#", "img", F.col("t").cast("string")).alias("img"), "c", "z", "y", "x", rnd("v").alias("v"))
