"""Physical plans that must hold when the data is a million times larger."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog.kernels import K35
from sparkgrid.operators import conv, rank, relate, shape, tiles as tl
from sparkgrid.plans import restore as rs
from sparkgrid.sources.cells import list_files, read_cells, write_cells
from tests.conftest import SCHEMA

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def body(df):
    """The plan as first made, without the executed copy AQE prints."""
    return plan(df).split("== Initial Plan ==")[-1]


@pytest.fixture(scope="module")
def wk(spark):
    from sparkgrid.core import settle
    return settle(fx.cells_wk(spark, SF))


def test_convolution_has_one_exchange_and_no_loop_join(wk):
    text = body(conv.convolve(wk, K35))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_update_has_one_exchange(wk):
    opt = rs.Options(niter=1)
    from sparkgrid.core import settle
    state = settle(rs.prepare(wk, K35, opt))
    assert len(re.findall(r"Exchange hashpartitioning", body(rs.rl_step(state, K35, 3, opt)))) == 1


def test_halo_is_arithmetic_not_a_range_join(spark, wk):
    grid = spark.createDataFrame([("li", 10, 358, 2, 5)], "img string, h int, w int, ny int, nx int")
    text = body(tl.assign_halo(wk, grid, 3, 4))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Exchange hashpartitioning" not in text


def test_scan_prunes_partitions_and_pushes_filters(spark, wk, tmp_path):
    path = str(tmp_path / "cells")
    write_cells(wk, path)
    text = plan(read_cells(spark, path, t=0, c=0).select("v"))
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", text)[1]
    assert re.search(r"\(t#\d+ = 0\)", filters) and re.search(r"\(c#\d+ = 0\)", filters)
    assert "ReadSchema: struct<v:double>" in text


def test_order_statistics_never_window_over_a_whole_group(wk):
    """Windows see bucket counts or one bucket, not the cells of an image."""
    text = body(rank.background_level(wk))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", text)
    assert windows and all("b#" in w for w in windows)


def test_pyramid_levels_share_the_first_exchange(wk):
    df = shape.pyramid(wk, 3)
    df.collect()
    assert "ReusedExchange" in plan(df) or plan(df).count("ShuffleQueryStage 0") > 1


def test_dictionary_codes_without_keys(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 1.0, 5.0, 3.0]], "v double")
    got = {r.v: (r.code, r.sq) for r in relate.dictionary_encode(df, "v", lambda v: v * v, "sq").collect()}
    assert got == {1.0: (0, 1.0), 3.0: (1, 9.0), 5.0: (2, 25.0)}


def test_one_hot_image_is_spread_over_blocks(spark):
    """One image holds all rows; its work still reaches several partitions."""
    rows = [("hot", 0, 0, 0, y, x, 1.0) for y in range(0, 400, 2) for x in range(0, 400, 20)]
    df = conv.convolve(spark.createDataFrame(rows, SCHEMA), K35)
    used = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1


def test_list_files_counts_stores_once(spark, tmp_path):
    (tmp_path / "a.zarr" / "0").mkdir(parents=True)
    for f in ("a.zarr/0/x", "a.zarr/y", "b.TIF", "c.txt"):
        (tmp_path / f).write_bytes(b"1234")
    got = [(r.name, r.length) for r in list_files(spark, str(tmp_path), ["tif", ".zarr"]).collect()]
    assert got == [("a.zarr", 8), ("b.TIF", 4)]


def test_stream_results_survive_a_rerun(spark, to_cells, tmp_path):
    from sparkgrid.catalog.restoration import taps_block
    from sparkgrid.streaming.restoration import restore_stream

    cells = to_cells(a=np.ones((6, 6)))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    cells.write.parquet(src)
    for run in ("c1", "c2"):  # a new checkpoint repeats the batch
        live = spark.readStream.schema(cells.schema).parquet(src)
        restore_stream(live, taps_block(K35), out, str(tmp_path / run), niter=1).awaitTermination()
    assert spark.read.parquet(out).count() == 36


def test_channels_that_come_in_pieces_are_held(spark, to_cells, tmp_path):
    from sparkgrid.catalog.restoration import taps_block
    from sparkgrid.streaming.restoration import held_cells, restore_stream

    rng = np.random.default_rng(1)
    cells = to_cells(a=rng.random((6, 7)) * 50 + 5, b=rng.random((6, 7)) * 50 + 5)
    sizes = spark.createDataFrame([("a", 1, 6, 7), ("b", 1, 6, 7)], "img string, nz int, ny int, nx int")
    src, out, run = (str(tmp_path / n) for n in ("src", "out", "run"))

    def deliver(rows):
        rows.coalesce(1).write.mode("append").parquet(src)
        live = spark.readStream.schema(cells.schema).parquet(src)
        restore_stream(live, taps_block(K35), out, run, sizes, niter=1).awaitTermination()

    deliver(cells.filter("y < 3"))
    assert held_cells(spark, run, 0).count() == 42 and not (tmp_path / "out").exists()
    wrong = cells.filter("img = 'a' AND y = 2").withColumn("v", cells["v"] + 1)  # comes again with the rest, then right
    deliver(wrong.unionByName(cells.filter("img = 'a' AND y = 2").withColumn("y", cells["y"] + 50)))  # outside the size
    deliver(cells.filter("img = 'a' AND y >= 2"))
    assert {r.img for r in spark.read.parquet(out).select("img").distinct().collect()} == {"a"}
    assert {r.img for r in held_cells(spark, run, 2).collect()} == {"b"}
    deliver(cells.filter("img = 'b' AND y >= 3"))
    assert held_cells(spark, run, 3).count() == 0 and not (tmp_path / "run-held" / "1").exists()
    whole = str(tmp_path / "whole")
    cells.write.parquet(str(tmp_path / "once"))
    live = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "once"))
    restore_stream(live, taps_block(K35), whole, str(tmp_path / "run2"), niter=1).awaitTermination()
    both = [sorted(tuple(r) for r in spark.read.parquet(p).select("img", "y", "x", "v").collect()) for p in (out, whole)]
    assert len(both[0]) == 84 and np.allclose([r[3] for r in both[0]], [r[3] for r in both[1]])


def test_dense_code_loads_without_this_package(tmp_path):
    """Executors that do not have the package installed can still run tiles."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from sparkgrid.plans import dense, tiled  # noqa: F401  (registers the module)

    f = tmp_path / "code"
    f.write_bytes(cloudpickle.dumps((dense.solve, dense.Job, dense.advance)))
    code = f"import pickle, pyspark.cloudpickle; pickle.load(open({str(f)!r}, 'rb'))"
    subprocess.run([sys.executable, "-c", code], cwd="/", check=True, env={"PATH": "/usr/bin"})


def test_cells_in_small_files_are_not_broadcast(spark):
    """A cell table of a few hundred kilobytes of files has many megabytes of rows."""
    from sparkgrid.core import attach, held_bytes, planned_bytes, settle
    from sparkgrid.plans import keyed

    cells = settle(spark.range(60 * 1024).select(
        F.concat(F.lit("u"), F.floor(F.col("id") / 1024)).alias("img"), F.lit(0).alias("t"), F.lit(0).alias("c"), F.lit(0).alias("z"),
        (F.floor(F.col("id") / 32) % 32).cast("int").alias("y"), (F.col("id") % 32).cast("int").alias("x"), F.lit(1.0).alias("v")))
    groups = cells.select("img", "t", "c").distinct().select("*", *[F.lit(n).alias(k) for k, n in (
        ("nz", 1), ("ny", 32), ("nx", 32), ("hiz", 0), ("hiy", 1), ("hix", 2), ("loz", 0), ("loy", -1), ("lox", -2))],
        F.lit(1.0).alias("mean"), F.lit(1.0).alias("bg"))
    written = []
    keep, keyed.settle = keyed.settle, lambda df: written.append(df) or df
    try:
        keyed.start(cells, groups, rs.Options())
    finally:
        keyed.settle = keep
    assert "BroadcastHashJoin" not in body(written[-1])
    assert planned_bytes(cells) < 1 << 20 < 4 << 20 < held_bytes(cells)
    limit = planned_bytes(cells)  # as many bytes of files are allowed, but not of rows
    assert "BroadcastHashJoin" not in body(attach(cells, cells.withColumnRenamed("v", "w"), ["img", "t", "c", "z", "y", "x"], limit=limit))


def test_a_streamed_channel_is_one_file(spark, to_cells, tmp_path):
    """The blend leaves a channel's cells in all tasks; each wrote a file of its own for every channel."""
    from sparkgrid.catalog.restoration import taps_block
    from sparkgrid.streaming.restoration import restore_stream

    cells = to_cells(**{f"i{k}": np.ones((6, 6)) for k in range(12)})
    src, out = str(tmp_path / "src"), tmp_path / "out"
    cells.write.parquet(src)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        live = spark.readStream.schema(cells.schema).parquet(src)
        restore_stream(live, taps_block(K35), str(out), str(tmp_path / "run"), niter=1).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(out.rglob("*.parquet"))) == 12 and spark.read.parquet(str(out)).count() == 12 * 36


def test_streamed_channels_can_share_files(spark, to_cells, tmp_path):
    """A folder, a file and a rename for every small channel took most of the time; cells that come again replace the old ones."""
    from sparkgrid.catalog.restoration import taps_block
    from sparkgrid.streaming.restoration import restore_stream

    cells = to_cells(**{f"i{k}": np.random.default_rng(k).random((6, 6)) * 9 + 1 for k in range(12)})
    src, own, shared = str(tmp_path / "src"), tmp_path / "own", tmp_path / "shared"
    cells.write.parquet(src)

    def run(out, checkpoint, **options):
        live = spark.readStream.schema(cells.schema).parquet(src)
        restore_stream(live, taps_block(K35), str(out), str(tmp_path / checkpoint), niter=1, **options).awaitTermination()

    run(own, "c1")
    run(shared, "c2", shared=True)
    run(shared, "c3", shared=True)  # a new checkpoint repeats the batch
    assert len(list(shared.rglob("*.parquet"))) < 12
    both = [sorted(tuple(r) for r in spark.read.parquet(str(p)).select("img", "t", "c", "y", "x", "v").collect()) for p in (own, shared)]
    assert len(both[0]) == 12 * 36 and both[0] == both[1]
    for out, options in ((own, {"shared": True}), (shared, {})):
        with pytest.raises(Exception, match="other layout"):
            run(out, f"c-{out.name}", **options)


def test_pieces_of_a_stream_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """One task wrote a third of all cells for every trigger; there are still three triggers."""
    from pathlib import Path

    from sparkgrid.catalog import streams

    folders = []
    make = streams.shared_folder
    monkeypatch.setattr(streams, "shared_folder", lambda s: folders.append(make(s)) or folders[-1])
    monkeypatch.setattr(streams, "TASK_ROWS", 1000)
    rows = streams._t4_pieces(spark, "/root/testdata/sf0.01").count()
    assert rows == 10800 and len(list(Path(folders[0]).glob("*.parquet"))) == 3 * 4
    assert {f.name for f in Path(folders[2] + "-held").iterdir()} == {"1", "2"}
