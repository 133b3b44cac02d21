"""What one task holds must not grow with the tables."""

import re

import numpy as np
from pyspark.sql import functions as F

from sparkgrid import catalog, core, fixtures as fx
from sparkgrid.operators import relate, shape
from sparkgrid.sources.cells import densify, read_cells, write_cells
from tests.conftest import SCHEMA
from tests.test_plans import SF, body


def dealt_to(df):
    """Partition counts of the exchanges asked for in the code."""
    return [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", body(df))]


def test_boxes_of_more_points_get_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(core, "TASK_ROWS", 500)
    cells = spark.createDataFrame([("a", 0, 0, 0, 3, 4, 2.0), ("a", 0, 0, 0, 99, 99, 1.0)], SCHEMA)
    groups = cells.groupBy("img", "t", "c").agg(F.max("y").alias("my"))
    zero = F.lit(0)
    full = densify(cells, groups, {"z": (zero, zero), "y": (zero, F.col("my")), "x": (zero, F.lit(99))})
    assert len(dealt_to(full)) == 3 and set(dealt_to(full)) == {20}
    assert full.count() == 10_000 and full.agg(F.sum("v")).first()[0] == 3.0


def test_rows_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """A task that reads files would group all rows of its share of them."""
    monkeypatch.setattr(core, "TASK_ROWS", 500)
    text = body(fx.cells_li(spark, SF))
    assert text.rindex("Exchange hashpartitioning") > text.rindex("HashAggregate")
    assert text.count("Exchange hashpartitioning") == 1
    assert dealt_to(fx.cells_li(spark, SF)) == [-(-fx.table(spark, SF, "lineitem").count() // 500)]


def test_codes_of_frequent_values_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(core, "TASK_ROWS", 200)
    monkeypatch.setattr(relate, "TASK_ROWS", 200)
    monkeypatch.setattr(relate, "is_small", lambda groups: False)
    rng = np.random.default_rng(3)
    # nine of ten rows share a value, which comes with both signs of zero
    rows = [(k, i, float(v)) for k in "ab" for i, v in enumerate(rng.choice([0.0, -0.0, 1.5, np.nan, -2.0], 1500, p=[0.5, 0.4, 0.04, 0.03, 0.03]))]
    got = relate.dictionary_encode(spark.createDataFrame(rows, "k string, i int, v double"), "v", lambda v: v + 1, "w", ["k"])
    assert set(dealt_to(got)) == {15}
    want = {-2.0: 0, 0.0: 1, 1.5: 2}
    found = got.collect()
    assert sorted((r.k, r.i) for r in found) == sorted((k, i) for k, i, _ in rows)
    assert all(r.code == (3 if np.isnan(r.v) else want[r.v]) for r in found)
    biggest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert biggest < 1000


def test_images_share_files_and_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = lambda names, t, v: spark.createDataFrame(
        [(n, t, c, 0, y, 0, v) for n in names for c in (0, 1) for y in range(2)], SCHEMA)
    names = [f"{i:03d}" for i in range(40)]
    read = lambda: sorted(tuple(r) for r in read_cells(spark, path).select("img", "t", "c", "y", "v").collect())
    want = lambda v: sorted((n, t, c, y, v[n, t]) for n, t in v for c in (0, 1) for y in range(2))
    state = {(n, t): 1.0 for n in names for t in (0, 1)}
    write_cells(rows(names, 0, 1.0).unionByName(rows(names, 1, 1.0)), path)
    folders = lambda: {p.parent for p in (tmp_path / "cells").rglob("*.parquet")}
    assert read() == want(state) and len(folders()) == 4
    before = {p for p in (tmp_path / "cells").rglob("t=1/**/*.parquet")}
    write_cells(rows(["003", "007", "new"], 0, 2.0), path)  # two come again, one is new
    state |= {(n, 0): 2.0 for n in ("003", "007", "new")}
    assert read() == want(state) and len(folders()) == 6
    assert before == {p for p in (tmp_path / "cells").rglob("t=1/**/*.parquet")}
    write_cells(rows(["new", "003"], 0, 3.0), path)  # from two runs
    state |= {(n, 0): 3.0 for n in ("003", "new")}
    assert read() == want(state) and len(folders()) == 6
    # a channel without a time point is one of its own
    for v in (4.0, 5.0):
        write_cells(rows(["003"], 0, v).withColumn("t", F.lit(None).cast("int")), path)
    assert [r.v for r in read_cells(spark, path).filter("t IS NULL").collect()] == [5.0] * 4
    assert spark.read.parquet(path).filter("t = 0").count() == 41 * 4


def test_block_means_start_from_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(core, "TASK_ROWS", 500)
    means = shape.block_mean(fx.cells_li(spark, SF), 4)
    text = body(means)
    assert text.rindex("Exchange hashpartitioning") > text.rindex("HashAggregate")
    assert max(dealt_to(means)) > 10
    cells = fx.table(spark, SF, "lineitem").groupBy("l_suppkey", "l_shipdate").count().count()
    assert fx.cells_li(spark, SF).count() == cells
    assert means.select("y", "x").distinct().count() == means.count()


def test_block_means_are_grouped_in_counted_tasks(spark, monkeypatch):
    """The exchange of the means must not depend on the session's shuffle partitions."""
    monkeypatch.setattr(core, "TASK_ROWS", 500)
    catalog.load()
    means = catalog.QUERIES["a21_block_mean"](spark, SF)
    tasks = -(-fx.table(spark, SF, "lineitem").count() // 500)
    assert dealt_to(means) == [tasks, tasks]
    assert body(means).count("Exchange") == 2
    rows = [(i, 0, c, 0, y, x, float(y * x + c)) for i in "ab" for c in (0, 1) for y in range(9) for x in range(7)]
    cells = spark.createDataFrame([*rows, ("a", 0, 0, 0, -1, -5, 3.0), ("b", 0, 1, 0, 2, -1, None)], SCHEMA)
    plain, counted = shape.block_mean(cells, 4), shape.block_mean(cells, 4, len(rows) + 2)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, counted.collect()), key=str)
    assert "ENSURE_REQUIREMENTS" not in body(counted)
