"""Joins, set operations and small lookups around cell tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import CELL, TASK_ROWS, attach, beside, dealt, is_small, reusable, settle, tasks_for


def with_channel_meta(cells: DataFrame, channels: DataFrame) -> DataFrame:
    """Per-channel metadata on every cell; the metadata side is size-checked."""
    return attach(cells, channels, ["img", "c"])


def union_panes(src: DataFrame, res: DataFrame) -> DataFrame:
    """Source and result below each other, told apart by ``pane``."""
    tag = lambda d, p: d.select(F.lit(p).alias("pane"), *CELL, "v")
    return tag(src, "original").unionByName(tag(res, "restored"))


def failed_items(inputs: DataFrame, outputs: DataFrame, key: str = "name") -> DataFrame:
    """Inputs that produced no output."""
    return inputs.join(outputs, key, "left_anti").select(key)


def exit_status(failed: DataFrame) -> DataFrame:
    """How many items failed and the job status (1 when any did)."""
    n = F.count(F.lit(1))
    return failed.agg(n.alias("failed"), F.when(n > 0, F.lit(1)).otherwise(F.lit(0)).alias("status"))


def first_image(names: DataFrame, key: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """The alphabetically first image (per group), without a sort."""
    return names.groupBy(*by).agg(F.min(key).alias(key))


def sorted_report(df: DataFrame, *by: str) -> DataFrame:
    return df.orderBy(*by)


def route_inputs(files: DataFrame, plates: DataFrame, key: str = "name") -> DataFrame:
    """Mark every distinct input as plate or regular image."""
    ids, known = files.select(key), plates.select(key)
    plate = ids.intersect(known).withColumn("kind", F.lit("plate"))
    image = ids.subtract(known).withColumn("kind", F.lit("image"))
    return plate.unionByName(image)


def dictionary_encode(
    df: DataFrame, col: str, expr: Callable[[Column], Column], out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Evaluate ``expr`` once per distinct value of ``col`` and map it back.

    Codes number the distinct values in order within each group of ``keys``.
    The values are range-partitioned and numbered per partition; the small
    table of partition sizes gives the starting code, so no group is sorted in
    one task even without keys.  Rows are counted and tasks get a bounded share
    of them at every step.
    """
    keys = list(keys)
    df = reusable(df)
    rows = df.count()
    # equal rows of a task are combined before they move, so a frequent value stays small
    apart = [c for c in df.columns if c not in (*keys, col)] or df.columns
    counted = dealt(df, rows, *apart).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_rows"))
    ranges = counted.repartitionByRange(tasks_for(df.sparkSession, rows), *keys, col)
    placed = settle(ranges.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(col)) - 1
    numbered = dealt(placed, rows, *keys, "_part").withColumn("_local", local)
    coded = settle(attach(numbered, starts, [*keys, "_part"]).select(
        *keys, col, (F.col("_start") + F.col("_local")).cast("long").alias("code"), expr(F.col(col)).alias(out), "_rows"))
    if is_small(coded):
        return attach(df, coded.drop("_rows"), [*keys, col], settled=True)
    return _attach_codes(df, coded, keys, col, apart, rows)


def _attach_codes(
    df: DataFrame, coded: DataFrame, keys: list[str], col: str, apart: Sequence[str], rows: int
) -> DataFrame:
    """Meet a large table of codes, no more than about ``TASK_ROWS`` rows of a value in a task.

    The code of a frequent value is copied once a share of its rows; there are
    at most ``rows / TASK_ROWS`` such values.  Values meet by their hash and are then
    compared, as Spark moves rows again that meet on a float.
    """
    on = [*keys, col]
    copies = F.ceil(F.col("_rows") / TASK_ROWS).cast("int")
    frequent = settle(coded.filter(F.col("_rows") > TASK_ROWS).select(*on, copies.alias("_copies")))
    salt = F.coalesce(F.pmod(F.xxhash64(*apart), F.col("_copies")), F.lit(0)).cast("int").alias("_salt")
    salted = df.join(F.broadcast(frequent), on, "left").select(*df.columns, salt)
    copied = coded.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_rows")
    by = [*keys, "_hash", "_salt"]
    place = lambda d: dealt(d.withColumn("_hash", F.xxhash64(col)), rows, *by)
    met = beside(place(salted), place(copied).withColumnRenamed(col, "_value"), by)
    same = (F.col(col) >= F.col("_value")) & (F.col(col) <= F.col("_value"))
    return met.filter(same).drop("_hash", "_salt", "_value")


def comparison_matrix(results: DataFrame, by: Sequence[str] = ("img",)) -> DataFrame:
    """Grid positions of the (method, iterations) pairs that have an output.

    Rows are iteration settings, columns methods.  Settings without any output
    leave no empty row; the pairs come from the results, so nothing is crossed.
    """
    by = list(by)
    pairs = results.select(*by, "method", "iters").distinct()
    rank = lambda c: F.dense_rank().over(Window.partitionBy(*by).orderBy(c)).cast("long")
    return pairs.withColumn("grid_row", rank("iters")).withColumn("grid_col", rank("method"))
