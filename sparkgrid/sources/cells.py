"""Cell tables in and out: Parquet scans, nested arrays, file listings."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgrid.core import BLOCK, CELL, KEYS, beside, dealt, fdiv, grid, grid_points, is_small, reusable, settle, spread


SCHEMA = "img string, t int, c int, z int, y int, x int, v double"


def read_cells(spark: SparkSession, path: str, t: int | None = None, c: int | None = None) -> DataFrame:
    """Scan a cell table; time and channel filters prune partitions or row groups.

    The schema is fixed, so that image names such as ``007`` stay text.
    """
    df = spark.read.schema(SCHEMA).parquet(path)
    if t is not None:
        df = df.filter(F.col("t") == t)
    if c is not None:
        df = df.filter(F.col("c") == c)
    return df.select(*CELL, "v")


def _depth(dtype: T.DataType) -> int:
    return 1 + _depth(dtype.elementType) if isinstance(dtype, T.ArrayType) else 0


def arrays_to_cells(df: DataFrame, col: str = "data", axes: Sequence[str] | None = None) -> DataFrame:
    """Unpivot a nested array column into cells; missing axes become 0.

    Two to five nesting levels are read as YX, CYX, CZYX and TCZYX unless
    ``axes`` says otherwise (for example ``["z", "y", "x"]`` for one stack).
    """
    depth = _depth(df.schema[col].dataType)
    if axes is None:
        axes = ["t", "c", "z", "y", "x"][-depth:] if depth != 3 else ["c", "y", "x"]
    if len(axes) != depth or not 2 <= depth <= 5:
        raise ValueError(f"array of depth {depth} does not match axes {list(axes)}")
    keep = [k for k in df.columns if k != col]
    out = df.withColumn("_d", F.col(col)).drop(col)
    for a in axes:
        keep = keep + [a]
        out = out.select(*keep[:-1], F.posexplode("_d").alias(a, "_d"))
    missing = [F.lit(0).alias(a) for a in ["t", "c", "z", "y", "x"] if a not in keep]
    return out.select(*keep, *missing, F.col("_d").cast("double").alias("v"))


def cells_to_arrays(cells: DataFrame) -> DataFrame:
    """Regroup cells into one ``ARRAY<DOUBLE>`` line along x per (img,t,c,z,y)."""
    ordered = F.array_sort(F.collect_list(F.struct("x", "v")))
    return cells.groupBy(*KEYS, "z", "y").agg(F.transform(ordered, lambda s: s["v"]).alias("line"))


def list_files(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """Files below ``folder`` whose name ends in one of the suffixes, by name.

    The content column is pruned, so only the listing is read.  A folder whose
    own name matches (chunked array stores) is reported once.
    """
    want = [s.lower() if s.startswith(".") else f".{s.lower()}" for s in (s.strip() for s in suffixes) if s]
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        .select("path", "length")
    )
    stores = "(?i)^(.*?(" + "|".join(w.replace(".", "\\.") for w in want) + "))(/.*)?$"
    item = F.regexp_extract("path", stores, 1)
    return (
        files.select(item.alias("path"), "length").filter(F.col("path") != "")
        .groupBy("path").agg(F.sum("length").alias("length"))
        .withColumn("name", F.element_at(F.split("path", "/"), -1))
        .orderBy("name")
    )


def write_cells(cells: DataFrame, path: str, level: bool = True) -> None:
    """Partitioned, idempotent write: a rerun replaces only its own images, time points and channels.

    A folder belongs to a time point and channel and to the write that first
    brought its images (``run``), not to an image, so the number of files follows
    the bytes and small images share them.  Images written again take their old
    place: just the folders that hold them are rewritten, with their other
    images, by the same commit.  Two writes of the same channel must not run at
    the same time.
    """
    out = cells if "level" in cells.columns or not level else cells.withColumn("level", F.lit(0))
    parts = ["t", "c"] + (["level"] if level else [])
    run = f"run-{uuid.uuid4().hex}"
    out = _beside_held(out, path, parts, run) if _holds_cells(cells.sparkSession, path) else out.withColumn("run", F.lit(run))
    folders = [*parts, "run"]
    (
        out.hint("rebalance", *[F.col(k) for k in folders]).sortWithinPartitions(*folders, "img")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy(*folders).parquet(path)
    )


def _holds_cells(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    if any(n.startswith("img=") for n in names):
        raise ValueError(f"{path} has a folder per image; write its cells to a new folder")
    return any(n[0] not in "._" for n in names)


def _beside_held(out: DataFrame, path: str, parts: list[str], run: str) -> DataFrame:
    """New cells with the run whose folder they go to, and the other images of folders that are written anew."""
    out = reusable(out)
    held = out.sparkSession.read.schema(T.StructType([*out.schema.fields, T.StructField("run", T.StringType())])).parquet(path)
    own = ["img", *parts]
    alike = lambda a, b, names: reduce(and_, [a[n].eqNullSafe(b[n]) for n in names])
    new = out.select(*own).distinct().hint("merge")
    homes = settle(held.join(new, alike(held, new, own), "left_semi").select(*own, "run").distinct())
    if homes.isEmpty():
        return out.withColumn("run", F.lit(run))
    homes = F.broadcast(homes) if is_small(homes) else homes.hint("merge")
    placed = out.join(homes, alike(out, homes, own), "left").select(
        *[out[k] for k in out.columns], F.coalesce(homes["run"], F.lit(run)).alias("run"))
    touched = homes.select(*parts, "run").distinct()
    rest = held.join(touched, alike(held, touched, [*parts, "run"]), "left_semi")
    return placed.unionByName(rest.join(homes, alike(rest, homes, own), "left_anti"))


def gathered(cells: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Cells of a block of a partition in one task, so that a folder gets one file a block.

    Blocks of one image go to several tasks: a huge image is not one writer.
    """
    return spread(cells.withColumn("by", fdiv("y", BLOCK)).withColumn("bx", fdiv("x", BLOCK)), *parts, "by", "bx").drop("by", "bx")


def densify(
    cells: DataFrame,
    groups: DataFrame,
    ranges: dict[str, tuple[Column, Column]],
    fill: float | Column = 0.0,
    block: int = BLOCK,
) -> DataFrame:
    """Embed sparse cells in a full box per group and fill the gaps.

    ``groups`` has one row per (img,t,c); ``ranges`` gives the inclusive box as
    expressions over its columns.  The points of the boxes are counted first, so
    that more of them get more tasks, both where they are made and where they
    meet the cells.
    """
    extra = [c for c in groups.columns if c not in KEYS]
    groups = settle(groups)
    points = grid_points(groups, ranges)
    box = dealt(grid(groups, ranges, block, points).drop("by", "bx"), points, *CELL)
    fill = fill if isinstance(fill, Column) else F.lit(float(fill))
    joined = beside(box, dealt(cells, points, *CELL), CELL, "left")
    return joined.select(*CELL, *extra, F.coalesce("v", fill).alias("v"))
