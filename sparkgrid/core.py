"""Shared vocabulary: key columns, checkpoints, size-checked joins, grids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["img", "t", "c"]
AXES = ["z", "y", "x"]
CELL = KEYS + AXES

#: side of the square (y, x) blocks that stencils are co-partitioned by
BLOCK = 64
#: a per-group table is broadcast only when its written files are not larger
BROADCAST_BYTES = 16 << 20
#: and its rows take at most this many times as much
ROW_SHARE = 4
#: where rows are counted beforehand, a task gets about this many
TASK_ROWS = 1 << 19


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local session gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def write_aside(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` below the checkpoint folder and return the table and its path.

    Unlike a checkpoint the rows are computed once, and the table read back has
    known size, so later joins are planned from facts.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/aside-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: lost executors then cost no recompute."""
    return write_aside(df)[0]


def reusable(df: DataFrame) -> DataFrame:
    """Write a derived table aside before several passes over it.

    A plain scan (no exchange in its plan) is cheaper to read again than to
    copy, so it is returned as it is.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return settle(df) if "Exchange" in plan else df


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table made by :func:`write_aside`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def attach(
    rows: DataFrame,
    groups: DataFrame,
    on: list[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    settled: bool = False,
) -> DataFrame:
    """Join a one-row-per-group table to many rows without moving a hot group.

    The group table is written once; up to ``limit`` bytes of files, and
    ``ROW_SHARE`` times that of rows, it is broadcast.  Above that the rows meet it in a sort-merge join, whose hot
    partitions adaptive execution splits: only those are read more than once,
    and no row is copied beforehand.  Pass ``settled`` when the table was
    already written by :func:`settle`.
    """
    if not settled:
        groups = settle(groups)
    if is_small(groups, limit):
        return rows.join(F.broadcast(groups), on, how)
    return beside(rows, groups, on, how)


def is_small(groups: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast."""
    return planned_bytes(groups) <= limit and held_bytes(groups) <= ROW_SHARE * limit


def beside(rows: DataFrame, others: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the cells.

    The files of a cell table are far smaller than its rows, so that Spark, which
    sees the files, would send the whole table to the driver and broadcast it.
    """
    return rows.join(others.hint("merge"), on, how)


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the optimizer knows it: for a written table, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def held_bytes(df: DataFrame) -> int:
    """What the rows of a written table take in memory; without packed columns only file footers are read."""
    widths = {"string": 32, "array": 256, "map": 256, "struct": 256}
    row = 64 + sum(widths.get(kind.split("<")[0], 16) for _, kind in df.dtypes)
    packed = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "binary"]
    n, *bytes_ = df.agg(F.count(F.lit(1)), *packed).first()
    return n * row + sum(b or 0 for b in bytes_)


def finite(v: Column | str = "v") -> Column:
    """True for values that are neither null, NaN nor infinite."""
    v = F.col(v) if isinstance(v, str) else v
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def fdiv(a, n: int) -> Column:
    """Integer floor division that also rounds negative coordinates down."""
    a = F.col(a) if isinstance(a, str) else a
    return F.floor(a / F.lit(n)).cast("int")


def extents(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Axis lengths per image: one map-side combined aggregate."""
    return cells.groupBy(*(by or ["img"])).agg(
        *[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in AXES]
    )


def grid_points(groups: DataFrame, ranges: dict[str, tuple[Column, Column]]) -> int:
    """How many points :func:`grid` makes; ``groups`` is best a written table."""
    sides = [F.greatest(hi.cast("long") - lo + 1, F.lit(0)) for lo, hi in (ranges[a] for a in AXES)]
    return groups.agg(F.sum(sides[0] * sides[1] * sides[2])).first()[0] or 0


def grid(
    groups: DataFrame, ranges: dict[str, tuple[Column, Column]], block: int = BLOCK, points: int = 0
) -> DataFrame:
    """All integer points of a per-row (z, y, x) box.

    Blocks are listed first and spread by hash; only then are the points of a
    block produced, so one very large image is not expanded by one task.  Pass
    ``points`` where they are counted: more points then get more tasks.
    """
    keep = groups.columns
    (zlo, zhi), (ylo, yhi), (xlo, xhi) = (ranges[a] for a in AXES)
    boxed = groups.select(
        *keep, zlo.alias("_z0"), zhi.alias("_z1"), ylo.alias("_y0"), yhi.alias("_y1"),
        xlo.alias("_x0"), xhi.alias("_x1"),
    )
    blocks = (
        boxed.withColumn("by", F.explode(F.sequence(fdiv("_y0", block), fdiv("_y1", block))))
        .withColumn("bx", F.explode(F.sequence(fdiv("_x0", block), fdiv("_x1", block))))
    )
    part = [k for k in KEYS if k in keep] + ["by", "bx"]
    lo = lambda a, b: F.greatest(F.col(a), F.col(b) * block)
    hi = lambda a, b: F.least(F.col(a), F.col(b) * block + (block - 1))
    return (
        spread(blocks, *part, rows=points)
        .withColumn("z", F.explode(F.sequence("_z0", "_z1")))
        .withColumn("y", F.explode(F.sequence(lo("_y0", "by"), hi("_y1", "by"))))
        .withColumn("x", F.explode(F.sequence(lo("_x0", "bx"), hi("_x1", "bx"))))
        .drop("_z0", "_z1", "_y0", "_y1", "_x0", "_x1")
    )


def with_block(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Tag each cell with the block that owns it and co-locate blocks."""
    tagged = cells.withColumn("by", fdiv("y", block)).withColumn("bx", fdiv("x", block))
    return spread(tagged, *[k for k in KEYS if k in cells.columns], "by", "bx")


def spread(df: DataFrame, *cols: str, rows: int = 0) -> DataFrame:
    """Hash rows over all shuffle partitions and keep that many tasks, or more if ``rows`` need more.

    The stages that follow produce many values per row, so partitions that look
    small by bytes must not be merged.
    """
    return df.repartition(max(shuffle_partitions(df.sparkSession), -(-rows // TASK_ROWS)), *cols)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a counted number of rows: a share of ``TASK_ROWS`` each, and no fewer than cores."""
    return max(min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """Hash counted rows so that the table a task builds of them is bounded.

    A task that reads files gets 64 or 128 MB of them, which are tens of
    millions of packed rows; an aggregate of rows that hardly repeat would hold
    them all before its exchange.
    """
    return df.repartition(tasks_for(df.sparkSession, rows), *cols)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for stable reports."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)
