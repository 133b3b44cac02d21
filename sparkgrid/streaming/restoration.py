"""Restore time points as they arrive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkgrid.core import AXES, CELL, KEYS, attach, discard, write_aside
from sparkgrid.plans.tiled import restore_tiled
from sparkgrid.sources.cells import gathered, write_cells

HELD = "img string, t int, c int, z int, y int, x int, v double, trigger long"


def held_cells(spark: SparkSession, checkpoint: str, trigger: int) -> DataFrame:
    """Cells of channels that were not whole after ``trigger``, with the trigger that brought each."""
    return spark.read.schema(HELD).parquet(f"{checkpoint}-held/{trigger}")


def split_whole(cells: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the channels that have all cells of their size, and the cells of the others.

    ``sizes`` has nz, ny, nx by any of img, t and c.  A channel without a size,
    or with a null in it, is never whole.
    """
    by = [k for k in KEYS if k in sizes.columns]
    wanted = sizes.select(*by, (F.col("nz").cast("long") * F.col("ny") * F.col("nx")).alias("_wanted")).distinct()
    found = cells.groupBy(*KEYS).agg(F.count("*").alias("_found"))
    whole = attach(found, wanted, by).filter("_found = _wanted").select(*KEYS, F.lit(True).alias("_whole"))
    marked = attach(cells, whole, KEYS, "left")
    return marked.filter("_whole").drop("_whole"), marked.filter("_whole IS NULL").drop("_whole")


def restore_stream(
    frames: DataFrame, kernel: np.ndarray, path: str, checkpoint: str, sizes: DataFrame | None = None, shared: bool = False, **options
) -> StreamingQuery:
    """Solve every arriving channel of a frame and write it to a partition of its own.

    A partition is a folder and a file, so many small images are best written
    ``shared``: images share the files of a time point and channel, as
    :func:`write_cells` has them, and a channel that comes again still replaces
    its cells.  A path keeps the layout it was begun with.

    Without ``sizes`` a frame may arrive over several triggers, a channel of it
    in one.  With ``sizes`` (nz, ny, nx by any of img, t and c) a channel may
    come in pieces: its cells are held until all are there, then it is solved
    and forgotten.  A cell that comes again before that counts once, by its last
    trigger; cells outside the size are left out; :func:`held_cells` reads what
    still waits.

    What is held is one table per trigger, made from the table before it and the
    new cells; the last two stay.  So a batch that is run again after a failure
    starts from what it started from, and as writing replaces a channel, leaves
    no copies.  No task holds a channel for it: cells are counted by aggregate.
    """
    def solve(cells: DataFrame) -> None:
        out = restore_tiled(cells, kernel, **options).cells
        check_layout(out.sparkSession, path, "c=" if shared else "img=")
        if shared:
            write_cells(out, path, level=False)
            return
        gathered(out, ["t", "img", "c"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("t", "img", "c").parquet(path)

    def put(batch: DataFrame, _: int) -> None:
        cells, path_of_batch = write_aside(batch.select(*CELL, "v"))
        if not cells.isEmpty():
            solve(cells)
        discard(batch.sparkSession, path_of_batch)

    def hold(batch: DataFrame, trigger: int) -> None:
        spark = batch.sparkSession
        arrived = inside(batch, sizes).select(*CELL, "v", F.lit(trigger).cast("long").alias("trigger"))
        if trigger > 0:
            arrived = held_cells(spark, checkpoint, trigger - 1).select(*CELL, "v", "trigger").unionByName(arrived)
        last = F.max(F.struct("trigger", "v")).alias("last")
        cells, path_of_cells = write_aside(arrived.groupBy(*CELL).agg(last).select(*CELL, "last.v", "last.trigger"))
        whole, waiting = split_whole(cells, sizes)
        waiting.write.mode("overwrite").parquet(f"{checkpoint}-held/{trigger}")
        whole, path_of_whole = write_aside(whole.select(*CELL, "v"))
        if not whole.isEmpty():
            solve(whole)
        for gone in (path_of_cells, path_of_whole, f"{checkpoint}-held/{trigger - 2}"):
            discard(spark, gone)

    return (
        frames.writeStream.foreachBatch(put if sizes is None else hold).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def check_layout(spark: SparkSession, path: str, below: str) -> None:
    """Refuse a path whose time points hold other folders than those named ``below...``: mixed layouts cannot be read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    times = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "t=*")) if files.exists(folder) else []
    for time in times[:1]:
        held = files.listStatusIterator(time.getPath())
        if held.hasNext() and not held.next().getPath().getName().startswith(below):
            raise ValueError(f"{path} was begun in the other layout; `shared` must stay as it was")


def inside(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells inside the size of their channel, and those of channels without one."""
    by = [k for k in KEYS if k in sizes.columns]
    limits = sizes.select(*by, *[F.col(f"n{a}").alias(f"_n{a}") for a in AXES]).distinct()
    fits = [F.coalesce((F.col(a) >= 0) & (F.col(a) < F.col(f"_n{a}")), F.lit(True)) for a in AXES]
    return attach(cells, limits, by, "left").filter(fits[0] & fits[1] & fits[2]).select(*cells.columns)
