"""Linking rows that share a bucket, and connected components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import attach, discard, settle, write_aside
from sparkgrid.llm.tables import partitions

#: a bucket with more rows is compared in cells of two slices of about this size
SLICE = 1024


def cells_of(rows: DataFrame, key: str, item: str, slice_rows: int = SLICE) -> DataFrame:
    """Deal bucket rows into cells such that every pair of a bucket meets in one.

    A bucket of n rows has c = ceil(n / slice_rows) slices by the hash of
    ``item``; each row goes to the c cells (its slice, any slice).  No cell is
    much larger than two slices however hot the key is, and every pair of rows
    shares at least one.  Only keys above one slice are gathered for the join.
    """
    hot = settle(rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_rows))
    slices = F.coalesce(F.ceil(F.col("_n") / slice_rows), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(item, F.lit(1)), F.col("_slices")).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices").cast("long") - 1))
    return (
        attach(rows, hot, [key], "left", settled=True).withColumn("_slices", slices)
        .withColumn("_own", own).withColumn("_other", other)
        .withColumn("cell", F.least("_own", "_other") * (1 << 31) + F.greatest("_own", "_other"))
        .drop("_n", "_slices", "_own", "_other")
    )


def map_runs(rows: DataFrame, by: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``fn`` to the runs of equal ``by`` values, many runs a call.

    ``fn`` gets a table sorted by ``by`` and the offsets at which its runs
    start, with the table's length at the end.  Rows stream through the task;
    only an unfinished run is carried to the next batch.
    """
    ordered = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([*rest, batch])
            starts = run_starts(table, by)
            yield from fn(table.slice(0, starts[-1]), starts).to_batches() if starts[-1] else []
            rest = table.slice(starts[-1]).to_batches()
        if rest:
            table = pa.Table.from_batches(rest)
            yield from fn(table, np.append(run_starts(table, by), table.num_rows)).to_batches()

    return ordered.mapInArrow(stream, schema)


def run_starts(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in by:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def forest(near: np.ndarray) -> np.ndarray:
    """Smallest reachable index of every index under a symmetric relation."""
    label = np.arange(len(near))
    while True:
        best = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (node, root), root the smallest node.

    Alternating large-star and small-star steps: every step points nodes at
    the smallest neighbour seen, until only stars are left: then no node with a
    smaller neighbour has another one.  Each step is one
    aggregate with a map-side combine and one join, written to the shared
    folder; the tables of earlier steps are removed.  The centre of a large
    star is a hot key, so the aggregate is attached and its side can be split.
    A node linked only to itself, and an empty table, give no rows.
    """
    spark = links.sparkSession
    edges, path = write_aside(
        links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("_low"), F.count("*").alias("_n"))
        least, least_path = write_aside(least.select("u", F.least("_low", "u").alias("m"), F.expr("_low < u AND _n > 1").alias("_open")))
        if least.filter("_open").isEmpty():
            discard(spark, least_path)
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        large = attach(both.filter("v > u"), least.select("u", "m"), ["u"], settled=True).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large, large_path = write_aside(large)
        down, down_path = write_aside(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = attach(large, down, ["hi"], settled=True)
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", "m")).filter("hi <> lo").distinct()
        new, new_path = write_aside(small)
        for gone in (least_path, large_path, down_path, path):
            discard(spark, gone)
        edges, path = new, new_path
