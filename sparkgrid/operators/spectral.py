"""Band energies by separable partial transforms, and the quality metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, KEYS, attach, settle
from sparkgrid.operators.rank import gini, percentiles, robust_range
from sparkgrid.operators.shape import strided_sample
from sparkgrid.operators.stats import normalize
from sparkgrid.operators.stencil import edge_strength

#: lines that are transformed together
LINES = 256


def wrapped(k: Column, n: Column) -> Column:
    """Signed frequency of transform index ``k`` for length ``n``."""
    return F.when(k < F.floor((n + 1) / 2), k / n).otherwise((k - n) / n)


def max_radius(lengths: Sequence[Column]) -> Column:
    """Largest frequency radius of a shape."""
    total = F.lit(0.0)
    for n in lengths:
        top = F.floor(n / 2) / n
        total = total + top * top
    return F.sqrt(total)


def frequency_radius(shapes: DataFrame, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """Radius of every transform bin for rows with lengths ``n{axis}``."""
    out = shapes
    total = F.lit(0.0)
    for a in axes:
        out = out.withColumn(f"k{a}", F.explode(F.sequence(F.lit(0), F.col(f"n{a}").cast("int") - 1)))
        f = wrapped(F.col(f"k{a}"), F.col(f"n{a}"))
        total = total + f * f
    return out.withColumn("radius", F.sqrt(total)).withColumn("max_radius", max_radius([F.col(f"n{a}") for a in axes]))


def transform_lines(lines: DataFrame, axis: str, half: bool) -> DataFrame:
    """Fast transform of every line: one row per bin ``k{axis}`` whose radius so far is within ``limit``.

    ``lines`` has a ``line`` of (at, re, im), the length ``n{axis}``, the
    squared radius ``f2`` of the axes done and any other columns, which are
    kept.  Places without a value count as zero.  ``half`` leaves out the
    mirrored bins of a real line.
    """
    kept = [c for c in lines.columns if c not in ("line", "f2")]
    types = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    length, bin_name = f"n{axis}", f"k{axis}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, LINES) for b in batches for i in range(0, b.num_rows, LINES)):
            line, sizes = batch.column("line"), batch.column(length).to_numpy()
            counts = line.value_lengths().to_numpy()
            at, re, im = (line.flatten().field(i).to_numpy() for i in range(3))
            of = np.repeat(np.arange(len(counts)), counts)
            f2, limit = batch.column("f2").to_numpy(), batch.column("limit").to_numpy()
            for n in np.unique(sizes):  # lines of a length are one matrix
                rows = np.flatnonzero(sizes == n)
                place = np.full(len(sizes), -1)
                place[rows] = np.arange(len(rows))
                own = place[of] >= 0
                matrix = np.zeros((len(rows), n), dtype=complex)
                matrix[place[of[own]], at[own]] = re[own] + 1j * im[own]
                k = np.arange(n // 2 + 1) if half else np.fft.fftfreq(n, 1 / n).round().astype(int)
                bins = np.fft.fft(matrix, axis=1)[:, k]
                radius = f2[rows][:, None] + (k / n) ** 2
                r, c = np.nonzero(np.sqrt(radius) <= limit[rows][:, None])
                taken = pa.array(rows[r])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).take(taken) for x in kept), pa.array(k[c].astype(np.int32)), pa.array(radius[r, c]),
                     pa.array(bins[r, c].real), pa.array(bins[r, c].imag)], names=[*kept, bin_name, "f2", "re", "im"])

    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), f"{bin_name} int", "f2 double", "re double", "im double"])
    return lines.mapInArrow(run, schema)


def high_band_share(cells: DataFrame, cut: float = 0.25) -> DataFrame:
    """Share of spectral power outside ``cut`` x the largest radius, per image.

    Lines are transformed axis by axis, with one exchange that gathers the
    lines of the next axis; only the low band (about a tenth of the bins) goes
    on, the total follows from the sum of squares.  A task holds a few lines,
    never a plane, and the work per cell grows with the logarithm of the side.
    """
    dims = settle(cells.groupBy(*KEYS).agg(
        *[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in AXES], F.count(F.lit(1)).alias("n"),
        F.sum(F.col("v") * F.col("v")).alias("ss")))
    limit = (cut * max_radius([F.col(f"n{a}") for a in AXES])).alias("limit")
    carry = [*KEYS, "nz", "ny", "nx", "limit"]
    sizes = dims.select(*KEYS, "nz", "ny", "nx", limit)
    cur = attach(cells.select(*KEYS, *AXES, "v"), sizes, KEYS)
    cur = cur.select(*carry, *AXES, F.col("v").alias("re"), F.lit(0.0).alias("im"), F.lit(0.0).alias("f2"))
    left = list(AXES)
    for a in ("x", "y", "z"):
        left.remove(a)
        done = [c for c in cur.columns if c.startswith("k")]
        lines = cur.groupBy(*carry, *left, *done, "f2").agg(F.collect_list(F.struct(F.col(a).alias("at"), "re", "im")).alias("line"))
        cur = transform_lines(lines, a, half=a == "x")
    mirrored = F.when((F.col("kx") == 0) | (2 * F.col("kx") == F.col("nx")), 1).otherwise(2)
    low = cur.groupBy(*KEYS).agg(F.sum((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * mirrored).alias("low"))
    total = F.col("n") * F.col("ss")
    share = F.greatest(total - F.col("low"), F.lit(0.0)) / (total + 1e-12)
    return attach(dims, low, KEYS, "left").select(*KEYS, F.coalesce(share, F.lit(0.0)).alias("share"))


def _centred(cells: DataFrame) -> DataFrame:
    mean = cells.groupBy(*KEYS).agg(F.avg("v").alias("_m"))
    return attach(cells, mean, KEYS).withColumn("raw", F.col("v")).withColumn("v", F.col("v") - F.col("_m"))


def detail_energy(cells: DataFrame) -> DataFrame:
    """Share of power in fine structure."""
    return high_band_share(_centred(cells)).withColumnRenamed("share", "detail_energy")


def bright_detail_energy(cells: DataFrame) -> DataFrame:
    """The same on the brightest twentieth of the image, other cells set to 0."""
    p95 = percentiles(cells, {"p95": 95})
    masked = attach(_centred(cells), p95, KEYS).withColumn(
        "v", F.when(F.col("raw") >= F.col("p95"), F.col("v")).otherwise(F.lit(0.0)))
    return high_band_share(masked).withColumnRenamed("share", "bright_detail_energy")


def effect_metrics(cells: DataFrame, sample: tuple[int, int] | None = None) -> DataFrame:
    """Five no-reference metrics per normalised image.

    ``sample`` asks for a strided sample of at most so many planes, and rows
    and columns, instead of the whole image; (32, 512) is customary.
    """
    s = settle(normalize(strided_sample(cells, *sample) if sample else cells))
    out = detail_energy(s).join(bright_detail_energy(s), KEYS).join(edge_strength(s), KEYS)
    out = out.join(gini(s).withColumnRenamed("gini", "signal_sparsity"), KEYS)
    return out.join(robust_range(s).select(*KEYS, "robust_range"), KEYS)
