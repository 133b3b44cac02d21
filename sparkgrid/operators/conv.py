"""Convolution and correlation of cell tables with small kernels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, BLOCK, CELL, KEYS, attach, fdiv
from sparkgrid.operators.neighbors import Tap, reach, route, scatter, tap_array


def convolve(cells: DataFrame, taps: Sequence[Tap], block: int = BLOCK, keys: Sequence[str] = KEYS) -> DataFrame:
    """``y[j] = sum w[o] x[j-o]`` over the cells present; zero elsewhere.

    One exchange: a cell travels once per block it reaches, not once per tap.
    """
    return scatter(cells.select(*keys, *AXES, "v"), taps,
                   [F.sum(F.col("v") * F.col("tap.w")).alias("v")], keys, block)


def flip(taps: Sequence[Tap]) -> list[Tap]:
    return [(-a, -b, -c, w) for a, b, c, w in taps]


def correlate(cells: DataFrame, taps: Sequence[Tap], block: int = BLOCK, keys: Sequence[str] = KEYS) -> DataFrame:
    """The adjoint, ``c[j] = sum w[o] r[j+o]``."""
    return convolve(cells, flip(taps), block, keys)


def convolve_each(cells: DataFrame, kernels: DataFrame, on: Sequence[str] = ("c",), block: int = BLOCK) -> DataFrame:
    """Convolution with one kernel per group: ``on, dz, dy, dx, w``.

    The reach is one aggregate over the kernel table; each routed cell then
    meets the taps of its own kernel.
    """
    lo_hi = kernels.agg(F.min("dy"), F.max("dy"), F.min("dx"), F.max("dx")).first()
    routed = route(cells.select(*CELL, "v"), (lo_hi[0], lo_hi[1]), (lo_hi[2], lo_hi[3]), KEYS, block)
    lists = kernels.groupBy(*on).agg(F.collect_list(F.struct("dz", "dy", "dx", "w")).alias("taps"))
    hit = attach(routed, lists, list(on)).withColumn("tap", F.explode("taps"))
    moved = hit.select(
        *KEYS, "hby", "hbx", *[(F.col(a) + F.col(f"tap.d{a}")).cast("int").alias(a) for a in AXES],
        (F.col("v") * F.col("tap.w")).alias("v"),
    ).filter((fdiv("y", block) == F.col("hby")) & (fdiv("x", block) == F.col("hbx")))
    return moved.groupBy(*KEYS, "hby", "hbx", *AXES).agg(F.sum("v").alias("v")).drop("hby", "hbx")


def inside_sum(taps: Sequence[Tap], nz: Column, ny: Column, nx: Column) -> Column:
    """Kernel mass that falls on the image when the kernel is put on this cell."""
    n = dict(zip(AXES, (nz, ny, nx)))

    def add(acc: Column, tap: Column) -> Column:
        ok = F.lit(True)
        for a in AXES:
            at = F.col(a) + tap[f"d{a}"]
            ok = ok & (at >= 0) & (at < n[a])
        return acc + F.when(ok, tap["w"]).otherwise(F.lit(0.0))

    return F.aggregate(tap_array(taps), F.lit(0.0), add)


def boundary_weights(box: DataFrame, taps: Sequence[Tap], floor: float = 0.01) -> DataFrame:
    """Inverse of the kernel mass seen by each cell of the work box (0 if tiny).

    The image is a full rectangle ``nz, ny, nx``, so the mass depends on the
    position only and needs no exchange.
    """
    mass = box.withColumn("_m", inside_sum(taps, F.col("nz"), F.col("ny"), F.col("nx")))
    return mass.withColumn("w", F.when(F.col("_m") > floor, 1 / F.col("_m")).otherwise(F.lit(0.0))).drop("_m")


def work_ranges(taps: Sequence[Tap]) -> dict[str, tuple[Column, Column]]:
    """The image dilated by the kernel, as ranges over columns ``nz, ny, nx``."""
    out = {}
    for i, a in enumerate(AXES):
        lo, hi = reach(taps, i)
        out[a] = (F.lit(-hi), F.col(f"n{a}") - 1 - F.lit(lo))
    return out
