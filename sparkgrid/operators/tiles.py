"""Tile grids with overlap: sizing, halo assignment, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, KEYS, attach


def suggest_tile(nz: Column, budget: Column, kernel_yx: int = 65, double: bool = True) -> Column:
    """Largest tile side for a memory budget in bytes, within 256..4096."""
    usable = F.floor(budget / 2) if double else budget
    depth = F.when(nz > 1, 4 * nz).otherwise(F.lit(1))
    side = F.floor(F.sqrt(F.greatest(usable / (64 * depth), F.lit(0.0)))) - kernel_yx
    return F.greatest(F.lit(256), F.least(side, F.lit(4096))).cast("long")


def tile_count(h: Column, w: Column, side: Column) -> Column:
    return (F.greatest(F.ceil(h / side), F.lit(1)) * F.greatest(F.ceil(w / side), F.lit(1))).cast("long")


def best_tile_grid(images: DataFrame) -> DataFrame:
    """Factor ``n`` into (ny, nx) with the squarest tiles; first wins ties.

    Input: img, h, w, n.
    """
    cand = images.withColumn("_ny", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("n"), F.lit(1)).cast("long"))))
    cand = cand.filter(F.col("n") % F.col("_ny") == 0)
    th, tw = F.col("h") / F.col("_ny"), F.col("w") / (F.col("n") / F.col("_ny"))
    ratio = F.greatest(th, tw) / F.greatest(F.least(th, tw), F.lit(1.0))
    g = cand.groupBy("img", "h", "w", "n").agg(F.min_by("_ny", F.struct(ratio, "_ny")).alias("ny"))
    return g.select("img", "h", "w", F.col("ny").cast("int").alias("ny"), (F.col("n") / F.col("ny")).cast("int").alias("nx"))


def _bounds(i: Column, n: Column, size: Column, overlap: int) -> dict[str, Column]:
    """Core and extended bounds of tile ``i``; halves round to even."""
    edge = lambda k: F.bround(k * (size / n)).cast("int")
    lo, hi = edge(i), edge(i + 1)
    e0, e1 = F.greatest(lo - overlap, F.lit(0)), F.least(hi + overlap, size)
    return {"0c": lo, "1c": hi, "0e": e0, "1e": e1, "ov0": lo - e0, "ov1": e1 - hi}


def tile_table(grids: DataFrame, overlap: int) -> DataFrame:
    """All tiles of grids ``img, h, w, ny, nx`` with core, extended and overlap sizes."""
    t = grids.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn(
        "ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    y = _bounds(F.col("iy"), F.col("ny"), F.col("h"), overlap)
    x = _bounds(F.col("ix"), F.col("nx"), F.col("w"), overlap)
    return t.select(
        "img", "iy", "ix", *[y[k].alias(f"y{k}") for k in ("0c", "1c", "0e", "1e")],
        *[x[k].alias(f"x{k}") for k in ("0c", "1c", "0e", "1e")],
        y["ov0"].alias("ov_top"), y["ov1"].alias("ov_bot"), x["ov0"].alias("ov_left"), x["ov1"].alias("ov_right"))


def assign_halo(cells: DataFrame, grids: DataFrame, overlap: int, margin: int = 16) -> DataFrame:
    """Copy each cell to every tile that reads it (core + overlap + margin).

    Candidate tiles follow from the coordinate by arithmetic on the uniform
    grid, so this is a narrow expansion and not a range join.
    """
    out = attach(cells, grids.select("img", "h", "w", "ny", "nx"), ["img"])
    for a, i, n, size in (("y", "iy", "ny", "h"), ("x", "ix", "nx", "w")):
        step = F.col(size) / F.col(n)
        pad = overlap + margin
        near = lambda d: F.floor((F.col(a) + d) / step)
        lo = F.greatest(near(-pad) - 1, F.lit(0)).cast("int")
        hi = F.least(near(pad) + 1, F.col(n) - 1).cast("int")
        out = out.withColumn(i, F.explode(F.sequence(lo, hi)))
        b = _bounds(F.col(i), F.col(n), F.col(size), overlap)
        out = out.filter((F.col(a) >= b["0e"] - margin) & (F.col(a) < b["1e"] + margin))
    return out


def _ramp(p: Column, first: Column, last: Column, ov0: Column, ov1: Column) -> Column:
    up = F.when(p < first + ov0, (p - first + 1) / ov0).otherwise(F.lit(1.0))
    down = F.when(p >= last - ov1, (last - p) / ov1).otherwise(F.lit(1.0))
    return up * down


def tile_weight(overlap: int) -> tuple[Column, Column]:
    """(inside the extended tile, blend weight) for cells with iy, ix, ny, nx, h, w."""
    inside, w = F.lit(True), F.lit(1.0)
    for a, i, n, size in (("y", "iy", "ny", "h"), ("x", "ix", "nx", "w")):
        b = _bounds(F.col(i), F.col(n), F.col(size), overlap)
        inside = inside & (F.col(a) >= b["0e"]) & (F.col(a) < b["1e"])
        w = w * _ramp(F.col(a), b["0e"], b["1e"], b["ov0"], b["ov1"])
    return inside, w


def blend_tiles(tile_cells: DataFrame, grids: DataFrame, overlap: int) -> DataFrame:
    """Weighted mean of overlapping tile results, clipped at zero."""
    j = attach(tile_cells, grids.select("img", "h", "w", "ny", "nx"), ["img"])
    inside, w = tile_weight(overlap)
    summed = j.filter(inside).withColumn("_w", w).groupBy(*KEYS, *AXES).agg(
        F.sum(F.col("_w") * F.col("v")).alias("_num"), F.sum("_w").alias("_den"))
    return summed.select(*KEYS, *AXES, F.greatest(F.col("_num") / F.greatest("_den", F.lit(1e-12)), F.lit(0.0)).alias("v"))
