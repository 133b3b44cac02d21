"""Sampling, cropping, projections, pyramids and colour composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, CELL, KEYS, attach, dealt, extents, fdiv, finite


def strided_sample(cells: DataFrame, max_z: int = 32, max_yx: int = 512, dims: DataFrame | None = None) -> DataFrame:
    """Keep every ceil(n/limit)-th index per axis and renumber the rest."""
    dims = extents(cells, KEYS) if dims is None else dims
    limit = {"z": max_z, "y": max_yx, "x": max_yx}
    step = {a: F.greatest(F.ceil(F.col(f"n{a}") / limit[a]), F.lit(1)) for a in AXES}
    out = attach(cells, dims, [k for k in KEYS if k in dims.columns])
    for a in AXES:
        out = out.filter(F.pmod(F.col(a), step[a]) == 0)
    return out.select(*KEYS, *[F.floor(F.col(a) / step[a]).cast("int").alias(a) for a in AXES], "v")


def center_crop(cells: DataFrame, cz: int = 64, cy: int = 512, cx: int = 512, dims: DataFrame | None = None) -> DataFrame:
    """The central window of at most the given size, moved to the origin."""
    dims = extents(cells, KEYS) if dims is None else dims
    want = {"z": cz, "y": cy, "x": cx}
    size = {a: F.least(F.col(f"n{a}"), F.lit(want[a])) for a in AXES}
    start = {a: F.floor((F.col(f"n{a}") - size[a]) / 2) for a in AXES}
    out = attach(cells, dims, [k for k in KEYS if k in dims.columns])
    for a in AXES:
        out = out.filter((F.col(a) >= start[a]) & (F.col(a) < start[a] + size[a]))
    return out.select(*KEYS, *[(F.col(a) - start[a]).cast("int").alias(a) for a in AXES], "v")


def select_plane(cells: DataFrame, t: int = 0, z: int = 0, dims: DataFrame | None = None) -> DataFrame:
    """One plane per image; indices outside the stack are clamped to its ends."""
    if dims is None:
        dims = cells.groupBy("img").agg((F.max("t") + 1).alias("nt"), (F.max("z") + 1).alias("nz"))
    at = lambda i, n: F.least(F.greatest(F.lit(i), F.lit(0)), F.col(n) - 1)
    return (
        attach(cells, dims.select("img", "nt", "nz"), ["img"])
        .filter((F.col("t") == at(t, "nt")) & (F.col("z") == at(z, "nz"))).select(*CELL, "v")
    )


def finite_only(cells: DataFrame) -> DataFrame:
    return cells.filter(finite("v"))


def project_z(cells: DataFrame, how: str = "mip", z: int = 0) -> DataFrame:
    """Maximum or sum over z, or a single clamped plane."""
    if how == "slice":
        nz = cells.groupBy("img").agg((F.max("z") + 1).alias("nz"))
        keep = F.col("z") == F.least(F.greatest(F.lit(z), F.lit(0)), F.col("nz") - 1)
        return attach(cells, nz, ["img"]).filter(keep).select(*KEYS, "y", "x", "v")
    if how not in ("mip", "sum"):
        raise ValueError(f"unsupported projection {how!r}")
    f = F.max if how == "mip" else F.sum
    return cells.groupBy(*KEYS, "y", "x").agg(f("v").alias("v"))


def pyramid(cells: DataFrame, levels: int = 3, dims: DataFrame | None = None) -> DataFrame:
    """Level 0 plus repeated 2x2 block means; odd last rows are cropped per level.

    Every level is grouped from the one before (a quarter of its size), and
    shares that level's exchange instead of reading the input again.
    """
    dims = extents(cells, KEYS) if dims is None else dims
    on = [k for k in KEYS if k in dims.columns]
    cur = attach(cells, dims.select(*on, "ny", "nx"), on)
    pick = lambda d, lv: d.select(F.lit(lv).alias("level"), F.lit(float(2**lv)).alias("scale"), *CELL, "v")
    out = pick(cur, 0)
    for lv in range(1, levels):
        cur = (
            cur.filter((F.col("y") < fdiv("ny", 2) * 2) & (F.col("x") < fdiv("nx", 2) * 2))
            .groupBy(*KEYS, "z", fdiv("y", 2).alias("y"), fdiv("x", 2).alias("x"),
                     fdiv("ny", 2).alias("ny"), fdiv("nx", 2).alias("nx"))
            .agg(F.avg("v").alias("v"))
        )
        out = out.unionByName(pick(cur, lv))
    return out


def block_mean(cells: DataFrame, n: int, rows: int = 0, by: Sequence[str] = CELL) -> DataFrame:
    """Mean of n x n sub-pixels.

    Pass ``rows`` where the cells are counted, or at most that many: they are
    then dealt by block in tasks of bounded size and grouped there.  ``by`` are
    the keys that are no constants (Spark groups by these alone).
    """
    blocks = cells.select(*KEYS, "z", fdiv("y", n).alias("y"), fdiv("x", n).alias("x"), "v")
    return (dealt(blocks, rows, *by) if rows else blocks).groupBy(*CELL).agg(F.avg("v").alias("v"))


def composite_rgb(cells: DataFrame, colors: DataFrame, levels: DataFrame) -> DataFrame:
    """Additive colour blend of channels, one RGB triple per (img, t, y, x).

    ``colors``: img, c, r, g, b (0..255); ``levels``: img, c, lo, hi, gamma.
    """
    look = colors.join(levels, ["img", "c"])
    ok = F.col("hi") > F.col("lo")
    norm = (F.col("v") - F.col("lo")) / F.when(ok, F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    norm = F.pow(F.least(F.greatest(norm, F.lit(0.0)), F.lit(1.0)), 1 / F.greatest(F.col("gamma"), F.lit(1e-3)))
    lit = attach(cells, look, ["img", "c"]).withColumn("_n", norm)
    # rounding keeps the floor independent of the order the channels are added in
    band = lambda k: F.floor(
        F.least(F.round(F.sum(F.col("_n") * F.col(k)) / 255, 9), F.lit(1.0)) * 255).cast("int").alias(k)
    return lit.groupBy("img", "t", "y", "x").agg(*[band(k) for k in ("r", "g", "b")])


def simpson(samples: DataFrame, dx: float, keys: Sequence[str], pos: str = "i", value: str = "f") -> DataFrame:
    """Composite Simpson integral per curve; positions are 0..n-1 with odd n."""
    w = F.when(F.col(pos) % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
    g = samples.groupBy(*keys).agg(
        F.sum(F.col(value) * w).alias("_s"), F.min_by(value, pos).alias("_a"),
        F.max_by(value, pos).alias("_b"), F.count(F.lit(1)).alias("n"))
    area = (F.col("_s") - F.col("_a") - F.col("_b")) * F.lit(dx / 3.0)
    even = F.raise_error(F.lit("an odd number of samples per curve is required")).cast("double")
    return g.select(*keys, F.when(F.col("n") % 2 == 1, area).otherwise(even).alias("integral"))
