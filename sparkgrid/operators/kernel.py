"""Blur kernels as tables ``kid, dz, dy, dx, w`` with offsets from the centre."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import attach

OFFSETS = ["dz", "dy", "dx"]
#: largest kernel applied tap by tap; bigger ones belong to the tiled job
MAX_TAPS = 1024


def kernel_normalize(raw: DataFrame) -> DataFrame:
    """Array positions ``kid,z,y,x,w`` to centred offsets with a sum of one."""
    stat = raw.groupBy("kid").agg(
        F.sum("w").alias("_s"), *[(F.max(a) + 1).alias(f"_n{a}") for a in "zyx"])
    off = lambda a: (F.col(a) - F.floor(F.col(f"_n{a}") / 2)).cast("int").alias(f"d{a}")
    return attach(raw, stat, ["kid"]).select("kid", *[off(a) for a in "zyx"], (F.col("w") / F.col("_s")).alias("w"))


def renormalize(kernel: DataFrame) -> DataFrame:
    total = kernel.groupBy("kid").agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("_s"))
    return attach(kernel, total, ["kid"]).select("kid", *OFFSETS, (F.col("w") / F.col("_s")).alias("w"))


def kernel_gaussian(params: DataFrame, ndim: int = 2) -> DataFrame:
    """Normalised Gaussians for rows ``kid, sigma``: radius max(ceil(3 sigma), 1)."""
    sigma = F.col("sigma")
    r = F.greatest(F.ceil(3.0 * sigma), F.lit(1)).cast("int")
    g = lambda d: F.exp(-0.5 * (d / sigma) * (d / sigma))
    out = params.withColumn("_r", r).withColumn(
        "_s", F.aggregate(F.sequence(-F.col("_r"), F.col("_r")), F.lit(0.0), lambda acc, d: acc + g(d)))
    axes = OFFSETS[-ndim:]
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(-F.col("_r"), F.col("_r"))))
    w = F.lit(1.0)
    for a in axes:
        w = w * g(F.col(a)) / F.col("_s")
    flat = [F.lit(0).alias(a) for a in OFFSETS if a not in axes]
    return out.select("kid", *flat, *axes, w.alias("w")).select("kid", *OFFSETS, "w")


def kernel_product(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Pointwise product of two kernels (the square when there is only one)."""
    if b is None:
        prod = a.select("kid", *OFFSETS, (F.col("w") * F.col("w")).alias("w"))
    else:
        prod = a.join(b.withColumnRenamed("w", "_w"), ["kid", *OFFSETS]).select(
            "kid", *OFFSETS, (F.col("w") * F.col("_w")).alias("w"))
    return renormalize(prod)


# Preset -> divisor of nz that gives the width of the z weights.
Z_WIDTH = {"very conservative": 12.0, "conservative": 8.0, "balanced": 4.0, "strong": 2.5}


def kernel_collapse_z(kernel: DataFrame, mode: str = "balanced") -> DataFrame:
    """Weighted sum over z, renormalised; ``very strong`` weights all planes alike."""
    mode = mode.strip().lower()
    ext = kernel.groupBy("kid").agg(F.min("dz").alias("_lo"), (F.max("dz") - F.min("dz") + 1).alias("_nz"))
    if mode == "very strong":
        wz: Column = F.lit(1.0)
    else:
        width = F.greatest(F.col("_nz") / Z_WIDTH.get(mode, Z_WIDTH["balanced"]), F.lit(1.0))
        u = (F.col("dz") - F.col("_lo") - (F.col("_nz") - 1) / 2.0) / width
        wz = F.exp(-0.5 * u * u)
    flat = attach(kernel, ext, ["kid"]).groupBy("kid", "dy", "dx").agg(F.sum(F.col("w") * wz).alias("w"))
    return renormalize(flat.select("kid", F.lit(0).alias("dz"), "dy", "dx", "w"))


def kernel_crop_support(
    kernel: DataFrame, energy: float = 0.995, min_planes: int = 17, max_planes: int = 65
) -> DataFrame:
    """Smallest symmetric odd z range that holds the wanted share of the sum."""
    planes = kernel.groupBy("kid", F.abs("dz").alias("r")).agg(
        F.sum("w").alias("s"), F.min("dz").alias("lo"), F.max("dz").alias("hi"))
    up = Window.partitionBy("kid").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("kid")
    need = (
        planes.withColumn("cum", F.sum("s").over(up)).withColumn("all", F.sum("s").over(whole))
        .groupBy("kid").agg(
            F.min(F.when(F.col("cum") >= energy * F.col("all"), F.col("r"))).alias("r"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("all").alias("all"))
    )
    center = -F.col("lo")
    nz = F.col("hi") - F.col("lo") + 1
    n = F.least(F.greatest(2 * F.coalesce("r", center) + 1, F.lit(min_planes)), F.lit(max_planes), nz)
    n = F.when((n % 2 == 0) & (n > 1), n - 1).otherwise(n)
    first = F.greatest(center - F.floor(n / 2), F.lit(0))
    last = F.least(center + F.floor(n / 2) + 1, nz)
    first = F.when(last - first < n, F.greatest(last - n, F.lit(0))).otherwise(first)
    keep = need.select(
        "kid", (first - center).alias("_from"), n.alias("_n"), ((F.col("all") <= 0) | (nz <= 1)).alias("_all"))
    j = attach(kernel, keep, ["kid"])
    inside = F.col("_all") | ((F.col("dz") >= F.col("_from")) & (F.col("dz") < F.col("_from") + F.col("_n")))
    shift = F.when(F.col("_all"), F.col("dz")).otherwise(F.col("dz") - F.col("_from") - F.floor(F.col("_n") / 2))
    return j.filter(inside).select("kid", shift.cast("int").alias("dz"), "dy", "dx", "w")


def kernel_center_crop(kernel: DataFrame, shape: DataFrame) -> DataFrame:
    """Cut every axis that is longer than the image (``kid, nz, ny, nx``)."""
    ext = kernel.groupBy("kid").agg(*[
        f(a).alias(f"_{n}{a}") for a in OFFSETS for n, f in (("lo", F.min), ("hi", F.max))])
    j = attach(kernel, ext.join(shape, "kid"), ["kid"])
    cols = []
    for a, n in zip(OFFSETS, ["nz", "ny", "nx"]):
        size = F.col(f"_hi{a}") - F.col(f"_lo{a}") + 1
        start = F.when(size > F.col(n), F.floor((size - F.col(n)) / 2)).otherwise(F.lit(0))
        i = F.col(a) - F.col(f"_lo{a}") - start
        left = F.least(size, F.col(n))
        j = j.filter((i >= 0) & (i < left))
        cols.append((i - F.floor(left / 2)).cast("int").alias(a))
    return j.select("kid", *cols, "w")


def kernel_summary(kernel: DataFrame) -> DataFrame:
    return kernel.groupBy("kid").agg(
        *[(F.max(a) - F.min(a) + 1).cast("int").alias(f"n{a[1]}") for a in OFFSETS],
        F.sum("w").alias("total"), F.max("w").alias("peak"))


def single(kernel: DataFrame) -> None:
    """Refuse a table of several kernels where one is meant."""
    if "kid" in kernel.columns and len(kernel.select("kid").distinct().limit(2).collect()) > 1:
        raise ValueError("several kernels given where one is expected: choose one by kid")


def taps_of(kernel: DataFrame) -> list[tuple[int, int, int, float]]:
    """One small kernel as Python tuples, for use as a literal; size and number are checked."""
    single(kernel)
    rows = kernel.select(*OFFSETS, "w").limit(MAX_TAPS + 1).collect()
    if len(rows) > MAX_TAPS:
        raise ValueError(f"kernel has more than {MAX_TAPS} taps: use the tiled job")
    return sorted((r.dz, r.dy, r.dx, r.w) for r in rows)


def separable(*axes: Sequence[float]) -> list[tuple[int, int, int, float]]:
    """Taps of an outer product of 1-D weights for z, y, x, centred at size // 2."""
    z, y, x = axes
    total = sum(z) * sum(y) * sum(x)
    return [
        (i - len(z) // 2, j - len(y) // 2, k - len(x) // 2, a * b * c / total)
        for i, a in enumerate(z) for j, b in enumerate(y) for k, c in enumerate(x)
    ]
