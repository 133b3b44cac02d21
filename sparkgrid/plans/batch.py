"""Method registry and batch runs over plates, series and benchmarks."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.core import attach, settle
from sparkgrid.functions.scalar import per_channel_param
from sparkgrid.operators.neighbors import Tap
from sparkgrid.operators.shape import center_crop, project_z
from sparkgrid.operators.spectral import effect_metrics
from sparkgrid.plans import restore as rs

#: name -> (function, own parameters, working memory relative to the image)
METHODS = {
    "rl": (rs.richardson_lucy, {"damping"}, 8),
    "rl_tv": (rs.richardson_lucy_tv, {"damping", "tv_lambda", "pixel_xy", "pixel_z", "sign"}, 8),
    "sparse_hessian": (rs.sparse_hessian_deconvolve, {"weight", "reg", "pixel_xy", "pixel_z", "volume"}, 10),
}
SPECIAL = set().union(*(p for _, p, _ in METHODS.values()))


def crop_taps(taps: Sequence[Tap], shape: tuple[int, int, int]) -> list[Tap]:
    """Cut kernel axes longer than the image, as an even crop around the middle."""
    out = list(taps)
    for i, n in enumerate(shape):
        lo, hi = min(t[i] for t in out), max(t[i] for t in out)
        size = hi - lo + 1
        if size > n:
            start = lo + (size - n) // 2
            out = [t for t in out if start <= t[i] < start + n]
            out = [(*t[:i], t[i] - start - n // 2, *t[i + 1:]) for t in out]
    return out


def restore_dispatch(
    cells: DataFrame, taps: Sequence[Tap], method: str = "rl", shape: tuple[int, int, int] | None = None, **params
) -> rs.Restored:
    """Run a method by name; parameters other methods use are dropped.

    ``shape`` is the smallest image's size and cuts larger kernels to it.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; available: {sorted(METHODS)}")
    fn, own, _ = METHODS[method]
    kept = {k: v for k, v in params.items() if k not in SPECIAL or k in own}
    if shape is not None:
        taps = crop_taps(taps, shape)
    total = sum(t[3] for t in taps)
    return fn(cells, [(*t[:3], t[3] / total) for t in taps], **kept)


def restore_series(
    cells: DataFrame,
    taps: Sequence[Tap],
    method: str = "rl",
    niter: int | Sequence[int] = 40,
    projection: str = "none",
    **params,
) -> DataFrame:
    """Every field, time point and channel at once; they are only keys.

    With a list of iteration counts, channels that share a count run together.
    """
    counts = [niter] if isinstance(niter, int) else list(niter)
    per = per_channel_param(F.array(*[F.lit(n) for n in counts]), F.col("c"))
    out = None
    for n in sorted(set(counts)):
        part = restore_dispatch(cells.filter(per == n) if len(counts) > 1 else cells, taps, method, niter=n, **params).cells
        out = part if out is None else out.unionByName(part)
    return project_z(out, projection) if projection in ("mip", "sum") else out


def restore_plate(fields: DataFrame, cells: DataFrame, taps: Sequence[Tap], method: str = "rl", **params) -> DataFrame:
    """Restore the fields of plates; ``img`` is plate/row/col/field."""
    ids = fields.select(F.concat_ws("/", "plate", "row", "col", "field").alias("img")).distinct()
    return restore_series(attach(cells, ids, ["img"]), taps, method, **params)


def benchmark_methods(
    spark: SparkSession,
    cells: DataFrame,
    taps: Sequence[Tap],
    niter: int = 10,
    methods: Sequence[str] = tuple(METHODS),
    quality: bool = True,
    crop: tuple[int, int, int] | None = None,
    sample: tuple[int, int] | None = None,
    **params,
) -> DataFrame:
    """Time each method on the same cells; a method that fails ends the run.

    ``crop`` (planes, rows, columns) asks for a central crop instead of whole
    images, ``sample`` for metrics of a strided sample.  A table without the
    row of a failed method would look like the whole benchmark, so its error
    is raised, with the method's name.
    """
    if not methods:
        raise ValueError("no methods given")
    crop_cells = settle(center_crop(cells, *crop) if crop else cells)
    tables = []
    for m in methods:
        t0 = time.perf_counter()
        try:
            result = settle(restore_dispatch(crop_cells, taps, m, niter=niter, **params).cells)
        except Exception as exc:
            exc.add_note(f"benchmark of method {m!r} failed")
            raise
        row = F.lit(f"{m}_{niter}i").alias("label"), F.lit(round(time.perf_counter() - t0, 3)).alias("time_s")
        if quality:
            q = effect_metrics(result, sample)
            names = [c for c in q.columns if c not in ("img", "t", "c")]
            tables.append(q.groupBy().agg(F.count(F.lit(1)).alias("channels_compared"), *[F.avg(n).alias(f"{n}_mean") for n in names])
                          .select(*row, "*"))
        else:
            tables.append(result.groupBy().agg(F.count(F.lit(1)).alias("cells")).select(*row))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
