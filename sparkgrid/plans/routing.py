"""One call for mixed images: a routing table splits them among the ways to restore."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, KEYS, attach, extents, reusable, settle
from sparkgrid.operators import kernel as kn, tiles as tl
from sparkgrid.operators.shape import project_z
from sparkgrid.plans import restore as rs
from sparkgrid.plans.keyed import PARAMS, restore_each
from sparkgrid.plans.restore import PRESETS, Restored, preset_background

#: cells that a tile reads beyond its overlap
MARGIN = 16
#: kernels up to this many taps are applied tap by tap in short runs
FEW_TAPS = 64


@dataclass
class Routed(Restored):
    """``routes`` says which way every image went."""

    routes: DataFrame | None = None


def coarsened(grids: DataFrame, kernel_yx: int) -> DataFrame:
    """Tile grids without tiles smaller than the kernel: fewer tiles, one only where the image itself is that small."""
    fewest = lambda n, size: F.greatest(F.least(F.col(n), F.floor(F.col(size) / kernel_yx)), F.lit(1)).cast("int").alias(n)
    return grids.select("img", "h", "w", fewest("ny", "h"), fewest("nx", "w"))


def restore_tiles(
    cells: DataFrame, kernels: DataFrame, grids: DataFrame, on: Sequence[str] = (), params: DataFrame | None = None,
    margin: int = MARGIN, **options,
) -> Restored:
    """Tiles with overlap and margin as images of their own, blended at the end.

    Every tile estimates its background and stops on its own.  It runs in
    blocks like any image, so neither a large tile nor one large kernel
    becomes a single group.  ``grids`` has ``img, h, w, ny, nx``.
    """
    on = list(on)
    span = kernels.agg(*[(F.max(a) - F.min(a) + 1).alias(a) for a in ("dy", "dx")]).first()
    side = max(span["dy"] or 1, span["dx"] or 1)
    overlap = side // 2
    grids = settle(coarsened(grids, side))
    at = F.concat_ws("\x1f", "img", F.col("iy").cast("string"), F.col("ix").cast("string")).alias("tile")
    table = settle(tl.tile_table(grids, overlap).select(
        "img", at, "iy", "ix", *[F.greatest(F.col(f"{a}0e") - margin, F.lit(0)).alias(f"{a}0") for a in ("y", "x")]))
    parts = tl.assign_halo(cells, grids, overlap, margin).select(*KEYS, *AXES, "v", "iy", "ix")
    moved = attach(parts, table, ["img", "iy", "ix"], settled=True).select(
        F.col("tile").alias("img"), "t", "c", "z", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), "v")
    of_tiles = lambda df: df.join(table.select("img", "tile"), "img").drop("img").withColumnRenamed("tile", "img") if "img" in on else df
    solved = restore_each(settle(moved), of_tiles(kernels), on, None if params is None else of_tiles(params), **options)
    back = table.select(F.col("tile").alias("_tile"), F.col("img").alias("_img"), "iy", "ix", "y0", "x0")
    named = lambda df: attach(df.withColumnRenamed("img", "_tile"), back, ["_tile"], settled=True).withColumnRenamed("_img", "img")
    whole = named(solved.cells).select(
        *KEYS, "z", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"), "v", "iy", "ix")
    used = named(solved.used).groupBy(*KEYS).agg(F.max("iterations").alias("iterations")) if solved.used else None
    history = named(solved.history).select(*KEYS, "iy", "ix", "iter", "metric") if solved.history else None
    return Restored(tl.blend_tiles(whole, grids, overlap), history, used)


def collapsed(kernels: DataFrame, on: list[str], preset: str) -> DataFrame:
    """Each group's kernel cut to its support and summed over z with the preset's weights."""
    key = F.to_json(F.struct(*on)) if on else F.lit("")
    keyed = kernels.withColumn("kid", key)
    flat = kn.kernel_collapse_z(kn.kernel_crop_support(keyed), preset)
    return flat.join(keyed.select("kid", *on).distinct(), "kid").drop("kid") if on else flat.drop("kid")


def restore_planes(
    cells: DataFrame, kernels: DataFrame, on: Sequence[str] = (), preset: str = "balanced", radius: int = 5,
    bg_scale: float = 1.0, params: DataFrame | None = None, **options,
) -> Restored:
    """Single planes with kernels collapsed from 3-D ones and a preset's damping, offset and background."""
    preset = preset.strip().lower()
    damping, offset, factor = PRESETS.get(preset, PRESETS["balanced"])
    opts = dict(options)
    for name, value in (("damping", damping), ("offset", offset)):
        if opts.get(name, "auto") == "auto":
            opts[name] = value
    if opts.get("background", "auto") == "auto":
        opts["background"] = settle(preset_background(cells, radius, factor * max(bg_scale, 0.1)))
    return restore_each(cells, collapsed(kernels, list(on), preset), on, params, **opts)


def routing_table(cells: DataFrame, kernels: DataFrame, on: Sequence[str], modes: DataFrame | None, tile_side: int, short: bool) -> DataFrame:
    """One row per image: its size, its kernel's size, its mode and the route these call for.

    Larger than ``tile_side``: tiles.  One plane of a wide-field image with a
    kernel of several planes: plane.  One small kernel for all and a short
    run: columns.  Everything else: blocks, where kernels longer than the
    image are cropped for each image alone.
    """
    on = list(on)
    sizes = extents(cells, KEYS)
    spans = [(F.max(a) - F.min(a) + 1).cast("int").alias(f"k{a[1]}") for a in kn.OFFSETS]
    per = kernels.groupBy(*on).agg(*spans, F.count("*").alias("taps"))
    table = attach(sizes, per, on) if on else sizes.withColumn("_one", F.lit(0)).join(per.withColumn("_one", F.lit(0)), "_one").drop("_one")
    if modes is not None:
        table = table.join(modes.select(*[k for k in KEYS if k in modes.columns], "mode"), [k for k in KEYS if k in modes.columns], "left")
    else:
        table = table.withColumn("mode", F.lit(None).cast("string"))
    fits = (F.col("kz") <= F.col("nz")) & (F.col("ky") <= F.col("ny")) & (F.col("kx") <= F.col("nx"))
    route = (
        F.when(F.greatest("ny", "nx") > tile_side, "tiles")
        .when((F.col("nz") == 1) & (F.col("kz") > 1) & (F.lower("mode") == "widefield"), "plane")
        .when(fits & (F.col("taps") <= FEW_TAPS) & F.lit(short and not on), "columns").otherwise("blocks"))
    return settle(table.withColumn("route", route))


def restore_routed(
    cells: DataFrame, kernels: DataFrame, on: Sequence[str] = (), modes: DataFrame | None = None, params: DataFrame | None = None,
    tile_side: int = 4096, grids: DataFrame | None = None, preset: str = "balanced", radius: int = 5, **options,
) -> Routed:
    """Restore mixed images in one call, each on the route its size, kernel and mode call for.

    Images larger than ``tile_side`` are cut into tiles of at most that side,
    or as ``grids`` says.  All routes give the same columns; only routes that
    some image takes are run.
    """
    on, cells = list(on), reusable(cells)
    opt = rs.Options(**options)
    routes = routing_table(cells, kernels, on, modes, tile_side, opt.niter <= opt.check_every and params is None)
    taken = {r[0] for r in routes.select("route").distinct().collect()}
    of = lambda name: attach(cells, routes.filter(F.col("route") == name).select(*KEYS), KEYS)
    results: list[Restored] = []
    if "columns" in taken:
        total = kernels.agg(F.sum("w")).first()[0]
        taps = [(*t[:3], t[3] / total) for t in kn.taps_of(kernels)]
        results.append(rs.richardson_lucy(of("columns"), taps, **options))
    if "blocks" in taken:
        results.append(restore_each(of("blocks"), kernels, on, params, **options))
    if "plane" in taken:
        results.append(restore_planes(of("plane"), kernels, on, preset, radius, params=params, **options))
    if "tiles" in taken:
        if grids is None:
            large = routes.filter("route = 'tiles'").groupBy("img").agg(F.max("ny").alias("h"), F.max("nx").alias("w"))
            grids = large.select("img", "h", "w", F.ceil(F.col("h") / tile_side).alias("ny"), F.ceil(F.col("w") / tile_side).alias("nx"))
        results.append(restore_tiles(of("tiles"), kernels, grids, on, params, **options))
    if not results:
        return Routed(cells.select(*KEYS, *AXES, "v").limit(0), None, None, routes)
    every = lambda part: reduce(DataFrame.unionByName, part) if part else None
    return Routed(
        every([r.cells for r in results]), every([r.history.select(*KEYS, "iter", "metric") for r in results if r.history is not None]),
        every([r.used.select(*KEYS, "iterations") for r in results if r.used is not None]), routes)


def restore_fields(
    fields: DataFrame, cells: DataFrame, kernels: DataFrame, on: Sequence[str] = ("c",), params: DataFrame | None = None,
    projection: str = "none", **options,
) -> DataFrame:
    """All fields of plates with the kernels and parameters of their channels or fields; ``img`` is plate/row/col/field."""
    unknown = set(params.columns) - set(PARAMS) - set(on) if params is not None else set()
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}; available: {sorted(PARAMS)}")
    ids = fields.select(F.concat_ws("/", "plate", "row", "col", "field").alias("img")).distinct()
    out = restore_routed(attach(cells, ids, ["img"]), kernels, on, params=params, **options).cells
    return project_z(out, projection) if projection in ("mip", "sum") else out
