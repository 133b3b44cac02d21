"""Large images: independent tiles with halo, solved in parallel and blended."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import KEYS, extents, reusable, settle
from sparkgrid.operators import tiles as tl
from sparkgrid.operators.neighbors import Tap
from sparkgrid.operators.stencil import gaussian_weights
from sparkgrid.plans import dense
from sparkgrid.operators.kernel import single
from sparkgrid.plans.restore import Options, Restored, momentum_weight
from sparkgrid.plans.routing import coarsened, restore_tiles


MARGIN = 16
#: entries of a kernel shipped to the tasks (32 MB of doubles)
MAX_KERNEL = 4_000_000

#: cells of a tile with its rim that one task solves; larger tiles run in blocks
MAX_TILE = 1 << 19

OUT = "img string, t int, c int, z int, y int, x int, v double, iy int, ix int, metric double, iterations int"


def kernel_array(kernel: DataFrame) -> np.ndarray:
    """One kernel table as a dense block; its size is checked first."""
    single(kernel)
    rows = kernel.select("dz", "dy", "dx", "w").limit(MAX_KERNEL + 1).toPandas()
    if len(rows) > MAX_KERNEL:
        raise ValueError(f"kernel has more than {MAX_KERNEL} entries")
    idx = [rows[a].to_numpy() for a in ("dz", "dy", "dx")]
    # odd or even length, the centre stays at size // 2
    half = [max(-int(i.min()), int(i.max())) for i in idx]
    shape = [2 * h + 1 for h in half]
    out = np.zeros(shape)
    np.add.at(out, tuple(i + h for i, h in zip(idx, half)), rows["w"].to_numpy())
    return out


def kernel_block(taps: Sequence[Tap]) -> np.ndarray:
    """Taps as a dense odd block with offset zero in its middle."""
    half = [max(abs(t[i]) for t in taps) for i in range(3)]
    out = np.zeros([2 * h + 1 for h in half])
    for *offset, w in taps:
        out[tuple(o + h for o, h in zip(offset, half))] += w
    return out


def kernel_table(cells: DataFrame, kernel: np.ndarray) -> DataFrame:
    """The entries of a dense kernel that are not zero, as offsets from its centre."""
    at = np.nonzero(kernel)
    rows = pd.DataFrame({f"d{a}": i - n // 2 for a, i, n in zip(("z", "y", "x"), at, kernel.shape)} | {"w": kernel[at]})
    return cells.sparkSession.createDataFrame(rows, "dz int, dy int, dx int, w double")


def too_large(cells: DataFrame, grids: DataFrame, kernel: np.ndarray, rim: int) -> bool:
    """Does some tile exceed ``MAX_TILE`` where blocks can take its place?

    Blocks crop a kernel that is longer than its image, tiles do not.
    """
    depth = cells.groupBy("img").agg((F.max("z") + 1).alias("nz"))
    side = lambda size, n: F.least(F.ceil(F.col(size) / F.col(n)) + 2 * rim, F.col(size))
    sides = grids.join(depth, "img").agg(
        F.max(F.col("nz") * side("h", "ny") * side("w", "nx")).alias("most"),
        F.min("nz"), F.min(F.floor(F.col("h") / F.col("ny"))), F.min(F.floor(F.col("w") / F.col("nx")))).first()
    return sides[0] is not None and sides[0] > MAX_TILE and all(k <= n for k, n in zip(kernel.shape, sides[1:]))


def auto_grid(dims: DataFrame, budget: float, kernel_yx: int) -> DataFrame:
    """Tile grid per image (``img, h, w, ny, nx``) from a memory budget in bytes."""
    side = tl.suggest_tile(F.col("nz"), F.lit(float(budget)), kernel_yx)
    n = tl.tile_count(F.col("ny"), F.col("nx"), side)
    return tl.best_tile_grid(dims.select("img", F.col("ny").alias("h"), F.col("nx").alias("w"), n.alias("n")))


def restore_tiled(
    cells: DataFrame,
    kernel: np.ndarray,
    grids: DataFrame | None = None,
    budget: float = 5e8,
    tv_lambda: float = 0.0,
    z_scale: float = 1.0,
    sparse: tuple[float, float] | None = None,
    margin: int = MARGIN,
    **options,
) -> Restored:
    """Solve every (image, time, channel, tile) on its own; two exchanges in all.

    Each tile estimates its own background and stops on its own.  Grids whose
    tiles would be smaller than the kernel are made coarser.  The plain update
    of tiles above ``MAX_TILE`` cells runs in blocks, with the same result, so
    that no task holds a tile that grows with its image.
    """
    opt = Options(**options)
    if isinstance(opt.background, DataFrame):
        raise ValueError("tiles take 'auto' or one number as background")
    overlap = max(kernel.shape[-2:]) // 2
    cells = reusable(cells)
    if grids is None:
        grids = auto_grid(extents(cells), budget, max(kernel.shape[-2:]))
    grids = settle(coarsened(grids, max(kernel.shape[-2:])))
    if tv_lambda <= 0 and sparse is None and too_large(cells, grids, kernel, overlap + margin):
        r = restore_tiles(cells, kernel_table(cells, kernel), grids, margin=margin, **{**options, "track": True})
        last = r.history.groupBy(*KEYS, "iy", "ix").agg(F.max_by("metric", "iter").alias("metric"), F.max("iter").alias("iter"))
        return Restored(r.cells, last, r.used)
    job = dense.Job(
        kernel=kernel, momentum=[momentum_weight(k) for k in range(1, opt.niter + 1)], offset=opt.offset_value,
        background=None if opt.background == "auto" else float(opt.background), damping=opt.damp_strength,
        start=opt.start, auto_stop=opt.convergence == "auto", earliest_stop=opt.earliest_stop,
        rel_threshold=opt.rel_threshold, check_every=opt.check_every,
        prefilter=gaussian_weights(opt.prefilter_sigma) if opt.prefilter_sigma > 0 else None,
        lowpass=gaussian_weights(8.0), tv_lambda=tv_lambda, z_scale=z_scale, sparse=sparse)
    # a plain dict travels; the class itself goes by value with the task
    shipped = cells.sparkSession.sparkContext.broadcast(vars(job))
    solve, settings, names = dense.solve, dense.Job, [column.split()[0] for column in OUT.split(", ")]

    def tile(table: pa.Table) -> pa.Table:
        at = [table.column(a).to_numpy() for a in ("z", "y", "x")]
        low = [int(i.min()) for i in at]
        pos = tuple(i - o for i, o in zip(at, low))
        block = np.zeros([int(i.max()) + 1 for i in pos])
        block[pos] = table.column("v").to_numpy()
        done, metric, used = solve(block, settings(**shipped.value))
        n = table.num_rows
        made = {"v": pa.array(done[pos]), "metric": pa.array(np.full(n, metric)), "iterations": pa.array(np.full(n, used, np.int32))}
        return pa.table({k: made[k] if k in made else table.column(k) for k in names})

    parts = tl.assign_halo(cells, grids, overlap, margin).select(*KEYS, "z", "y", "x", "v", "iy", "ix")
    solved = settle(parts.groupBy(*KEYS, "iy", "ix").applyInArrow(tile, OUT))
    used = solved.groupBy(*KEYS).agg(F.max("iterations").alias("iterations"))
    history = solved.groupBy(*KEYS, "iy", "ix").agg(F.max("metric").alias("metric"), F.max("iterations").alias("iter"))
    return Restored(tl.blend_tiles(solved, grids, overlap), history, used)
