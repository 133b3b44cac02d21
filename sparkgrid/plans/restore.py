"""Iterative deblurring of cell tables.

State is one row per cell of the work box (the image dilated by the kernel).
A data step needs the estimate within one kernel width around a block, so a
step is one exchange of block rims; both the forward and the adjoint sums then
run inside the block.  Long runs widen the rims and do several updates of dense
blocks per exchange, with the same result.  All images, time points and channels advance together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import AXES, BLOCK, CELL, KEYS, attach, beside, discard, extents, fdiv, grid, reusable, settle, spread, write_aside
from sparkgrid.functions.scalar import damped, damping_exponent
from sparkgrid.operators import kernel as kn
from sparkgrid.operators.conv import flip, inside_sum, work_ranges
from sparkgrid.operators.neighbors import Tap, reach, route, scatter, tap_array
from sparkgrid.operators.rank import background_level, noise_sigma
from sparkgrid.operators.stats import divergence_of, nll_of
from sparkgrid.plans import dense
from sparkgrid.operators.stencil import (
    anscombe_prefilter, axis_scales, gaussian_smooth, local_background, sparse_hessian_gradient,
    sparse_hessian_penalty, tv_factor,
)

# executors need NumPy but not this package
cloudpickle.register_pickle_by_value(dense)


@dataclass
class Restored:
    """Cells, the convergence table and the iterations spent per image."""

    cells: DataFrame
    history: DataFrame | None = None
    used: DataFrame | None = None


@dataclass
class Options:
    """Settings shared by the restoration methods."""

    niter: int = 40
    offset: float | str = "auto"
    background: float | str | DataFrame = "auto"
    prefilter_sigma: float = 0.0
    start: str = "flat"
    damping: float | str = 0.0
    convergence: str = "auto"
    rel_threshold: float = 0.005
    check_every: int = 5
    checkpoint_every: int = 4
    track: bool = True
    block: int = BLOCK
    #: "columns" (expressions only), "blocks" (dense blocks) or "auto"
    engine: str = "auto"
    dense_block: int = 256
    smooth_axes: Sequence[str] = ("z", "y", "x")

    offset_value: float = field(init=False)
    damp_strength: float = field(init=False)

    def __post_init__(self) -> None:
        self.offset_value = 5.0 if self.offset == "auto" else max(float(self.offset), 0.0)
        self.damp_strength = 3.0 if self.damping == "auto" else max(float(self.damping), 0.0)
        if self.start not in ("flat", "observed", "lowpass"):
            self.start = "flat"

    @property
    def dense(self) -> bool:
        """Long runs pay for dense blocks: several updates per exchange."""
        if self.engine not in ("auto", "columns", "blocks"):
            raise ValueError(f"unknown engine {self.engine!r}")
        return self.engine == "blocks" or (self.engine == "auto" and self.niter > self.check_every)

    @property
    def earliest_stop(self) -> int:
        return max(10, self.niter // 4)


def momentum_weight(k: int) -> float:
    """Heavy-ball weight of iteration ``k`` (1-based); none before the third."""
    return 0.0 if k < 3 else min((k - 1.0) / (k + 2.0), 1.0 - 2.0 / math.sqrt(k + 3.0))


def momentum(cur: Column, prev: Column, k: int, bg: Column) -> Column:
    return F.greatest(cur + momentum_weight(k) * (cur - prev), bg)


def prepare(cells: DataFrame, taps: Sequence[Tap], opt: Options) -> DataFrame:
    """Work-box state with background, noise level, boundary weights and start."""
    return prepare_work(cells, taps, opt)[0]


def prepare_work(cells: DataFrame, taps: Sequence[Tap], opt: Options) -> tuple[DataFrame, DataFrame]:
    """The state and the settled one-row-per-image table behind it."""
    base = reusable(cells.select(*CELL, "v"))
    if isinstance(opt.background, DataFrame):
        bg = opt.background.select(*KEYS, F.greatest("background", F.lit(1e-6)).alias("bg"))
    elif opt.background == "auto":
        bg = background_level(base).select(*KEYS, F.greatest("background", F.lit(1e-6)).alias("bg"))
    else:
        bg = base.select(*KEYS).distinct().withColumn("bg", F.lit(max(float(opt.background), 1e-6)))
    image = base.withColumn("v", F.col("v") + opt.offset_value)
    if opt.prefilter_sigma > 0:
        image = settle(anscombe_prefilter(image, opt.prefilter_sigma, opt.smooth_axes))
    groups = image.groupBy(*KEYS).agg(
        *[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in AXES], F.avg("v").alias("mean"))
    groups = groups.join(bg.withColumn("bg", F.col("bg") + opt.offset_value), KEYS)
    if opt.damp_strength > 0:
        groups = groups.join(noise_sigma(image), KEYS)
    else:
        groups = groups.withColumn("sigma", F.lit(0.0))
    groups = settle(groups)
    keyed = image.select(*CELL, F.col("v").alias("d"))
    keyed = keyed.withColumn("by", fdiv("y", opt.block)).withColumn("bx", fdiv("x", opt.block))
    if opt.start == "lowpass":
        low = gaussian_smooth(image, 8.0, opt.smooth_axes)
        keyed = beside(keyed, low.withColumnRenamed("v", "low"), CELL)
    box = grid(groups, work_ranges(taps), opt.block)
    on = KEYS + ["by", "bx"] + AXES
    state = beside(box, spread(keyed, *KEYS, "by", "bx"), on, "left")
    # dense blocks derive the weights themselves
    mass = F.lit(0.0) if opt.dense else inside_sum(taps, F.col("nz"), F.col("ny"), F.col("nx"))
    state = state.withColumn("_m", mass).withColumn(
        "w", F.when(F.col("_m") > 0.01, 1 / F.col("_m")).otherwise(F.lit(0.0)))
    x0 = {
        "flat": F.greatest("mean", "bg"),
        "observed": F.coalesce("d", "bg"),
        "lowpass": F.greatest(F.coalesce(F.col("low"), F.col("bg")), F.col("bg")) if opt.start == "lowpass" else None,
    }[opt.start]
    return state.select(
        *CELL, "d", "bg", "sigma", "w", x0.alias("xp"), x0.alias("xc"), F.lit(0).alias("done")), groups


def with_center(taps: Sequence[Tap]) -> tuple[list[Tap], int]:
    """Taps that surely contain the zero offset, and its index."""
    taps = list(taps)
    for k, t in enumerate(taps):
        if t[:3] == (0, 0, 0):
            return taps, k
    return [*taps, (0, 0, 0, 0.0)], len(taps)


def _expand(df: DataFrame, taps: Sequence[Tap]) -> DataFrame:
    hit = df.withColumn("tap", F.explode(tap_array(taps)))
    return hit.select(
        *[c for c in hit.columns if c not in AXES],
        *[(F.col(a) + F.col(f"tap.d{a}")).cast("int").alias(a) for a in AXES])


def data_step(state: DataFrame, taps: Sequence[Tap], k: int, opt: Options) -> DataFrame:
    """Forward sum, ratio inside the image, adjoint sum; one exchange.

    Returns the state with ``p`` (the extrapolated estimate) and ``corr``.
    """
    B = opt.block
    full, centre = with_center(taps)
    back = flip(full)
    width = lambda i: reach(full, i)[1] - reach(full, i)[0]
    carried = ["p", "d", "bg", "sigma", "w", "xc", "done"]
    src = state.select(*CELL, *carried[1:], momentum(F.col("xc"), F.col("xp"), k, F.col("bg")).alias("p"))
    at_self = lambda c: F.max(F.when(F.col("tap.k") == centre, F.col(c))).alias(c)
    part = KEYS + ["hby", "hbx"]

    def near(a: str, hb: str, i: int) -> Column:
        lo, hi = reach(full, i)
        first = F.col(hb) * B
        return (F.col(a) >= first + lo) & (F.col(a) <= first + (B - 1 + hi))

    routed = route(src, (-width(1), width(1)), (-width(2), width(2)), KEYS, B)
    mid = (
        _expand(routed, full).filter(near("y", "hby", 1) & near("x", "hbx", 2))
        .groupBy(*part, *AXES)
        .agg(F.sum(F.col("p") * F.col("tap.w")).alias("est"), *[at_self(c) for c in carried])
    )
    own = (fdiv("y", B) == F.col("hby")) & (fdiv("x", B) == F.col("hbx"))
    mid = mid.filter(F.col("bg").isNotNull() & (F.col("d").isNotNull() | own))
    ratio = F.when(F.col("d").isNotNull(), F.col("d") / F.greatest("est", "bg"))
    out = (
        _expand(mid.withColumn("ratio", ratio).drop("est"), back)
        .filter(own & (F.col("ratio").isNotNull() | (F.col("tap.k") == centre)))
        .groupBy(*part, *AXES)
        .agg(F.coalesce(F.sum(F.col("ratio") * F.col("tap.w")), F.lit(0.0)).alias("corr"), *[at_self(c) for c in carried])
    )
    return out.filter(F.col("bg").isNotNull()).drop("hby", "hbx")


def rl_step(state: DataFrame, taps: Sequence[Tap], k: int, opt: Options) -> DataFrame:
    """One accelerated multiplicative update; finished images stay as they are."""
    step = data_step(state, taps, k, opt)
    corr = F.col("corr")
    if opt.damp_strength > 0:
        corr = damped(corr, damping_exponent(F.col("p"), F.col("sigma"), opt.damp_strength, F.col("bg")))
    new = F.greatest(F.col("p") * corr * F.col("w"), F.col("bg"))
    return _advance(step, new)


def _advance(step: DataFrame, new: Column) -> DataFrame:
    moved = F.when(F.col("done") == 1, F.col("xc")).otherwise(new)
    return step.select(*CELL, "d", "bg", "sigma", "w", F.col("xc").alias("xp"), moved.alias("xc"), "done")


def tv_step(lam: float, scales: dict[str, float], sign: str, groups: DataFrame):
    """Data step followed by the total-variation factor, in array storage order.

    The work box is stored circularly: cells left of the image come after the
    cells right of it.  The factor is defined on that order.
    """

    def run(state: DataFrame, taps_: Sequence[Tap], k: int, opt: Options) -> DataFrame:
        step = data_step(state, taps_, k, opt)
        corr = F.col("corr")
        if opt.damp_strength > 0:
            corr = damped(corr, damping_exponent(F.col("p"), F.col("sigma"), opt.damp_strength, F.col("bg")))
        raw = step.withColumn("v", F.col("p") * corr * F.col("w")).drop("corr", "p")
        ranges = work_ranges(taps_)
        bounds = [r.alias(f"_{n}{a}") for a in AXES for n, r in zip(("lo", "hi"), ranges[a])]
        stored = attach(raw, groups.select(*KEYS, *bounds), KEYS, settled=True)
        for a in AXES:
            size = F.col(f"_hi{a}") - F.col(f"_lo{a}") + 1
            stored = stored.withColumn(a, F.pmod(F.col(a), size).cast("int"))
        ends = [f"_{n}{a}" for a in AXES for n in ("lo", "hi")]
        f = tv_factor(stored, lam, scales, sign, carry=["d", "bg", "sigma", "w", "xc", "done", *ends])
        for a in AXES:
            size = F.col(f"_hi{a}") - F.col(f"_lo{a}") + 1
            f = f.withColumn(a, F.when(F.col(a) > F.col(f"_hi{a}"), F.col(a) - size).otherwise(F.col(a)).cast("int"))
        return _advance(f, F.greatest(F.col("v") * F.col("factor"), F.col("bg")))

    return run


def sparse_step(w: float, reg: float, z_scale: float, volume: bool):
    """Data step, then a normalised step down the sparse-Hessian gradient.

    ``scratch`` lists the tables an update has written; once the state that
    was made from them is saved they can go.
    """
    scratch: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        out, path = write_aside(df)
        scratch.append(path)
        return out

    def run(state: DataFrame, taps: Sequence[Tap], k: int, opt: Options) -> DataFrame:
        step = data_step(state, taps, k, opt).withColumn(
            "v", F.greatest(F.col("p") * F.col("corr") * F.col("w"), F.col("bg"))).drop("corr", "p")
        step = kept(step)
        image = step.filter(F.col("d").isNotNull()).select(*CELL, "v", "bg")
        grad = kept(sparse_hessian_gradient(image, w, z_scale, volume))
        scale = grad.groupBy(*KEYS).agg(F.greatest(F.avg(F.abs("g")), F.lit(1e-12)).alias("_scale"))
        signal = image.groupBy(*KEYS).agg(F.greatest(F.avg("v") - F.first("bg"), F.lit(1.0)).alias("_signal"))
        moved = attach(beside(step, grad, CELL, "left"), scale.join(signal, KEYS), KEYS)
        down = F.col("v") - 0.1 * max(1.0 - reg, 0.0) * F.col("_signal") * F.col("g") / F.col("_scale")
        new = F.when(F.col("d").isNotNull(), F.greatest(down, F.col("bg"))).otherwise(F.col("v"))
        return _advance(moved, new)

    run.scratch = scratch
    return run


def forward_pairs(state: DataFrame, taps: Sequence[Tap], opt: Options) -> DataFrame:
    """Observed ``d`` and re-blurred estimate ``e`` on image cells."""
    full, centre = with_center(taps)
    at_self = lambda c: F.max(F.when(F.col("tap.k") == centre, F.col(c))).alias(c)
    src = state.select(*CELL, "d", "bg", "xc")
    out = scatter(src, full, [F.sum(F.col("xc") * F.col("tap.w")).alias("e"), at_self("d"), at_self("bg")], KEYS, opt.block)
    return out.filter(F.col("d").isNotNull())


def idiv_metric(state: DataFrame, taps: Sequence[Tap], opt: Options) -> DataFrame:
    e = F.greatest("e", "bg")
    return forward_pairs(state, taps, opt).groupBy(*KEYS).agg(F.avg(divergence_of(F.col("d"), e)).alias("metric"))


def block_steps(state: DataFrame, taps: Sequence[Tap], k: int, opt: Options, first: int) -> DataFrame:
    """Updates ``first``..``k`` with one exchange.

    Each block is sent with a halo as wide as all these updates can reach, so
    its own cells come out exactly as in the column plan.  A block and its
    halo are bounded by ``dense_block``, whatever the size of the image.
    """
    B, steps = opt.dense_block, k - first + 1
    halo, origin = {}, {}
    for i, a in ((1, "y"), (2, "x")):
        lo, hi = reach(taps, i)
        halo[a], origin[a] = steps * (hi - lo) + max(-lo, hi, 0), max(hi, 0)  # blocks start at the edge of the work box
    job = (list(taps), [momentum_weight(i) for i in range(first, k + 1)], opt.damp_strength)
    advance = dense.advance

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pdf[a].to_numpy() for a in ("z", "y", "x"))
        own = ((at[1] + origin["y"]) // B == pdf["hby"].iloc[0]) & ((at[2] + origin["x"]) // B == pdf["hbx"].iloc[0])
        out = pdf.loc[own, ["img", "t", "c", "z", "y", "x", "d", "bg", "sigma"]].copy()
        xp, xc = pdf["xp"].to_numpy(), pdf["xc"].to_numpy()
        done = int(pdf["done"].iloc[0])
        updates = [] if done else job[1]
        xp, xc, est = advance(
            at, pdf["d"].to_numpy(dtype="float64"), xp, xc, float(pdf["bg"].iloc[0]), float(pdf["sigma"].iloc[0]),
            job[0], updates, job[2])
        out["xp"], out["xc"], out["est"], out["done"] = xp[own], xc[own], est[own], done
        return out

    src = state.select(*CELL, "d", "bg", "sigma", "xp", "xc", "done")
    at = lambda a, by: F.greatest(fdiv(F.col(a) + F.lit(origin[a] + by * halo[a]), B), F.lit(0))
    near = lambda a: F.explode(F.sequence(at(a, -1), at(a, 1)))
    parts = spread(src.withColumn("hby", near("y")).withColumn("hbx", near("x")), *KEYS, "hby", "hbx")
    types = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = ", ".join(f"{n} {types.get(n, 'double')}" for n in [*CELL, "d", "bg", "sigma", "xp", "xc", "est", "done"])
    return parts.groupBy(*KEYS, "hby", "hbx").applyInPandas(block, schema)


def block_metric(state: DataFrame, taps: Sequence[Tap], opt: Options) -> DataFrame:
    """Divergence from the estimate the last block update left behind."""
    term = divergence_of(F.col("d"), F.greatest("est", "bg"))
    return state.filter(F.col("d").isNotNull()).groupBy(*KEYS).agg(F.avg(term).alias("metric"))


def legs(opt: Options) -> list[tuple[int, int]]:
    """First and last update of every exchange; checks end a leg."""
    if not opt.dense:
        return [(k, k) for k in range(1, opt.niter + 1)]
    return [(k, min(k + opt.check_every - 1, opt.niter)) for k in range(1, opt.niter + 1, opt.check_every)]


def run(
    state: DataFrame, taps: Sequence[Tap], opt: Options, step=rl_step, metric=idiv_metric
) -> Restored:
    """Driver loop: lazy steps, periodic reliable checkpoints, per-image stop.

    The driver sees one boolean per check (is any image still running).
    """
    checks: list[DataFrame] = []
    prev: DataFrame | None = None
    used: DataFrame | None = None
    spark = state.sparkSession
    kept: list[str] = []

    def save(st: DataFrame) -> DataFrame:
        """Write the state; states before the last one are no longer needed."""
        out, path = write_aside(st)
        kept.append(path)
        while len(kept) > 2:
            discard(spark, kept.pop(0))
        scratch = getattr(step, "scratch", [])
        while scratch:
            discard(spark, scratch.pop())
        return out

    for first, k in legs(opt):
        state = block_steps(state, taps, k, opt, first) if opt.dense else step(state, taps, k, opt)
        check = opt.track and (k % opt.check_every == 0 or k == opt.niter)
        if check or opt.dense or k % opt.checkpoint_every == 0:
            state = save(state)
        if not check:
            continue
        cur = settle(metric(state, taps, opt).withColumn("iter", F.lit(k)))
        if used is not None:
            # images that stopped earlier record no further checks
            cur = settle(cur.join(used.select(*KEYS), KEYS, "left_anti"))
        checks.append(cur)
        if opt.convergence == "auto" and prev is not None and k > opt.earliest_stop:
            rel = (F.col("_before") - F.col("metric")) / F.col("_before")
            stop = prev.select(*KEYS, F.col("metric").alias("_before")).join(cur, KEYS).filter(
                (F.col("_before") > 0) & (rel < opt.rel_threshold)).select(*KEYS, F.lit(k).alias("iterations"))
            used = settle(stop if used is None else used.unionByName(stop))
            if k < opt.niter:
                ended = used.select(*KEYS, F.lit(1).alias("_stop"))
                state = attach(state, ended, KEYS, "left", settled=True).withColumn(
                    "done", F.greatest("done", F.coalesce("_stop", F.lit(0)))).drop("_stop")
                if state.filter(F.col("done") == 0).isEmpty():
                    break
        prev = cur
    shift = F.greatest(F.col("xc") - opt.offset_value, F.lit(0.0)) if opt.offset_value > 0 else F.col("xc")
    cells = state.filter(F.col("d").isNotNull()).select(*CELL, shift.alias("v"))
    history = reduce(DataFrame.unionByName, checks).select(*KEYS, "iter", "metric") if checks else None
    groups = state.select(*KEYS).distinct()
    if used is None:
        spent = groups.withColumn("iterations", F.lit(opt.niter))
    else:
        spent = groups.join(used, KEYS, "left").withColumn("iterations", F.coalesce("iterations", F.lit(opt.niter)))
    return Restored(cells, history, spent)


def richardson_lucy(cells: DataFrame, taps: Sequence[Tap], **options) -> Restored:
    """Momentum-accelerated multiplicative deblurring with boundary weights.

    Two updates or more run in dense blocks, unless ``engine`` says otherwise.
    """
    opt = Options(**options)
    if opt.engine == "auto" and opt.niter > 1:
        opt = Options(**{**options, "engine": "blocks"})
    state, groups = prepare_work(cells, taps, opt)
    if opt.dense and "dense_block" not in options:  # blocks are not cut in z, so deep ones are narrower
        depth = groups.agg(F.max("nz")).first()[0] or 1
        opt.dense_block = max(opt.dense_block // math.ceil(math.sqrt(depth)), 32)
    return run(state, taps, opt, metric=block_metric if opt.dense else idiv_metric)


def whole_images(cells: DataFrame, taps: Sequence[Tap], opt: Options, columns: Callable[[DataFrame], Restored], planes: bool = False, **method) -> Restored:
    """Images of at most ``dense_block`` squared cells each in one task, larger ones by ``columns``.

    Only untracked runs, whose images all take ``niter`` updates, and kernels
    that sum to one and reach as far to either side: the circular box of the
    total variation is then the same.  ``planes`` leaves stacks to ``columns`` too.
    """
    from sparkgrid.plans import tiled  # that module builds on this one
    even = all(lo == -hi for lo, hi in (reach(taps, i) for i in range(3)))
    asked = opt.engine != "auto" or opt.checkpoint_every != Options.checkpoint_every  # a setting of the column plan
    if asked or opt.track or isinstance(opt.background, DataFrame) or not even or abs(sum(t[3] for t in taps) - 1) > 1e-9:
        return columns(cells)
    cells = reusable(cells)
    fits = F.col("nz").cast("long") * F.col("ny") * F.col("nx") <= opt.dense_block ** 2
    sizes = settle(extents(cells).withColumn("_whole", fits & (F.col("nz") == 1) if planes else fits))
    kinds = {r[0] for r in sizes.select("_whole").distinct().collect()}
    results = []
    if False in kinds:
        results.append(columns(attach(cells, sizes.filter("NOT _whole").select("img"), ["img"])))
    if True in kinds:
        one = sizes.filter("_whole").select("img", F.col("ny").alias("h"), F.col("nx").alias("w"), F.lit(1).alias("ny"), F.lit(1).alias("nx"))
        plain = {f.name: getattr(opt, f.name) for f in fields(opt) if f.init}
        whole = attach(cells, one.select("img"), ["img"])
        results.append(tiled.restore_tiled(whole, tiled.kernel_block(taps), one, **method, **{**plain, "convergence": "none"}))
    if not results:
        return columns(cells)
    every = lambda part: reduce(DataFrame.unionByName, part)
    return Restored(every([r.cells.select(*CELL, "v") for r in results]), None, every([r.used.select(*KEYS, "iterations") for r in results]))


def richardson_lucy_tv(
    cells: DataFrame,
    taps: Sequence[Tap],
    tv_lambda: float = 1e-4,
    pixel_xy: float | None = None,
    pixel_z: float | None = None,
    sign: str = "reference",
    **options,
) -> Restored:
    """The same loop with a total-variation factor after every update."""
    if tv_lambda <= 0:
        return richardson_lucy(cells, taps, **options)
    opt = Options(**{**options, "engine": "columns"})
    scales = axis_scales(pixel_xy, pixel_z)

    def columns(some: DataFrame) -> Restored:
        state, groups = prepare_work(some, taps, opt)
        return run(state, taps, opt, tv_step(tv_lambda, scales, sign, groups))

    if sign != "reference":
        return columns(cells)
    return whole_images(cells, taps, Options(**options), columns, tv_lambda=tv_lambda, z_scale=scales["z"])


def sparse_hessian_deconvolve(
    cells: DataFrame,
    taps: Sequence[Tap],
    weight: float = 0.6,
    reg: float = 0.98,
    pixel_xy: float | None = None,
    pixel_z: float | None = None,
    volume: bool = True,
    **options,
) -> Restored:
    """Alternating data and sparse-Hessian steps with a scaled objective."""
    opt = Options(**{**options, "engine": "columns"})
    weight, reg = min(max(weight, 0.0), 1.0), min(max(reg, 0.0), 1.0)
    z_scale = axis_scales(pixel_xy, pixel_z)["z"]
    if not opt.track:
        by_columns = lambda some: _sparse_columns(some, taps, opt, weight, reg, z_scale, volume)
        return whole_images(cells, taps, Options(**options), by_columns, not volume, sparse=(weight, reg), z_scale=z_scale)
    return _sparse_columns(cells, taps, opt, weight, reg, z_scale, volume)


def _sparse_columns(
    cells: DataFrame, taps: Sequence[Tap], opt: Options, weight: float, reg: float, z_scale: float, volume: bool
) -> Restored:
    state = prepare(cells, taps, opt)
    state = state.withColumns({n: F.greatest(n, "bg") for n in ("xp", "xc")})

    def losses(st: DataFrame) -> DataFrame:
        data = forward_pairs(st, taps, opt).groupBy(*KEYS).agg(F.avg(nll_of(F.col("d"), F.col("e"))).alias("data"))
        image = st.filter(F.col("d").isNotNull()).select(*CELL, F.col("xc").alias("v"))
        return data.join(sparse_hessian_penalty(image, weight, z_scale, volume), KEYS)

    first: DataFrame | None = None
    if opt.track:
        state = settle(state)
        first = settle(losses(state).select(
            *KEYS, F.greatest("data", F.lit(1e-6)).alias("_d0"), F.greatest("penalty", F.lit(1e-6)).alias("_p0")))

    def objective(st: DataFrame, taps_: Sequence[Tap], opt_: Options) -> DataFrame:
        total = reg * F.col("data") / F.col("_d0") + (1 - reg) * F.col("penalty") / F.col("_p0")
        return losses(st).join(first, KEYS).select(*KEYS, total.alias("metric"))

    return run(state, taps, opt, sparse_step(weight, reg, z_scale, volume), objective)


def converged_at(history: DataFrame, niter: int, rel_threshold: float = 0.005) -> DataFrame:
    """First check at which each image meets the stop rule, else ``niter``."""
    before = F.lag("metric").over(Window.partitionBy(*KEYS).orderBy("iter"))
    h = history.withColumn("_b", before)
    hit = (F.col("_b") > 0) & ((F.col("_b") - F.col("metric")) / F.col("_b") < rel_threshold) & (
        F.col("iter") > max(10, niter // 4))
    return h.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(hit, F.col("iter"))), F.lit(niter)).cast("long").alias("iterations"))


# Preset -> damping strength, offset, background factor.
PRESETS = {
    "very conservative": (2.5, 3.0, 1.2),
    "conservative": (2.0, 2.5, 1.1),
    "balanced": (1.5, 2.0, 1.0),
    "strong": (1.0, 1.5, 0.9),
    "very strong": (0.75, 1.0, 0.8),
}


def preset_background(cells: DataFrame, radius: int, factor: float) -> DataFrame:
    """Lower of the local and the global background, scaled, per image."""
    cells = reusable(cells)
    local = local_background(cells, radius).withColumnRenamed("background", "_l")
    both = background_level(cells).join(local, KEYS)
    return both.select(*KEYS, F.greatest(F.least("background", "_l") * factor, F.lit(1e-6)).alias("background"))


def restore_2d_preset(
    cells: DataFrame,
    kernel3d: DataFrame,
    preset: str = "balanced",
    radius: int = 5,
    bg_scale: float = 1.0,
    tv_lambda: float = 0.0,
    **options,
) -> Restored:
    """Single-plane images with a kernel collapsed from a 3-D one."""
    if tv_lambda <= 0:
        from sparkgrid.plans.routing import restore_planes  # that module builds on this one
        kn.single(kernel3d)
        return restore_planes(cells, kernel3d.drop("kid"), (), preset, radius, bg_scale, **options)
    preset = preset.strip().lower()
    damping, offset, factor = PRESETS.get(preset, PRESETS["balanced"])
    flat = kn.kernel_collapse_z(kn.kernel_crop_support(kernel3d), preset)
    opts = dict(options)
    if opts.get("damping", "auto") == "auto":
        opts["damping"] = damping
    if opts.get("offset", "auto") == "auto":
        opts["offset"] = offset
    if opts.get("background", "auto") == "auto":
        opts["background"] = settle(preset_background(cells, radius, factor * max(bg_scale, 0.1)))
    return richardson_lucy_tv(cells, kn.taps_of(flat), tv_lambda, **opts)
