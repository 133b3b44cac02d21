"""Restoration with a kernel and settings of its own per image, time point or channel.

Kernels are a table.  Each is packed once and sent to the blocks of its
images, where a co-grouped task blurs the block and its halo by one Fourier
transform, so kernels of any size run and no kernel passes through the driver.
Images that are finished leave the working set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, CELL, KEYS, attach, beside, discard, fdiv, grid, reusable, settle, spread, write_aside
from sparkgrid.operators.rank import background_level, noise_sigma
from sparkgrid.operators.stats import divergence_of
from sparkgrid.operators.stencil import anscombe_prefilter, gaussian_smooth
from sparkgrid.plans import fourier
from sparkgrid.plans.restore import Options, Restored, momentum_weight

# executors need NumPy but not this package
cloudpickle.register_pickle_by_value(fourier)

#: bytes of one packed kernel (32 MB); a kernel is sent to every block of its images
MAX_KERNEL_BYTES = 32 << 20
#: what a ``params`` table may set per group, with the type it is read as
PARAMS = {"niter": "int", "background": "double", "offset": "double", "damping": "double", "rel_threshold": "double"}
REACH = [f"{end}{a}" for a in AXES for end in ("lo", "hi")]


def pack_kernels(kernels: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per group ``on``: the kernel as packed doubles, its shape and its reach.

    A kernel longer than its image on some axis (``nz, ny, nx``, which must be
    columns of ``kernels``) is cropped around its middle; weights sum to one.
    """
    limit, pack = MAX_KERNEL_BYTES, fourier.pack

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        block, low = pack(pdf["dz"].to_numpy(), pdf["dy"].to_numpy(), pdf["dx"].to_numpy(), pdf["w"].to_numpy(), [int(first[n]) for n in ("nz", "ny", "nx")])
        if block.nbytes > limit:
            raise ValueError(f"a kernel takes {block.nbytes} bytes, more than {limit}")
        row = {k: first[k] for k in on} | {"kernel": block.tobytes()}
        for a, n, lo in zip(("z", "y", "x"), block.shape, low):
            row |= {f"lo{a}": int(lo), f"hi{a}": int(lo) + n - 1}
        return pd.DataFrame([row])

    types = {f.name: f.dataType.simpleString() for f in kernels.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in on), "kernel binary", *(f"{c} int" for c in REACH)])
    return kernels.groupBy(*on).applyInPandas(packed, schema)


def settings(cells: DataFrame, kernels: DataFrame, on: list[str], params: DataFrame | None, opt: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prepared image, one settled row per image with all that it runs with, and the packed kernels by image.

    Null parameters, and groups that ``params`` does not name, take the
    defaults.  An image without a kernel, or a group with several rows of
    parameters, is an error.
    """
    base = reusable(cells.select(*CELL, "v"))
    groups = base.groupBy(*KEYS).agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in AXES])
    default = {
        "niter": opt.niter, "background": None if opt.background == "auto" or isinstance(opt.background, DataFrame) else float(opt.background),
        "offset": opt.offset_value, "damping": opt.damp_strength, "rel_threshold": opt.rel_threshold,
    }
    if params is not None:
        given = [c for c in PARAMS if c in params.columns]
        own = params.groupBy(*on).agg(F.count("*").alias("_rows"), *[F.first(c).cast(PARAMS[c]).alias(f"_{c}") for c in given])
        own = own.withColumn("_rows", F.when(F.col("_rows") == 1, 1).otherwise(F.raise_error(F.lit("several rows of parameters for one group"))))
        groups = groups.join(own.filter("_rows = 1").drop("_rows"), on, "left")
    else:
        given = []
    chosen = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(default[c])) if c in given else F.lit(default[c])
    groups = groups.select(*KEYS, "nz", "ny", "nx", *[chosen(c).cast(t).alias(c) for c, t in PARAMS.items()])
    level = opt.background if isinstance(opt.background, DataFrame) else background_level(base)
    groups = groups.join(level.select(*KEYS, F.col("background").alias("_auto")), KEYS, "left")
    groups = groups.withColumn("bg", F.greatest(F.coalesce("background", "_auto"), F.lit(1e-6)) + F.col("offset")).drop("background", "_auto")
    groups = settle(groups)
    image = attach(base, groups.select(*KEYS, "offset"), KEYS, settled=True).select(*CELL, (F.col("v") + F.col("offset")).alias("v"))
    if opt.prefilter_sigma > 0:
        image = settle(anscombe_prefilter(image, opt.prefilter_sigma, opt.smooth_axes))
    groups = groups.join(image.groupBy(*KEYS).agg(F.avg("v").alias("mean")), KEYS)
    if "damping" in given or opt.damp_strength > 0:
        groups = groups.join(noise_sigma(image), KEYS)
    else:
        groups = groups.withColumn("sigma", F.lit(0.0))

    sizes = groups.select(*KEYS, "nz", "ny", "nx")
    if "kid" in kernels.columns and "kid" not in on:
        several = F.count_distinct("kid").alias("_n")
        one = kernels.groupBy(*on).agg(several) if on else kernels.agg(several)
        if not one.filter("_n > 1").isEmpty():
            raise ValueError("several kernels for one group: name it in `on` or choose one by kid")
    by = [*on, "nz", "ny", "nx"]
    wanted = sizes.select(*by).distinct()  # a kernel is packed once for all images of a size
    if on:
        fitted = wanted.join(kernels.select(*on, "dz", "dy", "dx", "w"), on)
    else:
        fitted = kernels.select("dz", "dy", "dx", "w", F.lit(0).alias("_one")).join(wanted.withColumn("_one", F.lit(0)), "_one").drop("_one")
    packed = settle(pack_kernels(fitted, by))
    groups = attach(groups, packed.drop("kernel"), by, "left")
    missing = F.raise_error(F.concat(F.lit("no kernel for image "), F.concat_ws("/", *KEYS)))
    groups = settle(groups.withColumn("loz", F.when(F.col("loz").isNotNull(), F.col("loz")).otherwise(missing)))
    return image, groups, packed


def halo(a: str, steps: int) -> Column:
    """Rim that ``steps`` updates and a last blur reach from, in columns ``lo, hi``."""
    lo, hi = F.col(f"lo{a}"), F.col(f"hi{a}")
    return (steps * (hi - lo) + F.greatest(-lo, hi, F.lit(0))).cast("int")


def block_side(a: str, most: int) -> tuple[Column, Column]:
    """Side of the blocks of an image on one axis and the number of the last one.

    The work box is cut from its own edge into as many equal blocks as come
    nearest to ``most`` cells a side (at most half as long again), so that an
    image about as large as a block is one.
    """
    size = F.col(f"n{a}") + F.col(f"hi{a}") - F.col(f"lo{a}")
    side = F.ceil(size / F.greatest(F.round(size / most), F.lit(1))).cast("int")
    return side, (F.ceil(size / side) - 1).cast("int")


def keyed_steps(state: DataFrame, blocks: DataFrame, first: int, last: int, opt: Options) -> DataFrame:
    """Updates ``first``..``last`` of all active images with one exchange of rims."""
    momentum = [momentum_weight(i) for i in range(first, last + 1)]
    advance = fourier.advance
    names = [*CELL, "d", "xp", "xc", "est"]

    def block(cells: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        job = of.iloc[0]
        at = tuple(cells[a].to_numpy() for a in ("z", "y", "x"))
        own = ((at[1] + job["hiy"]) // job["sidey"] == job["hby"]) & ((at[2] + job["hix"]) // job["sidex"] == job["hbx"])
        low = [int(job[f"lo{a}"]) for a in ("z", "y", "x")]
        kernel = np.frombuffer(job["kernel"]).reshape([int(job[f"hi{a}"]) - lo + 1 for a, lo in zip(("z", "y", "x"), low)])
        xp, xc, est = advance(at, cells["d"].to_numpy(dtype="float64"), cells["xp"].to_numpy(), cells["xc"].to_numpy(),
                              float(job["bg"]), float(job["sigma"]), kernel, low, momentum, float(job["damping"]))
        out = cells.loc[own, ["img", "t", "c", "z", "y", "x", "d"]].astype({"img": object})
        out["xp"], out["xc"], out["est"] = xp[own], xc[own], est[own]
        return out

    within = lambda a, by: F.floor((F.col(a) + F.col(f"origin{a}") + by * F.col(f"h{a}")) / F.col(f"side{a}")).cast("int")
    near = lambda a: F.explode(F.sequence(F.greatest(within(a, -1), F.lit(0)), F.least(within(a, 1), F.col(f"last{a}"))))
    parts = state.withColumn("hby", near("y")).withColumn("hbx", near("x")).select(*CELL, "d", "xp", "xc", "hby", "hbx")
    types = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = ", ".join(f"{n} {types.get(n, 'double')}" for n in names)
    on = [*KEYS, "hby", "hbx"]
    return parts.groupBy(*on).cogroup(blocks.groupBy(*on)).applyInPandas(block, schema)


def restore_each(
    cells: DataFrame, kernels: DataFrame, on: Sequence[str] = ("c",), params: DataFrame | None = None, **options
) -> Restored:
    """Momentum-accelerated deblurring with one kernel and one set of parameters per group.

    ``kernels`` has columns ``on, dz, dy, dx, w`` (``on`` may be empty: one
    kernel for all); ``params`` has ``on`` and any of ``PARAMS``.  Every image
    runs to its own ``niter`` or stops on its own; finished images are read no
    more.  A task holds a block of ``dense_block`` cells a side with its rim,
    whatever the size of the image.
    """
    opt = Options(**options)
    spark, on = cells.sparkSession, list(on)
    image, groups, packed = settings(cells, kernels, on, params, opt)
    state = start(image, groups, opt)
    by = [*on, "nz", "ny", "nx"]
    B = opt.dense_block
    (sidey, lasty), (sidex, lastx) = (block_side(a, B) for a in ("y", "x"))
    sides = [sidey.alias("sidey"), sidex.alias("sidex")]
    blocks = groups.select("*", *sides).withColumn("hby", F.explode(F.sequence(F.lit(0), lasty)))
    blocks = blocks.withColumn("hbx", F.explode(F.sequence(F.lit(0), lastx)))
    blocks = settle(attach(blocks, packed.select(*by, "kernel"), by).select(
        *KEYS, "hby", "hbx", "sidey", "sidex", "bg", "sigma", "damping", *REACH, "kernel"))
    reach = groups.agg(F.max(F.greatest(F.col("hiy") - F.col("loy"), F.col("hix") - F.col("lox")))).first()[0] or 0
    most = max(1, B // max(2 * reach, 1))  # updates an exchange: the rim stays near the block's size
    ends = sorted({r[0] for r in groups.select("niter").distinct().collect()})
    last = ends[-1] if ends else 0
    stops = sorted({k for k in range(opt.check_every, last + 1, opt.check_every)} | set(ends))
    active, finished, checks, before, k, old = groups, [], [], None, 0, None
    for stop in stops:
        while k < stop:
            until = min(stop, k + most)
            rims = active.select(*KEYS, *sides, *[c for a, n in (("y", lasty), ("x", lastx)) for c in (
                halo(a, until - k).alias(f"h{a}"), F.col(f"hi{a}").alias(f"origin{a}"), n.alias(f"last{a}"))])
            running = attach(blocks, active.select(*KEYS), KEYS)
            moved = keyed_steps(attach(state, rims, KEYS), running, k + 1, until, opt)
            state, path = write_aside(moved)
            if old:
                discard(spark, old)
            k, old = until, path
        term = divergence_of(F.col("d"), F.greatest("est", "bg"))
        seen = attach(state.filter(F.col("d").isNotNull()), groups.select(*KEYS, "bg"), KEYS)
        now = seen.groupBy(*KEYS).agg(F.avg(term).alias("metric"))
        now = settle(now.join(active.select(*KEYS, "niter", "rel_threshold"), KEYS).withColumn("iter", F.lit(k)))
        at_check = (F.lit(k % opt.check_every == 0) | (F.col("niter") == k)) & F.lit(opt.track)
        checks.append(now.filter(at_check).select(*KEYS, "iter", "metric"))
        ended = F.col("niter") <= k
        if opt.convergence == "auto" and before is not None and opt.track:
            now = now.join(before, KEYS, "left")
            slow = (F.col("_before") > 0) & ((F.col("_before") - F.col("metric")) / F.col("_before") < F.col("rel_threshold"))
            ended = ended | (at_check & slow & (F.lit(k) > F.greatest(F.lit(10), F.floor(F.col("niter") / 4))))
        done = settle(now.filter(F.coalesce(ended, F.lit(False))).select(*KEYS, F.lit(k).alias("iterations")))
        if k % opt.check_every == 0:
            before = checks[-1].select(*KEYS, F.col("metric").alias("_before"))
        if not done.isEmpty():  # the table stays for the finished images, the others move on
            finished.append((state, done))
            active = settle(active.join(done.select(*KEYS), KEYS, "left_anti"))
            state = attach(state, active.select(*KEYS), KEYS, settled=False)
            old = None
            if active.isEmpty():
                break
    shift = F.greatest(F.col("xc") - F.col("offset"), F.lit(0.0))
    plain = F.when(F.col("offset") > 0, shift).otherwise(F.col("xc")).alias("v")
    results = []
    for table, done in finished:
        own = done.join(groups.select(*KEYS, "offset"), KEYS)
        results.append(attach(table.filter(F.col("d").isNotNull()), own, KEYS).select(*CELL, plain))
    out = reduce(DataFrame.unionByName, results) if results else cells.select(*CELL, "v").limit(0)
    used = reduce(DataFrame.unionByName, [d for _, d in finished]) if finished else None
    history = reduce(DataFrame.unionByName, checks) if opt.track and checks else None
    return Restored(out, history, used)


def start(image: DataFrame, groups: DataFrame, opt: Options) -> DataFrame:
    """Work box of every image, dilated by its own kernel, with observation and start values."""
    ranges = {a: (-F.col(f"hi{a}"), F.col(f"n{a}") - 1 - F.col(f"lo{a}")) for a in AXES}
    box = grid(groups, ranges, opt.block)
    seen = image.select(*CELL, F.col("v").alias("d"), fdiv("y", opt.block).alias("by"), fdiv("x", opt.block).alias("bx"))
    if opt.start == "lowpass":
        seen = beside(seen, gaussian_smooth(image, 8.0, opt.smooth_axes).withColumnRenamed("v", "low"), CELL)
    state = beside(box, spread(seen, *KEYS, "by", "bx"), [*KEYS, "by", "bx", *AXES], "left")
    x0: dict[str, Callable[[], Column]] = {
        "flat": lambda: F.greatest("mean", "bg"),
        "observed": lambda: F.coalesce("d", "bg"),
        "lowpass": lambda: F.greatest(F.coalesce(F.col("low"), F.col("bg")), F.col("bg")),
    }
    value = x0[opt.start]()
    return settle(state.select(*CELL, "d", value.alias("xp"), value.alias("xc"), F.lit(None).cast("double").alias("est")))
