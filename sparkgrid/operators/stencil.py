"""Gradients, total-variation factor, Hessian penalty and smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, BLOCK, CELL, KEYS, attach, extents, reusable, settle
from sparkgrid.functions.scalar import anscombe, clip, inverse_anscombe
from sparkgrid.operators.neighbors import scatter, stencil
from sparkgrid.operators.rank import background_level

UNIT = {"z": (1, 0, 0), "y": (0, 1, 0), "x": (0, 0, 1)}


def _plus(*terms: tuple[int, tuple[int, int, int]]) -> tuple[int, int, int]:
    return tuple(sum(s * u[i] for s, u in terms) for i in range(3))


def edge_strength(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean gradient norm: central differences, one-sided at the ends.

    Axes of length one drop out by themselves: they have no neighbours.
    """
    taps = {f"{s}{a}": _plus((k, UNIT[a])) for a in AXES for s, k in (("m", -1), ("p", 1))}
    near = stencil(cells, taps, keys)
    total = F.lit(0.0)
    for a in AXES:
        m, p = F.col(f"m{a}"), F.col(f"p{a}")
        g = F.coalesce((p - m) / 2.0, p - F.col("v"), F.col("v") - m, F.lit(0.0))
        total = total + g * g
    return near.groupBy(*keys).agg(F.avg(F.sqrt(total)).alias("edge_strength"))


def axis_scales(pixel_xy: float | None = None, pixel_z: float | None = None) -> dict[str, float]:
    """Relative derivative scale per axis for anisotropic voxels."""
    xy = max(float(pixel_xy), 1e-12) if pixel_xy is not None else 1.0
    z = max(float(pixel_z), 1e-12) if pixel_z is not None else xy
    return {"z": xy / z, "y": 1.0, "x": 1.0}


def axis_diff(cells: DataFrame, axis: str, scale: float = 1.0) -> DataFrame:
    """Backward difference along one axis, 0 for the first cell."""
    near = stencil(cells, {"prev": _plus((-1, UNIT[axis]))})
    return near.select(*CELL, F.coalesce((F.col("v") - F.col("prev")) * scale, F.lit(0.0)).alias("v"))


def tv_factor(
    cells: DataFrame,
    lam: float,
    scales: dict[str, float] | None = None,
    sign: str = "reference",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Multiplicative total-variation factor per cell, from one neighbour exchange.

    ``sign='reference'`` keeps the published code's orientation of the
    divergence; ``'smoothing'`` is the textbook one that lowers peaks.
    """
    scales = scales or axis_scales()
    taps: dict[str, tuple[int, int, int]] = {}
    for a in AXES:
        taps[f"m{a}"] = _plus((-1, UNIT[a]))
        taps[f"p{a}"] = UNIT[a]
        for b in AXES:
            if b != a:
                taps[f"q{a}{b}"] = _plus((1, UNIT[a]), (-1, UNIT[b]))
    near = stencil(cells, taps, carry=carry)
    diff = lambda hi, lo, a: F.coalesce((hi - lo) * scales[a], F.lit(0.0))
    norm = lambda gs: F.sqrt(sum((g * g for g in gs), F.lit(0.0)) + 1e-8)
    here = {a: diff(F.col("v"), F.col(f"m{a}"), a) for a in AXES}
    div = F.lit(0.0)
    for a in AXES:
        nxt = {b: diff(F.col(f"p{a}"), F.col("v") if b == a else F.col(f"q{a}{b}"), b) for b in AXES}
        step = (F.col(f"g{a}") / F.col("_n") - nxt[a] / norm(nxt.values())) * scales[a]
        div = div + F.when(F.col(f"p{a}").isNotNull(), step).otherwise(F.lit(0.0))
    if sign == "smoothing":
        div = -div
    elif sign != "reference":
        raise ValueError(f"unknown sign {sign!r}")
    near = near.withColumns({f"g{a}": here[a] for a in AXES}).withColumn("_n", norm([F.col(f"g{a}") for a in AXES]))
    return near.select(*CELL, *carry, "v", clip(1.0 / (1.0 - lam * div), 0.1, 10.0).alias("factor"))


#: neighbours of the second-derivative stencil, by name
HESSIAN_TAPS = {
    "pz": (1, 0, 0), "mz": (-1, 0, 0), "py": (0, 1, 0), "my": (0, -1, 0), "px": (0, 0, 1), "mx": (0, 0, -1),
    "pyx": (0, 1, 1), "pzx": (1, 0, 1), "pzy": (1, 1, 0),
}


def hessian(cells: DataFrame, z_scale: float = 1.0, volume: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Second differences on interior cells: dxx, dyy, dzz, dxy, dxz, dyz.

    Single-plane images have no z neighbours and get zero z terms.  With
    ``volume=False`` the z taps are not exchanged at all.
    """
    taps = {n: o for n, o in HESSIAN_TAPS.items() if volume or o[0] == 0}
    near = stencil(cells, taps, carry=carry)
    c = F.col("v")
    second = lambda a: 2.0 * c - F.col(f"p{a}") - F.col(f"m{a}")
    mixed = lambda ab, a, b: F.col(ab) - F.col(f"p{a}") - F.col(f"p{b}") + c
    inside = F.col("py").isNotNull() & F.col("my").isNotNull() & F.col("px").isNotNull() & F.col("mx").isNotNull()
    zero = F.lit(0.0)
    if volume:
        up, down = F.col("pz").isNotNull(), F.col("mz").isNotNull()
        inside = inside & (up == down)
        z = lambda e: F.when(up, e).otherwise(zero)
        zz, xz, yz = (z(second("z") * z_scale * z_scale), z(mixed("pzx", "z", "x") * z_scale),
                      z(mixed("pzy", "z", "y") * z_scale))
    else:
        zz = xz = yz = zero
    return near.filter(inside).select(
        *CELL, *carry, "v", second("x").alias("dxx"), second("y").alias("dyy"), zz.alias("dzz"),
        mixed("pyx", "y", "x").alias("dxy"), xz.alias("dxz"), yz.alias("dyz"))


def penalty_term(w: float) -> Column:
    """Square root inside the sparse-Hessian penalty, over Hessian columns."""
    sq = lambda n: F.col(n) * F.col(n)
    hess = sq("dxx") + sq("dyy") + sq("dzz") + 2.0 * (sq("dxy") + sq("dxz") + sq("dyz"))
    return F.sqrt(w * w * hess + (1 - w) * (1 - w) * sq("v") + 1e-8)


def squeezed(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """Stacks with a single row or column as single planes; ``dims`` has ``_nz, _ny, _nx``, which are kept."""
    deep = F.col("_nz") > 1
    row, column = deep & (F.col("_ny") == 1), deep & (F.col("_ny") > 1) & (F.col("_nx") == 1)
    rest = [c for c in cells.columns if c not in AXES]
    return attach(cells, dims, KEYS, settled=True).select(
        *rest, F.when(row | column, F.lit(0)).otherwise(F.col("z")).alias("z"),
        F.when(row | column, F.col("z")).otherwise(F.col("y")).alias("y"),
        F.when(column, F.col("y")).otherwise(F.col("x")).alias("x"), "_nz", "_ny", "_nx")


def unsqueezed(cells: DataFrame, dims: DataFrame) -> DataFrame:
    """The inverse of :func:`squeezed`."""
    deep = F.col("_nz") > 1
    row, column = deep & (F.col("_ny") == 1), deep & (F.col("_ny") > 1) & (F.col("_nx") == 1)
    rest = [c for c in cells.columns if c not in AXES]
    return attach(cells, dims, KEYS, settled=True).select(
        *rest, F.when(row | column, F.col("y")).otherwise(F.col("z")).alias("z"),
        F.when(row, F.lit(0)).when(column, F.col("x")).otherwise(F.col("y")).alias("y"),
        F.when(column, F.lit(0)).otherwise(F.col("x")).alias("x"))


def sizes_of(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS).agg(*[(F.max(a) + 1).cast("int").alias(f"_n{a}") for a in AXES])


def flat_stacks(dims: DataFrame) -> bool:
    """Whether any stack has a single row or column."""
    return not dims.filter((F.col("_nz") > 1) & (F.least("_ny", "_nx") == 1)).isEmpty()


def sparse_hessian_penalty(
    cells: DataFrame, w: float = 0.6, z_scale: float = 1.0, volume: bool = True, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean penalty per image; 0 where no side has an interior.

    An axis of length one is left out, whichever it is.
    """
    w = min(max(w, 0.0), 1.0)
    if volume and all(k in cells.columns for k in KEYS):
        dims = settle(sizes_of(cells))
        if flat_stacks(dims):
            cells = squeezed(cells, dims).drop("_nz", "_ny", "_nx")
    inner = hessian(cells, z_scale, volume).groupBy(*keys).agg(F.avg(penalty_term(w)).alias("_p"))
    return attach(cells.select(*keys).distinct(), inner, list(keys), "left").select(
        *keys, F.coalesce("_p", F.lit(0.0)).alias("penalty"))


def sparse_hessian_gradient(
    cells: DataFrame, w: float = 0.6, z_scale: float = 1.0, volume: bool = True
) -> DataFrame:
    """Closed-form gradient of the penalty for every cell (column ``g``).

    Each interior cell sends its share to the cells of its stencil.  Cells
    without an interior neighbour get 0 and are kept.  An axis of length one is
    left out, whichever it is.
    """
    w = min(max(w, 0.0), 1.0)
    if volume:
        whole = settle(sizes_of(cells))
        if flat_stacks(whole):
            planes = squeezed(cells, whole).drop("_nz", "_ny", "_nx")
            return unsqueezed(sparse_hessian_gradient(settle(planes), w, z_scale, True), whole).select(*CELL, "g")
    dims = cells.groupBy(*KEYS).agg(*[(F.max(a) + 1).alias(f"_n{a}") for a in AXES])
    inner = F.when(F.col("_nz") == 1, F.lit(1)).otherwise(F.col("_nz") - 2) * (F.col("_ny") - 2) * (F.col("_nx") - 2)
    h = attach(hessian(cells, z_scale, volume), dims.select(*KEYS, inner.alias("_count")), KEYS)
    base = w * w / (penalty_term(w) * F.col("_count"))
    parts = {
        "_xx": F.col("dxx") * base, "_yy": F.col("dyy") * base, "_zz": F.col("dzz") * base * z_scale * z_scale,
        "_xy": F.col("dxy") * base * 2, "_xz": F.col("dxz") * base * 2 * z_scale, "_yz": F.col("dyz") * base * 2 * z_scale,
        "_self": F.col("v") * (1 - w) * (1 - w) / (penalty_term(w) * F.col("_count")),
    }
    xx, yy, zz, xy, xz, yz, own = (F.col(k) for k in parts)
    give = {
        (0, 0, 0): 2 * xx + 2 * yy + 2 * zz + xy + xz + yz + own,
        (0, 0, 1): -xx - xy - xz, (0, 0, -1): -xx, (0, 1, 0): -yy - xy - yz, (0, -1, 0): -yy, (0, 1, 1): xy,
    }
    if volume:
        give |= {(1, 0, 0): -zz - xz - yz, (-1, 0, 0): -zz, (1, 0, 1): xz, (1, 1, 0): yz}
    sent = h.select(*CELL, *[e.alias(k) for k, e in parts.items()]).select(
        *CELL, F.array(*give.values()).alias("give"), F.lit(0).alias("own"))
    # every cell also sends a marker to itself, so the result covers the image
    marks = cells.select(*CELL, F.lit(None).cast("array<double>").alias("give"), F.lit(1).alias("own"))
    val = F.coalesce(F.col("give")[F.col("tap.k")], F.lit(0.0))
    mark = F.max(F.when(F.col("tap.k") == 0, F.col("own")).otherwise(F.lit(0)))
    out = scatter(sent.unionByName(marks), [(*o, 1.0) for o in give], [F.sum(val).alias("g"), mark.alias("own")])
    return out.filter(F.col("own") == 1).drop("own")


def gaussian_weights(sigma: float) -> list[float]:
    r = max(math.ceil(3.0 * sigma), 1)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def reflect_filter(cells: DataFrame, axis: str, weights: Sequence[float], block: int = BLOCK) -> DataFrame:
    """Symmetric 1-D filter with mirrored borders (edge cell not repeated).

    Cells within reach of a border also act from their mirrored position.
    ``n{axis}`` must be present; axes of length one are left unchanged.
    """
    r = len(weights) // 2
    n = F.col(f"n{axis}")
    pos = F.col(axis)
    far = 2 * (n - 1) - pos
    too_short = F.raise_error(F.lit(f"axis {axis} is shorter than the filter radius {r}")).cast("array<int>")
    copies = F.array_compact(F.array(
        pos, F.when((pos >= 1) & (pos <= r), -pos), F.when((pos <= n - 2) & (pos >= n - 1 - r), far)))
    places = F.when(n == 1, F.array(pos)).when(n <= r, too_short).otherwise(copies)
    src = cells.withColumn(axis, F.explode(places))
    u = UNIT[axis]
    taps = [tuple(k * (i - r) for k in u) + (wt,) for i, wt in enumerate(weights)]
    # a single-plane axis receives only its own value with full weight
    wt = F.when(n == 1, F.when(F.col("tap.k") == r, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.col("tap.w"))
    dims = [c for c in ("nz", "ny", "nx") if c in cells.columns]
    out = scatter(src, taps, [F.sum(F.col("v") * wt).alias("v")], carry=dims)
    return out.filter((F.col(axis) >= 0) & (F.col(axis) < n))


def gaussian_smooth(
    cells: DataFrame, sigma: float, axes: Sequence[str] = ("z", "y", "x"), dims: DataFrame | None = None
) -> DataFrame:
    """Separable Gaussian: one exchange per axis instead of one wide kernel.

    Channels may differ in size; an axis of length one is left as it is.
    """
    if sigma <= 0:
        return cells.select(*CELL, "v")
    dims = settle(extents(cells, KEYS) if dims is None else dims)
    longest = dims.agg(*[F.max(f"n{a}").alias(a) for a in axes]).first()
    out = attach(cells.select(*CELL, "v"), dims, [k for k in KEYS if k in dims.columns], settled=True)
    for a in (a for a in axes if (longest[a] or 0) > 1):  # no exchange along an axis that no image has
        out = reflect_filter(out, a, gaussian_weights(sigma))
    return out.select(*CELL, "v")


def box_mean(cells: DataFrame, radius: int, dims: DataFrame | None = None) -> DataFrame:
    """Mean over a (2r+1)^2 window with mirrored borders, as two 1-D passes."""
    dims = extents(cells, KEYS) if dims is None else dims
    out = attach(cells.select(*CELL, "v"), dims, [k for k in KEYS if k in dims.columns])
    for a in ("y", "x"):
        out = reflect_filter(out, a, [1.0 / (2 * radius + 1)] * (2 * radius + 1))
    return out.select(*CELL, "v")


def local_background(cells: DataFrame, radius: int, frac: float = 0.01) -> DataFrame:
    """Level of the darkest neighbourhoods."""
    return background_level(reusable(box_mean(cells, radius)), frac)


def anscombe_prefilter(cells: DataFrame, sigma: float, axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Smooth in the variance-stabilised domain."""
    up = cells.withColumn("v", anscombe(F.col("v")))
    return gaussian_smooth(up, sigma, axes).withColumn("v", inverse_anscombe(F.col("v")))
