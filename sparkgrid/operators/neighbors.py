"""One-shuffle neighbourhood exchange.

Cells are sent once to every (y, x) block their contribution can reach, which
is their own block except near its rim.  The contributions are then expanded
and summed inside the block: the grouping keys start with the block key the
rows are already partitioned by, so no second shuffle takes place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.core import AXES, BLOCK, KEYS, fdiv, spread

Tap = tuple[int, int, int, float]


def tap_array(taps: Sequence[Tap]) -> Column:
    """Taps as one literal array of structs ``(k, dz, dy, dx, w)``."""
    return F.array(*[
        F.struct(
            F.lit(k).alias("k"), F.lit(int(dz)).alias("dz"), F.lit(int(dy)).alias("dy"),
            F.lit(int(dx)).alias("dx"), F.lit(float(w)).alias("w"),
        )
        for k, (dz, dy, dx, w) in enumerate(taps)
    ])


def reach(taps: Sequence[Tap], axis: int) -> tuple[int, int]:
    """Lowest and highest offset of the taps along one axis (0=z, 1=y, 2=x)."""
    offs = [t[axis] for t in taps]
    return min(offs), max(offs)


def route(
    cells: DataFrame,
    y_reach: tuple[int, int],
    x_reach: tuple[int, int],
    keys: Sequence[str] = KEYS,
    block: int = BLOCK,
) -> DataFrame:
    """Copy each cell to the blocks ``(hby, hbx)`` within its reach and co-locate."""
    span = lambda a, lo, hi: F.explode(F.sequence(
        fdiv(F.col(a) + F.lit(lo), block), fdiv(F.col(a) + F.lit(hi), block)))
    copies = cells.withColumn("hby", span("y", *y_reach)).withColumn("hbx", span("x", *x_reach))
    return spread(copies, *keys, "hby", "hbx")


def scatter(
    cells: DataFrame,
    taps: Sequence[Tap],
    aggs: Sequence[Column],
    keys: Sequence[str] = KEYS,
    block: int = BLOCK,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Send every cell to ``coord + offset`` for all taps and aggregate arrivals.

    ``aggs`` may use the cell's own columns plus ``tap.k`` and ``tap.w``.
    """
    routed = route(cells, reach(taps, 1), reach(taps, 2), keys, block)
    hit = routed.withColumn("tap", F.explode(tap_array(taps)))
    moved = hit.select(
        *[c for c in hit.columns if c not in AXES],
        *[(F.col(a) + F.col(f"tap.d{a}")).cast("int").alias(a) for a in AXES],
    ).filter((fdiv("y", block) == F.col("hby")) & (fdiv("x", block) == F.col("hbx")))
    return moved.groupBy(*keys, "hby", "hbx", *AXES, *carry).agg(*aggs).drop("hby", "hbx")


def stencil(
    cells: DataFrame,
    offsets: dict[str, tuple[int, int, int]],
    keys: Sequence[str] = KEYS,
    block: int = BLOCK,
    value: str = "v",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Neighbour values at fixed offsets as columns; null where no cell exists.

    The cell itself is always returned as ``v``; only existing cells are kept.
    """
    named = dict(offsets)
    named.setdefault(value, (0, 0, 0))
    names = list(named)
    taps = [(-o[0], -o[1], -o[2], 1.0) for o in named.values()]
    aggs = [F.max(F.when(F.col("tap.k") == k, F.col("_v"))).alias(n) for k, n in enumerate(names)]
    src = cells.withColumnRenamed(value, "_v").select(*keys, *AXES, *carry, "_v")
    # `carry` columns belong to the cell, not to its neighbours
    aggs += [F.max(F.when(F.col("tap.k") == names.index(value), F.col(c))).alias(c) for c in carry]
    return scatter(src, taps, aggs, keys, block).filter(F.col(value).isNotNull())
