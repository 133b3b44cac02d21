"""Exact order statistics that never gather a group in one task.

A first pass counts cells per value bucket (map-side combined, a few thousand
rows per group).  The bucket holding a wanted rank is found on that small
table; only its cells are then read again, counted by value and ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import KEYS, attach, finite, reusable, settle

#: buckets per power of two
RESOLUTION = 1024
#: parts of a bucket that holds a wanted rank, even between its own extremes
PARTS = 1024


def bucket_of(v: Column, resolution: int = RESOLUTION) -> Column:
    """A non-decreasing map from doubles to longs; relative width 1/resolution."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    frac = F.floor(a / F.pow(F.lit(2.0), e.cast("double")) * resolution)
    code = (e + F.lit(1100)) * F.lit(2 * resolution) + frac
    return F.when(v == 0, F.lit(0)).when(v > 0, code).otherwise(-code).cast("long")


def bucket_counts(cells: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return cells.groupBy(*keys, bucket_of(F.col("v")).alias("b")).agg(
        n.cast("long").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def order_stats(
    cells: DataFrame,
    ranks: Mapping[str, Column],
    keys: Sequence[str] = KEYS,
    weight: str | None = None,
) -> DataFrame:
    """Values at zero-based ranks of the ascending ``v`` per group.

    ``ranks`` maps an output name to an expression over ``total``, the group
    size.  ``weight`` names a column with the number of copies of each row.
    Returns one row per group with ``total`` and the named values.
    """
    keys = list(keys)
    src = cells.filter(finite("v")).select(*keys, "v", *([weight] if weight else []))
    running = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    hist = (
        bucket_counts(src, keys, weight)
        .withColumn("cum", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(whole))
    )
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), expr.cast("long").alias("r")) for name, expr in ranks.items()
    ])
    targets = (
        hist.withColumn("want", F.explode(wanted))
        .select(*keys, "b", "total", "want.name", F.col("want.r").alias("r"), (F.col("cum") - F.col("n")).alias("before"), "cum", "lo", "hi")
        .filter((F.col("r") >= F.col("before")) & (F.col("r") < F.col("cum")))
        .groupBy(*keys, "b", "lo", "hi")
        .agg(F.collect_list(F.struct("name", "r", "before", "total")).alias("want"))
    )
    part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1)))
    copies = F.sum(weight) if weight else F.count(F.lit(1))
    near = (
        attach(src.withColumn("b", bucket_of(F.col("v"))), targets.select(*keys, "b", "lo", "hi", "want"), keys + ["b"])
        .withColumn("part", F.coalesce(part, F.lit(0)).cast("int"))
        .groupBy(*keys, "b", "part", "v").agg(copies.cast("long").alias("m"), F.first("want").alias("want"))
    )
    at = [*keys, "b", "part"]
    earlier = Window.partitionBy(*keys, "b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = near.groupBy(*at).agg(F.sum("m").alias("in_part")).select(
        *at, F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy(*at).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        near.withColumn("cum", F.sum("m").over(within)).join(starts, at)
        .withColumn("cum", F.col("cum") + F.col("start"))
        .withColumn("w", F.explode("want"))
        .filter((F.col("w.r") - F.col("w.before") >= F.col("cum") - F.col("m"))
                & (F.col("w.r") - F.col("w.before") < F.col("cum")))
    )
    return hits.groupBy(*keys).agg(
        F.max("w.total").alias("total"),
        *[F.max(F.when(F.col("w.name") == n, F.col("v"))).alias(n) for n in ranks],
    )


def percentiles(
    cells: DataFrame,
    ps: Mapping[str, float],
    keys: Sequence[str] = KEYS,
    approx: int | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles per group; ``ps`` maps name to 0..100.

    ``approx`` switches to the mergeable one-pass sketch with that accuracy.
    """
    keys = list(keys)
    if approx:
        sk = F.percentile_approx("v", [p / 100 for p in ps.values()], approx)
        out = cells.filter(finite("v")).groupBy(*keys).agg(sk.alias("_p"))
        return out.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(ps)])
    pos = {n: (F.col("total") - 1) * F.lit(p / 100) for n, p in ps.items()}
    ranks: dict[str, Column] = {}
    for n in ps:
        ranks[f"{n}_lo"] = F.floor(pos[n])
        ranks[f"{n}_hi"] = F.ceil(pos[n])
    stats = order_stats(cells, ranks, keys)
    lin = lambda n: F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (pos[n] - F.floor(pos[n]))
    return stats.select(*keys, *[lin(n).alias(n) for n in ps])


def robust_range(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spread between the 0.5 and 99.5 percentiles."""
    p = percentiles(cells, {"p_lo": 0.5, "p_hi": 99.5}, keys)
    return p.select(*keys, "p_lo", "p_hi", (F.col("p_hi") - F.col("p_lo")).alias("robust_range"))


def share_count(frac: float) -> Column:
    """How many of ``total`` cells make up the lowest share (at least one)."""
    return F.greatest(F.floor(F.col("total") * F.lit(frac)), F.lit(1))


def background_level(cells: DataFrame, frac: float = 0.1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Lower median of the lowest share: a single order statistic of the group."""
    rank = F.floor((share_count(frac) - 1) / 2)
    return order_stats(cells, {"background": rank}, keys).select(*keys, "background")


def lowest_fraction(cells: DataFrame, frac: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Values of the lowest share with their copies: ``keys, v, copies``.

    Ties at the threshold are cut to the exact share, as a sorted prefix is.
    """
    keys = list(keys)
    cut = order_stats(cells, {"edge": share_count(frac) - 1}, keys).select(
        *keys, "edge", share_count(frac).alias("take"))
    kept = attach(cells.filter(finite("v")), cut, keys).filter(F.col("v") <= F.col("edge"))
    counted = kept.groupBy(*keys, "v").agg(
        F.count(F.lit(1)).alias("copies"), F.first("edge").alias("edge"), F.first("take").alias("take"))
    below = (
        counted.filter(F.col("v") < F.col("edge")).groupBy(*keys).agg(F.sum("copies").alias("below"))
    )
    out = attach(counted, below, keys, "left")
    n = F.when(F.col("v") == F.col("edge"), F.col("take") - F.coalesce("below", F.lit(0))).otherwise(F.col("copies"))
    return out.select(*keys, "v", n.cast("long").alias("copies"))


def noise_sigma(cells: DataFrame, frac: float = 0.25, keys: Sequence[str] = KEYS) -> DataFrame:
    """1.4826 x median absolute deviation of the lowest share, floored at 1e-12."""
    keys = list(keys)
    cells = reusable(cells)
    low = settle(lowest_fraction(cells, frac, keys))
    mid = F.floor((F.col("total") - 1) / 2)
    med = order_stats(low, {"med": mid}, keys, weight="copies").select(*keys, "med")
    dev = attach(low, med, keys).select(*keys, F.abs(F.col("v") - F.col("med")).alias("v"), "copies")
    mad = order_stats(dev, {"mad": mid}, keys, weight="copies")
    return mad.select(*keys, F.greatest(F.col("mad") * 1.4826, F.lit(1e-12)).alias("sigma"))


def gini(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Concentration of intensity: 0 = even, towards 1 = sparse.

    Ranks inside a part of a bucket are local; starting ranks are added from the
    small tables of parts and of buckets, so no task sorts a whole group.
    """
    keys = list(keys)
    b, f = [*keys, "b"], [*keys, "b", "f"]
    vals = cells.filter(finite("v")).groupBy(
        *keys, bucket_of(F.col("v")).alias("b"), bucket_of(F.col("v"), RESOLUTION * PARTS).alias("f"), "v").agg(
        F.count(F.lit(1)).alias("m"))
    inner = Window.partitionBy(*f).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    local = vals.withColumn("prev", F.coalesce(F.sum("m").over(inner), F.lit(0)))
    parts = local.groupBy(*f).agg(
        F.sum("m").alias("n"),
        F.sum(F.col("v") * F.col("m")).alias("s0"),
        F.sum(F.col("v") * (F.col("m") * F.col("prev") + F.col("m") * (F.col("m") + 1) / 2)).alias("s1"),
    )
    middle = Window.partitionBy(*b).orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    per = parts.withColumn("before", F.coalesce(F.sum("n").over(middle), F.lit(0))).groupBy(*b).agg(
        F.sum("n").alias("n"), F.sum("s0").alias("s0"), F.sum(F.col("s1") + F.col("before") * F.col("s0")).alias("s1"))
    outer = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    tot = per.withColumn("before", F.coalesce(F.sum("n").over(outer), F.lit(0))).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s0").alias("s"),
        F.sum(F.col("s1") + F.col("before") * F.col("s0")).alias("ranked"),
    )
    g = 2 * F.col("ranked") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return tot.select(*keys, F.when(F.col("s") > 1e-12, g).otherwise(F.lit(0.0)).alias("gini"))
