"""Fixed-bin histograms and the levels read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import KEYS, attach, finite


def histogram(cells: DataFrame, limits: DataFrame, bins: int = 512, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per bin for each group; empty bins are kept, the last is closed.

    ``limits`` has one row per group with ``lo`` and ``hi``.  Values outside
    are clipped into the end bins; where ``lo`` equals ``hi`` all fall into
    the first.  Output: keys, bin, left, right, n.
    """
    keys = list(keys)
    width = F.col("hi") - F.col("lo")
    pos = F.when(width > 0, F.floor(F.try_divide(F.col("v") - F.col("lo"), width) * bins)).otherwise(F.lit(0))
    binned = attach(cells.filter(finite("v")).select(*keys, "v"), limits.select(*keys, "lo", "hi"), keys)
    counts = binned.groupBy(
        *keys, F.least(F.greatest(pos, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    frame = limits.select(*keys, "lo", "hi").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + width * F.col("bin") / bins).alias("left"),
        (F.col("lo") + width * (F.col("bin") + 1) / bins).alias("right"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hist_percentile(hist: DataFrame, pcts: dict[str, float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Percentiles read from bin counts, linear inside the bin that reaches the target."""
    keys = list(keys)
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    h = (
        hist.withColumn("cum", F.sum("n").over(up)).withColumn("total", F.sum("n").over(all_))
        .withColumn("last", F.max("bin").over(all_))
    )
    outs = []
    for name, p in pcts.items():
        target = F.lit(p / 100.0) * F.col("total")
        inside = (target - (F.col("cum") - F.col("n"))) / F.greatest(F.col("n").cast("double"), F.lit(1.0))
        value = F.col("left") + inside * (F.col("right") - F.col("left"))
        hit = (F.col("cum") >= target) | (F.col("bin") == F.col("last"))
        at = F.min_by(F.when(hit, value), F.when(hit, F.col("bin")))
        outs.append(F.when(F.max("total") == 0, F.min("left")).otherwise(at).alias(name))
    return h.groupBy(*keys).agg(*outs)


def pane_limits(panes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0 .. max(pane maximum, 1) per group, with the maximum itself."""
    top = F.greatest(F.coalesce(F.max(F.when(finite("v"), F.col("v"))), F.lit(0.0)), F.lit(0.0))
    return panes.groupBy(*keys).agg(top.alias("pane_max")).select(
        *keys, "pane_max", F.lit(0.0).alias("lo"), F.greatest("pane_max", F.lit(1.0)).alias("hi"))


def auto_levels(
    panes: DataFrame,
    lo_pct: float = 1.0,
    hi_pct: float = 99.8,
    bins: int = 512,
    keys: Sequence[str] = ("pane", "img", "c"),
) -> DataFrame:
    """Contrast limits per pane and channel: 0 <= min <= max <= pane maximum."""
    keys = list(keys)
    lim = pane_limits(panes, keys)
    p = hist_percentile(histogram(panes, lim, bins, keys), {"lo_p": lo_pct, "hi_p": hi_pct}, keys)
    out = attach(p, lim.select(*keys, "pane_max"), keys)
    return out.select(
        *keys, F.greatest("lo_p", F.lit(0.0)).alias("min"),
        F.least(F.greatest("hi_p", "lo_p"), F.col("pane_max")).alias("max"))
