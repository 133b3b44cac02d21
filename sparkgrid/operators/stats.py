"""Per-image statistics, quality measures and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.core import AXES, CELL, KEYS, attach, beside, finite, reusable
from sparkgrid.operators.rank import percentiles


def array_stats(cells: DataFrame, keys: Sequence[str] = KEYS, approx: int | None = None) -> DataFrame:
    """Min, max, mean and percentiles of finite cells; non-zero share of all cells."""
    keys = list(keys)
    cells = reusable(cells)
    v = F.when(finite("v"), F.col("v"))
    base = cells.groupBy(*keys).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        (F.count_if(F.col("v").isNotNull() & ((F.col("v") != 0) | F.isnan("v"))) / F.count("v") * 100).alias("nz"),
        F.count(v).alias("_n"),
    )
    pct = percentiles(cells, {"p1": 1, "p50": 50, "p99": 99}, keys, approx)
    some = F.col("_n") > 0
    names = ["min", "max", "mean", "p1", "p50", "p99"]
    return attach(base, pct, keys, "left").select(
        *keys, *[F.when(some, F.col(n)).otherwise(F.lit(0.0)).alias(n) for n in names],
        F.when(some, F.col("nz")).otherwise(F.lit(0.0)).alias("nonzero_percent"),
    )


def normalize(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Min-max scaling to [0, 1]; a constant image becomes 0."""
    keys = list(keys)
    lim = cells.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scaled = (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return attach(cells, lim, keys).withColumn(
        "v", F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def pair_panes(src: DataFrame, res: DataFrame) -> DataFrame:
    """Source and result values of the cells both have: ``src, res``."""
    a = src.select(*CELL, F.col("v").alias("src"))
    return beside(a, res.select(*CELL, F.col("v").alias("res")), CELL)


def divergence_of(d: Column, e: Column, eps: float = 1e-12) -> Column:
    """Pointwise generalised Kullback-Leibler term."""
    d, e = F.greatest(d, F.lit(eps)), F.greatest(e, F.lit(eps))
    return d * F.log(d / e) - d + e


def nll_of(d: Column, e: Column, eps: float = 1e-12) -> Column:
    """Pointwise Poisson negative log-likelihood without constants."""
    e = F.greatest(e, F.lit(eps))
    return e - d * F.log(e)


def i_divergence(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.avg(divergence_of(F.col("src"), F.col("res"))).alias("i_divergence"))


def poisson_nll(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.avg(nll_of(F.col("src"), F.col("res"))).alias("poisson_nll"))


def metrics_rollup(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per-channel rows plus, for images with several channels, their mean."""
    r = metrics.rollup("img", "c").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("channels"),
        *[F.avg(n).alias(n) for n in names])
    return r.filter((F.col("gid") == 0) | ((F.col("gid") == 1) & (F.col("channels") > 1)))


def metric_change(src: DataFrame, res: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Long form of two metric tables with ratio, or difference for tiny sources."""
    def melt(df: DataFrame, col: str) -> DataFrame:
        return df.unpivot(list(keys), list(names), "metric", col)

    s, r = F.col("src"), F.col("res")
    both = melt(src, "src").join(melt(res, "res"), [*keys, "metric"])
    ratio = F.abs(s) > 1e-12
    return both.select(
        *keys, "metric", "src", "res", F.when(ratio, r / s).otherwise(r - s).alias("change"),
        F.when(ratio, F.lit("ratio")).otherwise(F.lit("difference")).alias("kind"))


def telemetry_rollup(samples: DataFrame, total: float) -> DataFrame:
    """Average, peak, rise over the first sample, share of ``total`` and spill."""
    g = samples.groupBy("proc").agg(
        F.avg("value").alias("avg"), F.max("value").alias("peak"),
        F.min_by("value", F.struct("ts", "value")).alias("baseline"))
    delta = F.col("peak") - F.col("baseline")
    return g.select(
        "proc", "avg", "peak", delta.alias("delta"),
        (F.col("peak") / F.lit(float(total)) * 100).alias("percent"),
        F.greatest(delta - F.lit(float(total)), F.lit(0.0)).alias("spill"))


def channel_maxima(src: DataFrame, res: DataFrame) -> DataFrame:
    """Per-pane maxima (never below 0) and a shared maximum of at least 1."""
    def top(df: DataFrame, name: str) -> DataFrame:
        m = F.max(F.when(~F.isnan("v"), F.col("v")))
        m = F.when(finite(m), m)
        return df.groupBy("img", "c").agg(F.greatest(F.coalesce(m, F.lit(0.0)), F.lit(0.0)).alias(name))

    a, b = F.coalesce("original", F.lit(0.0)), F.coalesce("restored", F.lit(0.0))
    return top(src, "original").join(top(res, "restored"), ["img", "c"], "full").select(
        "img", "c", a.alias("original"), b.alias("restored"),
        F.greatest(a, b, F.lit(1.0)).alias("shared"))


def channel_shapes(cells: DataFrame) -> DataFrame:
    """Shape per channel and whether it equals the image's first channel."""
    shape = cells.groupBy("img", "c").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])
    first = F.first(F.struct(*[f"n{a}" for a in AXES])).over(Window.partitionBy("img").orderBy("c"))
    return shape.withColumn("matches", F.struct(*[f"n{a}" for a in AXES]) == first)


def validate_shapes(cells: DataFrame) -> DataFrame:
    """Pass cells through; fail the job when channels of an image differ in shape."""
    bad = channel_shapes(cells).groupBy("img").agg(F.bool_and("matches").alias("_ok"))
    checked = attach(cells, bad, ["img"])
    guard = F.when(F.col("_ok"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("channels differ in shape: "), F.col("img").cast("string"))).cast("boolean"))
    return checked.filter(guard).drop("_ok")
