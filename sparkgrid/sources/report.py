"""Metric reports as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Report columns in order.
RESOURCES = [
    "time_s", "cpu_percent_avg", "cpu_percent_peak", "ram_total_mb", "ram_peak_mb", "ram_percent", "ram_avg_mb",
    "ram_delta_peak_mb", "gpu_util_avg", "gpu_util_peak", "gpu_util_available", "gpu_total_mb", "gpu_mem_peak_mb",
    "gpu_mem_percent", "gpu_mem_avg_mb", "gpu_mem_delta_peak_mb", "torch_gpu_peak_mb", "torch_gpu_delta_mb",
    "gpu_spill_mb",
]
QUALITY = ["channels_compared", "detail_energy_mean", "bright_detail_energy_mean", "edge_strength_mean",
           "signal_sparsity_mean", "robust_range_mean"]


def metrics_report(df: DataFrame, columns: Sequence[str] = RESOURCES, quality: Sequence[str] = QUALITY) -> DataFrame:
    """Two-decimal text columns ordered by label; missing values read 0.00.

    Quality columns appear only when the table has any of them.
    """
    names = [*columns, *(quality if any(q in df.columns for q in quality) else [])]
    text = lambda n: F.format_string("%.2f", F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0))
    device = F.coalesce("device", F.lit("")) if "device" in df.columns else F.lit("")
    return df.select("label", device.alias("device"), *[text(n).alias(n) for n in names]).orderBy("label")


def write_metrics_csv(df: DataFrame, path: str, **kw) -> None:
    metrics_report(df, **kw).write.mode("overwrite").option("header", True).csv(path)
