"""

Every query runs once to warm up and BENCH_REPEATS times measured (median).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog.kernels import K35
from sparkgrid.catalog.restoration import taps_block
from sparkgrid.core import extents
from sparkgrid.operators import conv, kernel as kn, rank, shape, spectral, stats, stencil
from sparkgrid.plans import restore, tiled
from sparkgrid.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
ITERATIONS = 10

K57 = kn.separable([1.0], [1 / (1 + abs(i)) for i in range(-2, 3)], [1 / (1 + abs(i)) for i in range(-3, 4)])


def grid_of(cells, ny, nx):
    return extents(cells).select("img", F.col("ny").alias("h"), F.col("nx").alias("w"), F.lit(ny).alias("ny"), F.lit(nx).alias("nx"))


def rl(s):
    return restore.richardson_lucy(fx.cells_wk(s, SF_DIR), K35, niter=ITERATIONS).cells


def rl_tiled(s):
    cells = fx.cells_wk(s, SF_DIR)
    return tiled.restore_tiled(cells, taps_block(K35), grid_of(cells, 4, 2), niter=ITERATIONS).cells


QUERIES = {
    "a1_array_stats": lambda s: stats.array_stats(fx.cells_evs(s, SF_DIR)),
    "a4_gini": lambda s: rank.gini(fx.cells_wk(s, SF_DIR)),
    "a5_background_level": lambda s: rank.background_level(fx.cells_wk(s, SF_DIR)),
    "a20_pyramid": lambda s: shape.pyramid(fx.cells_wk(s, SF_DIR), 3),
    "f2_detail_energy": lambda s: spectral.detail_energy(fx.cells_evs(s, SF_DIR)),
    "j4_convolve_5x7": lambda s: conv.convolve(fx.cells_li(s, SF_DIR), K57),
    "w5_sparse_hessian_penalty": lambda s: stencil.sparse_hessian_penalty(fx.cells_wk(s, SF_DIR), volume=False),
    "w7_gaussian_smooth": lambda s: stencil.gaussian_smooth(fx.cells_wk(s, SF_DIR), 1.2),
    "r11_richardson_lucy_10": rl,
    "r17_restore_tiled_10": rl_tiled,
}


def timed(fn, spark) -> float:
    t0 = time.perf_counter()
    fn(spark).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or list(QUERIES)
    out = {}
    for name in chosen:
        timed(QUERIES[name], spark)
        out[name] = round(statistics.median(timed(QUERIES[name], spark) for _ in range(REPEATS)), 3)
    cells = fx.cells_wk(spark, SF_DIR).count()
    rates = {n: round(cells * ITERATIONS / out[n]) for n in out if n.endswith("_10")}
    print(json.dumps({
        "metric": "total of headline operators", "value": round(sum(out.values()), 3), "unit": "sec",
        "queries": out, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cells_per_sec": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
