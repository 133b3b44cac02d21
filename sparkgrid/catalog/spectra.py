from __future__ import annotations

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.catalog.windows import grad_sql
from sparkgrid.core import rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.operators import spectral as sp

WRAP = lambda k, n: f"(CASE WHEN {k} < ({n} + 1) // 2 THEN {k} / {n} ELSE ({k} - {n}) / {n} END)"
RMAX = "sqrt(pow((ny // 2) / ny, 2) + pow((nx // 2) / nx, 2))"


@query("f1_frequency_radius", f"""
WITH s AS (SELECT p_partkey AS img, p_size::DOUBLE AS ny, 7.0::DOUBLE AS nx FROM part),
k AS (SELECT *, unnest(range(p.ny::INT))::INT AS ky FROM s p), k2 AS (SELECT *, unnest(range(7))::INT AS kx FROM k)
SELECT img, ky, kx, round(sqrt(pow({WRAP('ky', 'ny')}, 2) + pow({WRAP('kx', 'nx')}, 2)), 6) AS radius,
  round(sqrt(pow(floor(ny / 2) / ny, 2) + pow(3 / nx, 2)), 6) AS max_radius FROM k2""")
def _f1(spark, sf):
    shapes = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("img"), F.col("p_size").alias("ny"), F.lit(7).alias("nx"))
    r = sp.frequency_radius(shapes)
    return r.select("img", "ky", "kx", rnd("radius").alias("radius"), rnd("max_radius").alias("max_radius"))


def dft_sql(src: str, tag: str) -> str:
    """CTE ``sh{tag}``: full 24 x 30 transform, high band over all power."""
    return f"""
tx{tag} AS MATERIALIZED (SELECT img, c, y, kx, sum(v * cos(2 * pi() * ((kx * x) % 30) / 30)) AS re, -sum(v * sin(2 * pi() * ((kx * x) % 30) / 30)) AS im
  FROM {src}, (SELECT unnest(range(30))::INT AS kx) GROUP BY ALL),
ty{tag} AS MATERIALIZED (SELECT img, c, kx, ky, sum(re * cos(a) + im * sin(a)) AS re, sum(im * cos(a) - re * sin(a)) AS im FROM (
  SELECT *, 2 * pi() * ((ky * y) % 24) / 24 AS a FROM tx{tag}, (SELECT unnest(range(24))::INT AS ky)) GROUP BY ALL),
pw{tag} AS (SELECT img, c, re * re + im * im AS p, sqrt(pow({WRAP('kx', '30')}, 2) + pow({WRAP('ky', '24')}, 2)) AS r FROM ty{tag}),
sh{tag} AS (SELECT img, c, sum(p) FILTER (r > 0.25 * sqrt(0.5)) / (sum(p) + 1e-12) AS share FROM pw{tag} GROUP BY img, c)"""


CENT = ", ce AS (SELECT img, c, y, x, v AS raw, v - avg(v) OVER (PARTITION BY img, c) AS v FROM {src})"
BRIGHT = """, q AS (SELECT img, c, quantile_cont(raw, 0.95) AS p95 FROM ce GROUP BY img, c),
br AS (SELECT ce.img, ce.c, y, x, CASE WHEN raw >= p95 THEN v ELSE 0 END AS v FROM ce JOIN q USING (img, c))"""


@query("f2_detail_energy", with_sql("cells_evs") + CENT.format(src="cells_evs") + "," + dft_sql("ce", "")
       + " SELECT img, c, round(share, 6) AS detail_energy FROM sh")
def _f2(spark, sf):
    return sp.detail_energy(fx.cells_evs(spark, sf)).select("img", "c", rnd("detail_energy").alias("detail_energy"))


@query("f3_bright_detail_energy", with_sql("cells_evs") + CENT.format(src="cells_evs") + BRIGHT + "," + dft_sql("br", "")
       + " SELECT img, c, round(share, 6) AS bright_detail_energy FROM sh")
def _f3(spark, sf):
    b = sp.bright_detail_energy(fx.cells_evs(spark, sf))
    return b.select("img", "c", rnd("bright_detail_energy").alias("bright_detail_energy"))


M = ["detail_energy", "bright_detail_energy", "edge_strength", "signal_sparsity", "robust_range"]


@query("a13_effect_metrics", with_sql("cells_evs") + """,
nrm AS (SELECT img, t, c, z, y, x, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS v FROM (
  SELECT *, min(v) OVER (PARTITION BY img, c) AS lo, max(v) OVER (PARTITION BY img, c) AS hi FROM cells_evs))"""
       + CENT.format(src="nrm") + BRIGHT + "," + dft_sql("ce", "1") + "," + dft_sql("br", "2") + "," + grad_sql("nrm") + """,
rk AS (SELECT img, c, v, row_number() OVER (PARTITION BY img, c ORDER BY v) AS i FROM nrm),
g AS (SELECT img, c, 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*) AS gini,
  quantile_cont(v, 0.995) - quantile_cont(v, 0.005) AS rr FROM rk GROUP BY img, c),
e AS (SELECT img, c, avg(sqrt(gz * gz + gy * gy + gx * gx)) AS es FROM gr GROUP BY img, c)
SELECT img, c, round(sh1.share, 6) AS detail_energy, round(sh2.share, 6) AS bright_detail_energy, round(es, 6) AS edge_strength,
  round(gini, 6) AS signal_sparsity, round(rr, 6) AS robust_range
FROM sh1 JOIN sh2 USING (img, c) JOIN g USING (img, c) JOIN e USING (img, c)""")
def _a13(spark, sf):
    return sp.effect_metrics(fx.cells_evs(spark, sf)).select("img", "c", *[rnd(m).alias(m) for m in M])
