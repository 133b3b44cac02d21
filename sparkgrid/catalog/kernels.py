from __future__ import annotations

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.core import extents, grid, rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.operators import conv, kernel as kn

#: separable 3 x 5 kernel with weights 1 / (1 + |d|), and an asymmetric 1 x 4 one
K35 = kn.separable([1.0], [0.5, 1.0, 0.5], [1 / 3, 0.5, 1.0, 0.5, 1 / 3])
K14 = kn.separable([1.0], [1.0], [0.1, 0.4, 0.3, 0.2])
K333 = kn.separable([0.5, 1.0, 0.5], [0.5, 1.0, 0.5], [0.5, 1.0, 0.5])


def taps_sql(taps, name: str = "k") -> str:
    rows = ", ".join(f"({z}, {y}, {x}, {w!r}::DOUBLE)" for z, y, x, w in taps)
    return f"{name}(dz, dy, dx, w) AS (VALUES {rows})"


NORM = """,
st AS (SELECT kid, sum(w) AS s, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM kernel_ev GROUP BY kid),
kn AS (SELECT kid, (z - nz // 2)::INT AS dz, (y - ny // 2)::INT AS dy, (x - nx // 2)::INT AS dx, w / s AS w
  FROM kernel_ev JOIN st USING (kid))"""


def _kn(spark, sf):
    return kn.kernel_normalize(fx.kernel_ev(spark, sf))


def _out(k):
    return k.select("kid", "dz", "dy", "dx", rnd("w", 8).alias("w"))


@query("r1_kernel_normalize", with_sql("kernel_ev") + NORM + "SELECT kid, dz, dy, dx, round(w, 8) AS w FROM kn")
def _r1(spark, sf):
    return _out(_kn(spark, sf))


def _sigmas(spark, sf):
    ev = fx._events(spark, sf)
    return ev.groupBy(F.concat_ws("/", "img", F.col("c").cast("string")).alias("kid")).agg(
        F.round(F.lit(0.5) + F.avg("value") / 50, 3).alias("sigma"))


@query("r2_kernel_gaussian", with_sql("ev") + """,
p AS (SELECT img || '/' || c AS kid, round(0.5 + avg(value) / 50, 3) AS sigma FROM ev GROUP BY img, c),
a AS (SELECT kid, sigma, unnest(range(-greatest(ceil(3 * sigma), 1)::INT, greatest(ceil(3 * sigma), 1)::INT + 1))::INT AS d FROM p),
g AS (SELECT kid, d, exp(-0.5 * (d / sigma) ** 2) / sum(exp(-0.5 * (d / sigma) ** 2)) OVER (PARTITION BY kid) AS w FROM a)
SELECT kid, 0 AS dz, a.d AS dy, b.d AS dx, round(a.w * b.w, 8) AS w FROM g a JOIN g b USING (kid)""")
def _r2(spark, sf):
    return _out(kn.kernel_gaussian(_sigmas(spark, sf), 2))


@query("r3_kernel_product", with_sql("kernel_ev") + NORM + """
SELECT kid, dz, dy, dx, round(w * w / sum(w * w) OVER (PARTITION BY kid), 8) AS w FROM kn""")
def _r3(spark, sf):
    k = _kn(spark, sf)
    return _out(kn.kernel_product(k, k))


@query("r4_kernel_collapse_z", with_sql("kernel_ev") + NORM + """,
f AS (SELECT kid, dy, dx, sum(w * exp(-0.5 * ((dz + 15 - 14.5) / 7.5) ** 2)) AS w FROM kn GROUP BY ALL)
SELECT kid, 0 AS dz, dy, dx, round(w / sum(w) OVER (PARTITION BY kid), 8) AS w FROM f""")
def _r4(spark, sf):
    return _out(kn.kernel_collapse_z(_kn(spark, sf), "balanced"))


@query("r5_kernel_crop_support", with_sql("kernel_ev") + NORM + """,
p AS (SELECT kid, abs(dz) AS r, sum(w) AS s FROM kn GROUP BY ALL),
c AS (SELECT *, sum(s) OVER (PARTITION BY kid ORDER BY r) AS cum, sum(s) OVER (PARTITION BY kid) AS tot FROM p),
r AS (SELECT kid, coalesce(min(r) FILTER (cum >= 0.6 * tot), 15) AS r FROM c GROUP BY kid),
n AS (SELECT kid, least(greatest(2 * r + 1, 5), 21, 30) AS n0 FROM r),
m AS (SELECT kid, (CASE WHEN n0 % 2 = 0 THEN n0 - 1 ELSE n0 END) // 2 AS h FROM n)
SELECT kid, dz, dy, dx, round(w, 8) AS w FROM kn JOIN m USING (kid) WHERE dz BETWEEN -h AND h""")
def _r5(spark, sf):
    return _out(kn.kernel_crop_support(_kn(spark, sf), 0.6, 5, 21))


@query("r6_kernel_center_crop", with_sql("kernel_ev") + NORM + """
SELECT kid, (dz + 15 - 11 - 3)::INT AS dz, (dy + 12 - 7 - 4)::INT AS dy, dx, round(w, 8) AS w FROM kn
WHERE dz + 15 BETWEEN 11 AND 17 AND dy + 12 BETWEEN 7 AND 15""")
def _r6(spark, sf):
    k = _kn(spark, sf)
    shape = k.select("kid").distinct().select(
        "kid", F.lit(7).alias("nz"), F.lit(9).alias("ny"), F.lit(64).alias("nx"))
    return _out(kn.kernel_center_crop(k, shape))


@query("a17_kernel_summary", with_sql("kernel_ev") + NORM + """
SELECT kid, (max(dz) - min(dz) + 1)::INT AS nz, (max(dy) - min(dy) + 1)::INT AS ny, (max(dx) - min(dx) + 1)::INT AS nx,
  round(sum(w), 6) AS total, round(max(w), 8) AS peak FROM kn GROUP BY kid""")
def _a17(spark, sf):
    s = kn.kernel_summary(_kn(spark, sf))
    return s.select("kid", "nz", "ny", "nx", rnd("total").alias("total"), rnd("peak", 8).alias("peak"))


def _conv_sql(fixture, taps, sign):
    return with_sql(fixture) + f", {taps_sql(taps)} SELECT c, z + {sign} * dz AS z, y + {sign} * dy AS y, x + {sign} * dx AS x, " \
        f"round(sum(v * w), 6) AS v FROM {fixture}, k GROUP BY ALL"


def _cells(df):
    return df.select("c", "z", "y", "x", rnd("v").alias("v"))


@query("j4_convolve", _conv_sql("cells_li", K35, "1"))
def _j4(spark, sf):
    return _cells(conv.convolve(fx.cells_li(spark, sf), K35))


@query("j4_convolve_3d", _conv_sql("cells_stack", K333, "1"))
def _j4b(spark, sf):
    return _cells(conv.convolve(fx.cells_stack(spark, sf), K333))


@query("j5_correlate", _conv_sql("cells_li", K14, "-1"))
def _j5(spark, sf):
    return _cells(conv.correlate(fx.cells_li(spark, sf), K14))


@query("j4_convolve_each", with_sql("cells_ev", "channels") + """,
p AS (SELECT c, round(0.4 + c * 0.2, 2) AS sigma FROM (SELECT DISTINCT c FROM channels)),
a AS (SELECT c, sigma, unnest(range(-greatest(ceil(3 * sigma), 1)::INT, greatest(ceil(3 * sigma), 1)::INT + 1))::INT AS d FROM p),
g AS (SELECT c, d, exp(-0.5 * (d / sigma) ** 2) / sum(exp(-0.5 * (d / sigma) ** 2)) OVER (PARTITION BY c) AS w FROM a),
k AS (SELECT a.c, a.d AS dy, b.d AS dx, a.w * b.w AS w FROM g a JOIN g b ON a.c = b.c)
SELECT img, s.c, y + dy AS y, x + dx AS x, round(sum(v * w), 6) AS v FROM cells_ev s JOIN k ON k.c = s.c GROUP BY ALL""")
def _j4c(spark, sf):
    p = fx.channels(spark, sf).select("c").distinct().select(
        F.col("c").alias("kid"), F.round(0.4 + F.col("c") * 0.2, 2).alias("sigma"))
    kernels = kn.kernel_gaussian(p, 2).withColumnRenamed("kid", "c")
    return conv.convolve_each(fx.cells_ev(spark, sf), kernels).select("img", "c", "y", "x", rnd("v").alias("v"))


@query("r7_boundary_weights", with_sql("cells_wk") + f""", {taps_sql(K35)},
im AS (SELECT z, y, x FROM cells_wk), box AS (SELECT DISTINCT y - dy AS y, x - dx AS x FROM im, k),
m AS (SELECT b.y, b.x, sum(w) AS m FROM box b CROSS JOIN k JOIN im ON im.y = b.y + k.dy AND im.x = b.x + k.dx GROUP BY ALL)
SELECT y, x, round(CASE WHEN m > 0.01 THEN 1 / m ELSE 0 END, 6) AS w FROM m""")
def _r7(spark, sf):
    dims = extents(fx.cells_wk(spark, sf))
    box = grid(dims, conv.work_ranges(K35))
    return conv.boundary_weights(box, K35).select("y", "x", rnd("w").alias("w"))
