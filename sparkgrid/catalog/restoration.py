from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.catalog.kernels import K35, taps_sql
from sparkgrid.catalog.statistics import LOW
from sparkgrid.catalog.windows import filter_sql, grad_pen_sql, tv_sql
from sparkgrid.core import extents, rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.operators import tiles as tl
from sparkgrid.operators.kernel import separable
from sparkgrid.plans import batch as bt, keyed, restore as rs, routing as rt, tiled as td


AUTO = "SELECT img, c, quantile_disc(v, 0.5) AS bg FROM low GROUP BY img, c"


def start_sql(fixture: str, taps, offset: float = 5.0, x0: str = "greatest(q.mean, q.bg)", bg: str = AUTO, before: str | None = None) -> str:
    """CTEs up to ``s0``: observed image, background, work box, weights, start."""
    return (before or with_sql(fixture) + LOW(fixture, 0.1)) + f""",
{taps_sql(taps)},
par AS (SELECT a.img, a.c, greatest(a.bg, 1e-6) + {offset} AS bg, b.mean FROM
  ({bg}) a JOIN
  (SELECT img, c, avg(v + {offset}) AS mean FROM {fixture} GROUP BY img, c) b USING (img, c)),
im AS MATERIALIZED (SELECT s.img, s.c, s.z, s.y, s.x, s.v + {offset} AS d, q.bg FROM {fixture} s JOIN par q USING (img, c)),
box AS MATERIALIZED (SELECT DISTINCT img, c, z - dz AS z, y - dy AS y, x - dx AS x FROM im, k),
ef AS MATERIALIZED (SELECT i.*, i.z - k.dz AS jz, i.y - k.dy AS jy, i.x - k.dx AS jx, k.w FROM im i, k),
eb AS MATERIALIZED (SELECT b.*, b.z + k.dz AS jz, b.y + k.dy AS jy, b.x + k.dx AS jx, k.w FROM box b, k),
ms AS (SELECT b.img, b.c, b.z, b.y, b.x, sum(b.w) AS m FROM eb b JOIN im ON im.img = b.img AND im.c = b.c
  AND im.z = b.jz AND im.y = b.jy AND im.x = b.jx GROUP BY ALL),
s0 AS MATERIALIZED (SELECT b.img, b.c, b.z, b.y, b.x, CASE WHEN m > 0.01 THEN 1 / m ELSE 0 END AS w, q.bg, im.d,
  {x0} AS xp, {x0} AS xc FROM box b JOIN par q USING (img, c) LEFT JOIN ms USING (img, c, z, y, x)
  LEFT JOIN im USING (img, c, z, y, x))"""


def data_sql(k: int, damp: str = "corr") -> str:
    """CTE ``u{k}``: momentum, forward sum, ratio, adjoint sum -> raw update."""
    a = rs.momentum_weight(k)
    return f""",
p{k} AS MATERIALIZED (SELECT *, greatest(xc + {a!r} * (xc - xp), bg) AS p FROM s{k - 1}),
r{k} AS MATERIALIZED (SELECT i.img, i.c, i.z, i.y, i.x, any_value(i.d) / greatest(sum(p.p * i.w), any_value(i.bg)) AS r
  FROM ef i JOIN p{k} p ON p.img = i.img AND p.c = i.c AND p.z = i.jz AND p.y = i.jy AND p.x = i.jx
  GROUP BY i.img, i.c, i.z, i.y, i.x),
c{k} AS (SELECT b.img, b.c, b.z, b.y, b.x, sum(r.r * b.w) AS corr FROM eb b JOIN r{k} r ON r.img = b.img AND r.c = b.c
  AND r.z = b.jz AND r.y = b.jy AND r.x = b.jx GROUP BY b.img, b.c, b.z, b.y, b.x),
u{k} AS MATERIALIZED (SELECT p.*, p.p * ({damp}) * p.w AS v FROM p{k} p LEFT JOIN
  (SELECT img, c, z, y, x, corr FROM c{k}) q USING (img, c, z, y, x))"""


def rl_sql(fixture: str, taps, niter: int, damp: str = "coalesce(corr, 0)", **kw) -> str:
    sql = start_sql(fixture, taps, **kw)
    for k in range(1, niter + 1):
        sql += data_sql(k, damp) + f""",
s{k} AS MATERIALIZED (SELECT img, c, z, y, x, w, bg, d, xc AS xp, greatest(v, bg) AS xc FROM u{k})"""
    return sql


def result_sql(niter: int, offset: float = 5.0) -> str:
    return f" SELECT img, c, z, y, x, round(greatest(xc - {offset}, 0), 6) AS v FROM s{niter} WHERE d IS NOT NULL"


def _cells(df):
    return df.select("img", "c", "z", "y", "x", rnd("v").alias("v"))


@query("r10_rl_step", rl_sql("cells_ev", K35, 1) + " SELECT img, c, z, y, x, round(xp, 6) AS xp, round(xc, 6) AS xc FROM s1")
def _r10(spark, sf):
    opt = rs.Options(niter=1)
    s = rs.rl_step(rs.prepare(fx.cells_ev(spark, sf), K35, opt), K35, 1, opt)
    return s.select("img", "c", "z", "y", "x", rnd("xp").alias("xp"), rnd("xc").alias("xc"))


@query("r11_richardson_lucy", rl_sql("cells_ev", K35, 3) + result_sql(3))
def _r11(spark, sf):
    return _cells(rs.richardson_lucy(fx.cells_ev(spark, sf), K35, niter=3, track=False).cells)


@query("r11_richardson_lucy_large", rl_sql("cells_wk", K35, 3) + result_sql(3))
def _r11b(spark, sf):
    return _cells(rs.richardson_lucy(fx.cells_wk(spark, sf), K35, niter=3, track=False).cells)


@query("r11_richardson_lucy_blocks", rl_sql("cells_wk", K35, 7) + result_sql(7))
def _r11d(spark, sf):
    """Dense blocks, several updates per exchange: same cells as the column plan."""
    r = rs.richardson_lucy(fx.cells_wk(spark, sf), K35, niter=7, engine="blocks", dense_block=64)
    return _cells(r.cells)


DAMP = """pow(greatest(coalesce(corr, 0), 1e-12), least(greatest(1 - exp(-greatest(p.p - p.bg, 0)
  / greatest(3.0 * (SELECT sg.sigma FROM sg WHERE sg.img = p.img AND sg.c = p.c), 1e-12)), 1e-3), 1))"""
SIGMA = LOW("cells_evs", 0.25).replace("rk AS", "rk2 AS").replace("FROM rk", "FROM rk2").replace("low AS", "low2 AS") + """,
sm AS (SELECT img, c, quantile_disc(v, 0.5) AS med FROM low2 GROUP BY img, c),
sg AS (SELECT img, c, greatest(1.4826 * quantile_disc(abs(v - med), 0.5), 1e-12) AS sigma
  FROM low2 JOIN sm USING (img, c) GROUP BY img, c)"""


def _damped_sql() -> str:
    sql = start_sql("cells_evs", K35) + SIGMA
    for k in (1, 2, 3):
        sql += data_sql(k, DAMP) + f""",
s{k} AS MATERIALIZED (SELECT img, c, z, y, x, w, bg, d, xc AS xp, greatest(v, bg) AS xc FROM u{k})"""
    return sql + result_sql(3).replace(", 6)", ", 4)")


@query("r11_richardson_lucy_damped", _damped_sql())
def _r11c(spark, sf):
    r = rs.richardson_lucy(fx.cells_evs(spark, sf), K35, niter=3, damping="auto", track=False)
    return r.cells.select("img", "c", "z", "y", "x", rnd("v", 4).alias("v"))


def tv_rl_sql(fixture: str, taps, niter: int, lam: float) -> str:
    sql = start_sql(fixture, taps)
    one = {a: 1.0 for a in "zyx"}
    size = lambda a: f"(max({a}) OVER (PARTITION BY img, c) - min({a}) OVER (PARTITION BY img, c) + 1)"
    for k in range(1, niter + 1):
        sql += data_sql(k, "coalesce(corr, 0)") + f""",
q{k} AS (SELECT *, {', '.join(f'(({a} % {size(a)}) + {size(a)}) % {size(a)} AS p{a}' for a in 'zyx')} FROM u{k}),
{tv_sql(f'q{k}', lam, one, str(k), ('pz', 'py', 'px'))},
s{k} AS MATERIALIZED (SELECT img, c, z, y, x, w, bg, d, xc AS xp, greatest(v * factor, bg) AS xc FROM tvf{k})"""
    return sql + result_sql(niter)


@query("r12_richardson_lucy_tv", tv_rl_sql("cells_ev", K35, 3, 0.05))
def _r12(spark, sf):
    return _cells(rs.richardson_lucy_tv(fx.cells_ev(spark, sf), K35, 0.05, niter=3, track=False).cells)


def sparse_rl_sql(fixture: str, taps, niter: int, w: float, reg: float) -> str:
    sql = start_sql(fixture, taps)
    for k in range(1, niter + 1):
        sql += data_sql(k, "coalesce(corr, 0)") + f""",
x{k} AS MATERIALIZED (SELECT * REPLACE (greatest(v, bg) AS v) FROM u{k}),
i{k} AS MATERIALIZED (SELECT img, c, z, y, x, v, bg FROM x{k} WHERE d IS NOT NULL),
{grad_pen_sql(f'i{k}', w, 1.0, False, str(k))},
sc{k} AS (SELECT i.img, i.c, greatest(avg(abs(g)), 1e-12) AS scale, greatest(avg(i.v) - max(i.bg), 1) AS sig
  FROM i{k} i JOIN hg{k} USING (img, c, z, y, x) GROUP BY i.img, i.c),
s{k} AS MATERIALIZED (SELECT x.img, x.c, x.z, x.y, x.x, x.w, x.bg, x.d, x.xc AS xp,
  CASE WHEN x.d IS NULL THEN x.v ELSE greatest(x.v - {0.1 * (1 - reg)!r} * sig * g / scale, x.bg) END AS xc
  FROM x{k} x JOIN sc{k} USING (img, c) LEFT JOIN hg{k} USING (img, c, z, y, x))"""
    return sql + result_sql(niter)


@query("r13_sparse_hessian", sparse_rl_sql("cells_ev", K35, 3, 0.6, 0.9))
def _r13(spark, sf):
    r = rs.sparse_hessian_deconvolve(fx.cells_ev(spark, sf), K35, 0.6, 0.9, volume=False, niter=3, track=False)
    return _cells(r.cells)


@query("r9_momentum", f"""SELECT o_orderkey, round(greatest(o_totalprice + {rs.momentum_weight(7)!r} * (o_totalprice - o_custkey), 1000.0), 4) AS p
FROM orders""")
def _r9(spark, sf):
    o = fx.table(spark, sf, "orders")
    p = rs.momentum(F.col("o_totalprice"), F.col("o_custkey").cast("double"), 7, F.lit(1000.0))
    return o.select("o_orderkey", rnd(p, 4).alias("p"))


OBS = start_sql("cells_ev", K35, x0="coalesce(im.d, q.bg)") + " SELECT img, c, y, x, round(xc, 6) AS v, round(w, 6) AS w FROM s0"


@query("r8_start_observed", OBS)
def _r8a(spark, sf):
    s = rs.prepare(fx.cells_ev(spark, sf), K35, rs.Options(start="observed", engine="columns"))
    return s.select("img", "c", "y", "x", rnd("xc").alias("v"), rnd("w").alias("w"))


@query("r8_start_flat", start_sql("cells_ev", K35) + " SELECT img, c, y, x, round(xc, 6) AS v FROM s0")
def _r8b(spark, sf):
    s = rs.prepare(fx.cells_ev(spark, sf), K35, rs.Options(start="flat", engine="columns"))
    return s.select("img", "c", "y", "x", rnd("xc").alias("v"))


def _hist_sql() -> str:
    sql = rl_sql("cells_ev", K35, 2)
    return sql + """,
f AS (SELECT i.img, i.c, i.z, i.y, i.x, any_value(i.d) AS d, greatest(sum(p.xc * i.w), any_value(i.bg)) AS e
  FROM ef i JOIN s2 p ON p.img = i.img AND p.c = i.c AND p.z = i.jz AND p.y = i.jy AND p.x = i.jx
  GROUP BY i.img, i.c, i.z, i.y, i.x)
SELECT img, c, 2 AS iter, round(avg(d * ln(d / e) - d + e), 6) AS metric FROM f GROUP BY img, c"""


@query("r14_convergence_history", _hist_sql())
def _r14(spark, sf):
    h = rs.richardson_lucy(fx.cells_ev(spark, sf), K35, niter=2).history
    return h.select("img", "c", "iter", rnd("metric").alias("metric"))


@query("r14_converged_at", """
WITH h AS (SELECT 'u' || (user_id // 50) AS img, event_type, day(ts)::INT * 2 AS iter, round(sum(value), 2) AS metric FROM events GROUP BY ALL),
b AS (SELECT *, lag(metric) OVER (PARTITION BY img, event_type ORDER BY iter) AS before FROM h)
SELECT img, event_type, coalesce(min(iter) FILTER (before > 0 AND (before - metric) / before < 0.005 AND iter > 15), 60)::BIGINT AS iterations
FROM b GROUP BY img, event_type""")
def _r14b(spark, sf):
    h = fx.table(spark, sf, "events").groupBy(
        F.concat(F.lit("u"), F.floor(F.col("user_id") / 50)).alias("img"), F.lit(0).alias("t"), F.col("event_type").alias("c"),
        (F.dayofmonth("ts") * 2).alias("iter")).agg(F.round(F.sum("value"), 2).alias("metric"))
    return rs.converged_at(h, 60).select("img", F.col("c").alias("event_type"), "iterations")


# --- tiles, presets, batch runs -------------------------------------------


@query("k2_best_tile_grid", """
WITH o AS (SELECT o_orderkey AS img, 300 + o_custkey AS h, 200 + floor(o_totalprice / 1000)::BIGINT AS w, 1 + o_orderkey % 24 AS n FROM orders),
g AS (SELECT *, unnest(range(1, n + 1)) AS ny FROM o),
r AS (SELECT *, greatest(h / ny, w / (n / ny)) / greatest(least(h / ny, w / (n / ny)), 1.0) AS ratio FROM g WHERE n % ny = 0)
SELECT img, arg_min(ny, (ratio, ny))::INT AS ny, (any_value(n) / arg_min(ny, (ratio, ny)))::INT AS nx FROM r GROUP BY img""")
def _k2(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("img"), (F.col("o_custkey") + 300).alias("h"),
        (F.floor(F.col("o_totalprice") / 1000) + 200).alias("w"), (F.col("o_orderkey") % 24 + 1).alias("n"))
    return tl.best_tile_grid(o).select("img", "ny", "nx")


@query("r16_suggest_tile", """
SELECT p_partkey, greatest(256, least(floor(sqrt((p_retailprice * 1000000 // 2) / (64 * CASE WHEN p_size > 1 THEN 4 * p_size ELSE 1 END))) - 65, 4096))::BIGINT AS side FROM part""")
def _r16(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select("p_partkey", tl.suggest_tile(F.col("p_size"), F.round(F.col("p_retailprice") * 1000000)).alias("side"))


def _grids(spark, sf):
    return fx.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("img"), (F.col("s_suppkey") + 101).cast("int").alias("h"),
        (F.col("s_nationkey") * 3 + 90).cast("int").alias("w"), F.lit(4).alias("ny"), F.lit(3).alias("nx"))


@query("r16_tile_table", """
WITH g AS (SELECT s_suppkey AS img, (s_suppkey + 101)::INT AS h, (s_nationkey * 3 + 90)::INT AS w FROM supplier),
t AS (SELECT *, unnest(range(4))::INT AS iy FROM g), u AS (SELECT *, unnest(range(3))::INT AS ix FROM t),
b AS (SELECT *, round_even(iy * (h / 4), 0)::INT AS y0c, round_even((iy + 1) * (h / 4), 0)::INT AS y1c,
  round_even(ix * (w / 3), 0)::INT AS x0c, round_even((ix + 1) * (w / 3), 0)::INT AS x1c FROM u)
SELECT img, iy, ix, y0c, y1c, greatest(y0c - 5, 0)::INT AS y0e, least(y1c + 5, h)::INT AS y1e, x0c, x1c, greatest(x0c - 5, 0)::INT AS x0e, least(x1c + 5, w)::INT AS x1e,
  (y0c - greatest(y0c - 5, 0))::INT AS ov_top, (least(y1c + 5, h) - y1c)::INT AS ov_bot,
  (x0c - greatest(x0c - 5, 0))::INT AS ov_left, (least(x1c + 5, w) - x1c)::INT AS ov_right FROM b""")
def _r16b(spark, sf):
    return tl.tile_table(_grids(spark, sf), 5)


TILES = with_sql("cells_wk") + """,
d AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM cells_wk),
a AS (SELECT iy, ix, h, w, round_even(iy * (h / 2), 0)::INT AS y0, round_even((iy + 1) * (h / 2), 0)::INT AS y1,
  round_even(ix * (w / 5), 0)::INT AS x0, round_even((ix + 1) * (w / 5), 0)::INT AS x1
  FROM d, (SELECT unnest(range(2))::INT AS iy), (SELECT unnest(range(5))::INT AS ix)),
ti AS (SELECT iy, ix, greatest(y0 - 3, 0) AS y0, least(y1 + 3, h) AS y1, greatest(x0 - 3, 0) AS x0, least(x1 + 3, w) AS x1,
  y0 - greatest(y0 - 3, 0) AS ot, least(y1 + 3, h) - y1 AS ob, x0 - greatest(x0 - 3, 0) AS ol, least(x1 + 3, w) - x1 AS rr FROM a)"""


def _wk_grid(spark, sf):
    return extents(fx.cells_wk(spark, sf)).select(
        "img", F.col("ny").alias("h"), F.col("nx").alias("w"), F.lit(2).alias("ny"), F.lit(5).alias("nx"))


@query("j6_assign_halo", TILES + """
SELECT iy, ix, y, x, v FROM cells_wk JOIN ti ON y >= ti.y0 - 4 AND y < ti.y1 + 4 AND x >= ti.x0 - 4 AND x < ti.x1 + 4""")
def _j6(spark, sf):
    return tl.assign_halo(fx.cells_wk(spark, sf), _wk_grid(spark, sf), 3, 4).select("iy", "ix", "y", "x", "v")


@query("a25_blend_tiles", TILES + """,
p AS (SELECT y, x, v * (1 + ix / 10) AS v,
  CASE WHEN y < y0 + ot THEN (y - y0 + 1) / ot ELSE 1 END * CASE WHEN y >= y1 - ob THEN (y1 - y) / ob ELSE 1 END
  * CASE WHEN x < x0 + ol THEN (x - x0 + 1) / ol ELSE 1 END * CASE WHEN x >= x1 - rr THEN (x1 - x) / rr ELSE 1 END AS w
  FROM cells_wk JOIN ti ON y >= y0 AND y < y1 AND x >= x0 AND x < x1)
SELECT y, x, round(greatest(sum(w * v) / greatest(sum(w), 1e-12), 0), 6) AS v FROM p GROUP BY y, x""")
def _a25(spark, sf):
    g = _wk_grid(spark, sf)
    parts = tl.assign_halo(fx.cells_wk(spark, sf), g, 3, 4).withColumn("v", F.col("v") * (1 + F.col("ix") / 10))
    parts = parts.select("img", "t", "c", "z", "y", "x", "v", "iy", "ix")
    return tl.blend_tiles(parts, g, 3).select("y", "x", rnd("v").alias("v"))


def taps_block(taps):
    """Taps as a dense odd block, the form tiles work with."""
    half = [max(abs(t[i]) for t in taps) for i in range(3)]
    out = np.zeros([2 * h + 1 for h in half])
    for t in taps:
        out[tuple(t[i] + half[i] for i in range(3))] += t[3]
    return out


@query("r17_restore_one_tile", rl_sql("cells_ev", K35, 3) + result_sql(3))
def _r17(spark, sf):
    """A one-tile grid must give the same cells as the column plan."""
    cells = fx.cells_ev(spark, sf)
    one = extents(cells).select("img", F.col("ny").alias("h"), F.col("nx").alias("w"), F.lit(1).alias("ny"), F.lit(1).alias("nx"))
    return _cells(td.restore_tiled(cells, taps_block(K35), one, niter=3).cells)


@query("r17_restore_tiled_tv", tv_rl_sql("cells_ev", K35, 3, 0.05))
def _r17b(spark, sf):
    cells = fx.cells_ev(spark, sf)
    one = extents(cells).select("img", F.col("ny").alias("h"), F.col("nx").alias("w"), F.lit(1).alias("ny"), F.lit(1).alias("nx"))
    return _cells(td.restore_tiled(cells, taps_block(K35), one, tv_lambda=0.05, niter=3).cells)


@query("r17_restore_tiled_sparse", sparse_rl_sql("cells_ev", K35, 3, 0.6, 0.9))
def _r17c(spark, sf):
    cells = fx.cells_ev(spark, sf)
    one = extents(cells).select("img", F.col("ny").alias("h"), F.col("nx").alias("w"), F.lit(1).alias("ny"), F.lit(1).alias("nx"))
    return _cells(td.restore_tiled(cells, taps_block(K35), one, sparse=(0.6, 0.9), niter=3).cells)


def tiles_sql(niter: int, overlap: int = 2, margin: int = 16) -> str:
    """Every tile of the week grid as an image of its own, then the blend."""
    ext = lambda a, n: f"""greatest({a}0 - {overlap}, 0) AS {a}0, least({a}1 + {overlap}, {n}) AS {a}1,
  {a}0 - greatest({a}0 - {overlap}, 0) AS {a}b, least({a}1 + {overlap}, {n}) - {a}1 AS {a}a, {n}"""
    core = TILES[: TILES.index("ti AS")]
    tiles = f"""{core}ti AS (SELECT iy || '#' || ix AS img, {ext('y', 'h')}, {ext('x', 'w')} FROM a),
tm AS (SELECT *, greatest(y0 - {margin}, 0) AS ym, greatest(x0 - {margin}, 0) AS xm FROM ti),
cells_tl AS (SELECT tm.img, 0 AS t, 0 AS c, 0 AS z, y - ym AS y, x - xm AS x, v FROM cells_wk JOIN tm
  ON y >= ym AND y < y1 + {margin} AND x >= xm AND x < x1 + {margin})"""
    sql = start_sql("cells_tl", K35, before=tiles + LOW("cells_tl", 0.1))
    for k in range(1, niter + 1):
        sql += data_sql(k, "coalesce(corr, 0)") + f""",
s{k} AS MATERIALIZED (SELECT img, c, z, y, x, w, bg, d, xc AS xp, greatest(v, bg) AS xc FROM u{k})"""
    ramp = lambda a: (f"CASE WHEN {a} < {a}0 + {a}b THEN ({a} - {a}0 + 1) / {a}b ELSE 1 END"
                      f" * CASE WHEN {a} >= {a}1 - {a}a THEN ({a}1 - {a}) / {a}a ELSE 1 END")
    return sql + f""",
back AS (SELECT tm.*, s.y + ym AS y, s.x + xm AS x, greatest(xc - 5, 0) AS v FROM s{niter} s JOIN tm USING (img) WHERE d IS NOT NULL),
bl AS (SELECT y, x, v, {ramp('y')} * {ramp('x')} AS w FROM back WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1)
SELECT 'li' AS img, 0 AS c, 0 AS z, y, x, round(greatest(sum(w * v) / greatest(sum(w), 1e-12), 0), 6) AS v FROM bl GROUP BY y, x"""


@query("r17_restore_tiled", tiles_sql(10))
def _r17d(spark, sf):
    cells = fx.cells_wk(spark, sf)
    return _cells(td.restore_tiled(cells, taps_block(K35), _wk_grid(spark, sf), niter=10).cells)


def _kernel_table(spark, taps, **more):
    """Taps as a kernel table with constant group columns."""
    df = spark.createDataFrame(list(taps), "dz int, dy int, dx int, w double")
    return df.withColumns({k: F.lit(v).cast("int") for k, v in more.items()})


@query("r17_restore_tiles", tiles_sql(3))
def _r17e(spark, sf):
    """Tiles as images of their own, in blocks."""
    r = rt.restore_tiles(fx.cells_wk(spark, sf), _kernel_table(spark, K35), _wk_grid(spark, sf), niter=3, dense_block=64)
    return _cells(r.cells)


#: an asymmetric kernel for the channels from the second on
K22 = separable([1.0], [0.5, 1.0], [0.25, 1.0, 0.5])


def channels_sql(fixture: str, first: str, rest: str, where: str = "c = 0") -> str:
    """Rows of ``first`` for the first channel and of ``rest`` for the others."""
    return f"SELECT * FROM ({first}) WHERE {where} UNION ALL SELECT * FROM ({rest}) WHERE NOT ({where})"


@query("r11_per_channel", channels_sql(
    "cells_ev", rl_sql("cells_ev", K35, 3, bg="SELECT DISTINCT img, c, 0.25 AS bg FROM cells_ev") + result_sql(3),
    rl_sql("cells_ev", K22, 3, bg="SELECT DISTINCT img, c, 0.5 AS bg FROM cells_ev", offset=2.0) + result_sql(3, 2.0)))
def _r11e(spark, sf):
    """A kernel, a background and an offset of its own for each channel."""
    kernels = _kernel_table(spark, K35, c=0)
    for c in range(1, 5):
        kernels = kernels.unionByName(_kernel_table(spark, K22, c=c))
    params = spark.createDataFrame([(0, 0.25, None)] + [(c, 0.5, 2.0) for c in range(1, 5)], "c int, background double, offset double")
    return _cells(keyed.restore_each(fx.cells_ev(spark, sf), kernels, ["c"], params, niter=3, dense_block=16).cells)


@query("r14_retired_images", channels_sql(
    "cells_ev", rl_sql("cells_ev", K35, 2) + result_sql(2), rl_sql("cells_ev", K35, 4) + result_sql(4), "c < 2"))
def _r14c(spark, sf):
    """Channels that end at different updates: finished ones leave the working set."""
    params = spark.createDataFrame([(c, 2 if c < 2 else 4) for c in range(5)], "c int, niter int")
    kernels = _kernel_table(spark, K35, c=0)
    for c in range(1, 5):
        kernels = kernels.unionByName(_kernel_table(spark, K35, c=c))
    return _cells(keyed.restore_each(fx.cells_ev(spark, sf), kernels, ["c"], params, dense_block=32).cells)


@query("r15_preset_background", with_sql("cells_evs") + ", " + filter_sql("cells_evs", "f1", "y", [1 / 7] * 7) + ", "
       + filter_sql("f1", "f2", "x", [1 / 7] * 7) + LOW("f2", 0.01) + """,
lb AS (SELECT img, c, quantile_disc(v, 0.5) AS l FROM low GROUP BY img, c)""" + LOW("cells_evs", 0.1)
       .replace("rk AS", "rk2 AS").replace("FROM rk", "FROM rk2").replace("low AS", "low2 AS") + """,
gb AS (SELECT img, c, quantile_disc(v, 0.5) AS g FROM low2 GROUP BY img, c)
SELECT img, c, round(greatest(least(l, g) * 1.1, 1e-6), 6) AS background FROM lb JOIN gb USING (img, c)""")
def _r15a(spark, sf):
    b = rs.preset_background(fx.cells_evs(spark, sf), 3, rs.PRESETS["conservative"][2])
    return b.select("img", "c", rnd("background").alias("background"))


#: a 21 x 5 x 5 blur, as weights by axis
WZ, WG = [math.exp(-0.5 * (i / 4) ** 2) for i in range(-10, 11)], [math.exp(-0.5 * i * i) for i in range(-2, 3)]


def _flat_taps():
    """The blur summed over z: the weights of z are a factor of a separable kernel, whatever its support."""
    return separable([1.0], WG, WG)


def _preset_sql() -> str:
    both = with_sql("cells_ev") + ", " + filter_sql("cells_ev", "f1", "y", [1 / 7] * 7) + ", " + filter_sql("f1", "f2", "x", [1 / 7] * 7)
    renamed = lambda sql, n: sql.replace("rk AS", f"rk{n} AS").replace("FROM rk", f"FROM rk{n}").replace("low AS", f"low{n} AS")
    before = both + renamed(LOW("f2", 0.01), 3) + LOW("cells_ev", 0.1)
    bg = f"""SELECT img, c, least(l, g) * {rs.PRESETS['conservative'][2]} AS bg FROM
  (SELECT img, c, quantile_disc(v, 0.5) AS l FROM low3 GROUP BY img, c) JOIN
  (SELECT img, c, quantile_disc(v, 0.5) AS g FROM low GROUP BY img, c) USING (img, c)"""
    sql = start_sql("cells_ev", _flat_taps(), 2.5, bg=bg, before=before) + SIGMA.replace("cells_evs", "cells_ev")
    damp = DAMP.replace("greatest(3.0 *", "greatest(2.0 *")
    for k in (1, 2, 3):
        sql += data_sql(k, damp) + f""",
s{k} AS MATERIALIZED (SELECT img, c, z, y, x, w, bg, d, xc AS xp, greatest(v, bg) AS xc FROM u{k})"""
    return sql + result_sql(3, 2.5)


@query("r15_restore_2d_preset", _preset_sql())
def _r15(spark, sf):
    cells = fx.cells_ev(spark, sf)
    k3 = spark.createDataFrame([("k", *t) for t in separable(WZ, WG, WG)], "kid string, dz int, dy int, dx int, w double")
    return _cells(rs.restore_2d_preset(cells, k3, "conservative", 3, niter=3, track=False).cells)


@query("r18_restore_dispatch", tv_rl_sql("cells_ev", K35, 3, 0.05))
def _r18(spark, sf):
    # the sparse-Hessian weight belongs to another method and is dropped
    r = bt.restore_dispatch(fx.cells_ev(spark, sf), K35, "rl_tv", shape=(1, 24, 30), tv_lambda=0.05, weight=0.3, niter=3, track=False)
    return _cells(r.cells)


@query("r19_restore_series", rl_sql("cells_ti", K35, 3) + """
SELECT img, c, z, y, x, round(greatest(xc - 5, 0), 6) AS v FROM s3 WHERE d IS NOT NULL AND c = 0
UNION ALL SELECT img, c, z, y, x, round(greatest(xc - 5, 0), 6) FROM s2 WHERE d IS NOT NULL AND c > 0""")
def _r19(spark, sf):
    r = bt.restore_series(fx.cells_t(spark, sf), K35, "rl", [3, 2], track=False)
    return _cells(r.withColumn("img", F.concat_ws("#", "img", F.col("t").cast("string"))))


@query("r19_restore_plate", rl_sql("cells_pl", K35, 2) + result_sql(2))
def _r19b(spark, sf):
    cells = fx.cells_ev(spark, sf)
    cells = cells.withColumn("img", F.concat("img", F.lit("/A/1/"), F.col("c"))).withColumn("c", F.lit(0))
    fields = fx.channels(spark, sf).select(
        F.col("img").alias("plate"), F.lit("A").alias("row"), F.lit("1").alias("col"), F.col("c").cast("string").alias("field"))
    return _cells(bt.restore_plate(fields, cells, K35, "rl", niter=2, track=False))


@query("r20_benchmark_methods")
def _r20(spark, sf):
    return bt.benchmark_methods(spark, fx.cells_ev(spark, sf), K35, niter=2, volume=False, track=False)


def _routed_sql() -> str:
    """The week grid in tiles, event grids whole, and strips of two columns with the kernel cut to them."""
    cut = bt.crop_taps(K35, (1, 24, 2))
    cut = [(*t[:3], t[3] / sum(u[3] for u in cut)) for t in cut]
    strips = rl_sql("cells_ti", cut, 3) + result_sql(3)
    return f"""SELECT * FROM ({tiles_sql(3)}) UNION ALL SELECT * FROM ({rl_sql('cells_ev', K35, 3) + result_sql(3)})
UNION ALL SELECT * FROM ({strips}) WHERE img LIKE '%#4'"""


@query("r18_restore_routed", _routed_sql())
def _r18b(spark, sf):
    """Images above and below the tile limit, and smaller than the kernel, in one call."""
    strips = fx.cells_t(spark, sf).filter("t = 4").withColumn("img", F.concat_ws("#", "img", F.col("t").cast("string"))).withColumn("t", F.lit(0))
    wk = fx.cells_wk(spark, sf)
    side = extents(wk).agg(F.max("nx")).first()[0]
    cells = wk.unionByName(fx.cells_ev(spark, sf)).unionByName(strips)
    large = _wk_grid(spark, sf).select("img", "h", "w", "ny", "nx")
    r = rt.restore_routed(cells, _kernel_table(spark, K35), tile_side=side - 1, grids=large, niter=3, dense_block=64)
    return _cells(r.cells)


@query("r19_plate_per_channel", channels_sql(
    "cells_pl", rl_sql("cells_pl", K35, 2) + result_sql(2), rl_sql("cells_pl", K22, 3) + result_sql(3), "img LIKE '%/0'"))
def _r19c(spark, sf):
    """Fields of plates, each with the kernel and the iterations that belong to it."""
    cells = fx.cells_ev(spark, sf)
    cells = cells.withColumn("img", F.concat("img", F.lit("/A/1/"), F.col("c"))).withColumn("c", F.lit(0))
    fields = fx.channels(spark, sf).select(
        F.col("img").alias("plate"), F.lit("A").alias("row"), F.lit("1").alias("col"), F.col("c").cast("string").alias("field"))
    names = fields.select(F.concat_ws("/", "plate", "row", "col", "field").alias("img"), (F.col("field") == "0").alias("first"))
    both = _kernel_table(spark, K35).withColumn("first", F.lit(True)).unionByName(_kernel_table(spark, K22).withColumn("first", F.lit(False)))
    params = names.select("img", F.when(F.col("first"), 2).otherwise(3).alias("niter"))
    return _cells(rt.restore_fields(fields, cells, names.join(both, "first").drop("first"), ["img"], params, dense_block=32))
