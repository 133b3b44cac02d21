from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.catalog.statistics import LOW
from sparkgrid.core import rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.operators import stencil as st
from sparkgrid.operators.neighbors import stencil


def grad_sql(fixture: str) -> str:
    """Gradient norm per cell by lag and lead along each axis."""
    rest = {"z": "y, x", "y": "z, x", "x": "z, y"}
    cols = []
    for a, other in rest.items():
        w = f"OVER (PARTITION BY img, t, c, {other} ORDER BY {a})"
        cols.append(f"coalesce((lead(v) {w} - lag(v) {w}) / 2, lead(v) {w} - v, v - lag(v) {w}, 0) AS g{a}")
    return f"gr AS (SELECT img, c, {', '.join(cols)} FROM {fixture})"


@query("w1_edge_strength", with_sql("cells_stack") + ", " + grad_sql("cells_stack") + """
SELECT img, c, round(avg(sqrt(gz * gz + gy * gy + gx * gx)), 6) AS edge_strength FROM gr GROUP BY img, c""")
def _w1(spark, sf):
    e = st.edge_strength(fx.cells_stack(spark, sf))
    return e.select("img", "c", rnd("edge_strength").alias("edge_strength"))


@query("w2_axis_diff", with_sql("cells_stack") + """
SELECT c, z, y, x, round(coalesce(v - lag(v) OVER (PARTITION BY c, y, x ORDER BY z), 0) * 0.325, 6) AS v FROM cells_stack""")
def _w2(spark, sf):
    return st.axis_diff(fx.cells_stack(spark, sf), "z", 0.325).select("c", "z", "y", "x", rnd("v").alias("v"))


def tv_sql(src: str, lam: float, scales: dict[str, float], tag: str = "", pos=("z", "y", "x"), keep: str = "") -> str:
    """CTEs ``tvf{tag}`` with the factor; ``pos`` names the position columns."""
    part = {a: "img, c, " + ", ".join(b for b in pos if b != a) for a in pos}
    g = ", ".join(f"coalesce(v - lag(v) OVER (PARTITION BY {part[a]} ORDER BY {a}), 0) * {scales[n]} AS g{n}"
                  for n, a in zip("zyx", pos))
    nrm = ", ".join(f"g{n} / sqrt(gz * gz + gy * gy + gx * gx + 1e-8) AS n{n}" for n in "zyx")
    div = " + ".join(f"coalesce(n{n} - lead(n{n}) OVER (PARTITION BY {part[a]} ORDER BY {a}), 0) * {scales[n]}"
                     for n, a in zip("zyx", pos))
    return (f"tvg{tag} AS (SELECT *, {g} FROM {src}), tvn{tag} AS (SELECT *, {nrm} FROM tvg{tag}), "
            f"tvf{tag} AS (SELECT *, least(greatest(1 / (1 - {lam} * ({div})), 0.1), 10) AS factor FROM tvn{tag})")


@query("w3_tv_factor", with_sql("cells_stack") + ", " + tv_sql("cells_stack", 0.1, {"z": 0.5, "y": 1.0, "x": 1.0})
       + " SELECT c, z, y, x, round(factor, 6) AS factor FROM tvf")
def _w3(spark, sf):
    f = st.tv_factor(fx.cells_stack(spark, sf), 0.1, st.axis_scales(1.0, 2.0))
    return f.select("c", "z", "y", "x", rnd("factor").alias("factor"))


def hess_sql(src: str, zs: float, volume: bool) -> str:
    """CTE ``he``: second differences by lag and lead over a dense grid."""
    over = {"z": "y, x", "y": "z, x", "x": "z, y"}
    win = lambda f, col, a: f"{f}({col}) OVER (PARTITION BY img, c, {over[a]} ORDER BY {a})"
    axes = "zyx" if volume else "yx"
    one = ", ".join(f"{win('lead', 'v', a)} AS p{a}, {win('lag', 'v', a)} AS m{a}" for a in axes)
    two = [f"{win('lead', 'px', 'y')} AS pyx"]
    if volume:
        two += [f"{win('lead', 'px', 'z')} AS pzx", f"{win('lead', 'py', 'z')} AS pzy"]
    z = (f"{zs} * {zs} * (2 * v - pz - mz) AS dzz, {zs} * (pzx - pz - px + v) AS dxz, "
         f"{zs} * (pzy - pz - py + v) AS dyz") if volume else "0.0 AS dzz, 0.0 AS dxz, 0.0 AS dyz"
    inside = " AND ".join(f"p{a} IS NOT NULL AND m{a} IS NOT NULL" for a in axes)
    return (f"he AS (SELECT img, c, z, y, x, v, 2 * v - px - mx AS dxx, 2 * v - py - my AS dyy, pyx - py - px + v AS dxy, {z} "
            f"FROM (SELECT *, {', '.join(two)} FROM (SELECT img, c, z, y, x, v, {one} FROM {src})) WHERE {inside})")


def pen_sql(w: float) -> str:
    return (f"sqrt({w * w} * (dxx * dxx + dyy * dyy + dzz * dzz + 2 * (dxy * dxy + dxz * dxz + dyz * dyz)) "
            f"+ {(1 - w) ** 2} * v * v + 1e-8)")


def grad_pen_sql(src: str, w: float, zs: float, volume: bool, tag: str = "") -> str:
    """CTE ``hg{tag}``: gradient of the mean penalty at every cell of ``src``."""
    give = {(0, 0, 0): "2 * hxx + 2 * hyy + 2 * hzz + hxy + hxz + hyz + own", (0, 0, 1): "-hxx - hxy - hxz",
            (0, 0, -1): "-hxx", (0, 1, 0): "-hyy - hxy - hyz", (0, -1, 0): "-hyy", (0, 1, 1): "hxy"}
    if volume:
        give |= {(1, 0, 0): "-hzz - hxz - hyz", (-1, 0, 0): "-hzz", (1, 0, 1): "hxz", (1, 1, 0): "hyz"}
    w2 = w * w
    parts = (f"{w2} * dxx / f AS hxx, {w2} * dyy / f AS hyy, {w2} * {zs} * {zs} * dzz / f AS hzz, 2 * {w2} * dxy / f AS hxy, "
             f"2 * {w2} * {zs} * dxz / f AS hxz, 2 * {w2} * {zs} * dyz / f AS hyz, {(1 - w) ** 2} * v / f AS own")
    sends = " UNION ALL ".join(
        f"SELECT img, c, z + {o[0]} AS z, y + {o[1]} AS y, x + {o[2]} AS x, {e} AS g FROM hp{tag}" for o, e in give.items())
    he = hess_sql(src, zs, volume).replace("he AS", f"he{tag} AS")
    return (f"{he}, hf{tag} AS (SELECT *, {pen_sql(w)} * count(*) OVER (PARTITION BY img, c) AS f FROM he{tag}), "
            f"hp{tag} AS MATERIALIZED (SELECT img, c, z, y, x, {parts} FROM hf{tag}), hs{tag} AS ({sends}), "
            f"hg{tag} AS (SELECT s.img, s.c, s.z, s.y, s.x, coalesce(q.g, 0) AS g FROM {src} s LEFT JOIN "
            f"(SELECT img, c, z, y, x, sum(g) AS g FROM hs{tag} GROUP BY ALL) q USING (img, c, z, y, x))")


H = ["dxx", "dyy", "dzz", "dxy", "dxz", "dyz"]


@query("w4_hessian", with_sql("cells_stack") + ", " + hess_sql("cells_stack", 0.5, True)
       + f" SELECT c, z, y, x, {', '.join(f'round({h}, 6) AS {h}' for h in H)} FROM he")
def _w4(spark, sf):
    h = st.hessian(fx.cells_stack(spark, sf), 0.5)
    return h.select("c", "z", "y", "x", *[rnd(n).alias(n) for n in H])


@query("w5_sparse_hessian_penalty", with_sql("cells_evs") + ", " + hess_sql("cells_evs", 1.0, False)
       + f" SELECT img, c, round(avg({pen_sql(0.6)}), 6) AS penalty FROM he GROUP BY img, c")
def _w5(spark, sf):
    p = st.sparse_hessian_penalty(fx.cells_evs(spark, sf), 0.6)
    return p.select("img", "c", rnd("penalty").alias("penalty"))


@query("w6_sparse_hessian_gradient", with_sql("cells_evs") + ", " + grad_pen_sql("cells_evs", 0.6, 1.0, False)
       + " SELECT img, c, y, x, round(g, 8) AS g FROM hg")
def _w6(spark, sf):
    g = st.sparse_hessian_gradient(fx.cells_evs(spark, sf), 0.6, volume=False)
    return g.select("img", "c", "y", "x", rnd("g", 8).alias("g"))


@query("w6_sparse_hessian_gradient_3d", with_sql("cells_stack") + ", " + grad_pen_sql("cells_stack", 0.6, 0.5, True)
       + " SELECT c, z, y, x, round(g, 8) AS g FROM hg")
def _w6b(spark, sf):
    g = st.sparse_hessian_gradient(fx.cells_stack(spark, sf), 0.6, 0.5)
    return g.select("c", "z", "y", "x", rnd("g", 8).alias("g"))


def filter_sql(src: str, out: str, axis: str, weights: list[float]) -> str:
    """CTE ``out``: gather form of a mirrored 1-D filter."""
    r = len(weights) // 2
    vals = ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(weights))
    at = f"s.{axis} + k.o"
    pos = f"CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > s.n - 1 THEN 2 * (s.n - 1) - ({at}) ELSE {at} END"
    same = " AND ".join(f"q.{a} = s.{a}" for a in ("img", "c", "z", "y", "x") if a != axis)
    return (f"{out} AS MATERIALIZED (SELECT s.img, s.c, s.z, s.y, s.x, sum(q.v * k.w) AS v FROM "
            f"(SELECT img, c, z, y, x, max({axis}) OVER (PARTITION BY img, c) + 1 AS n FROM {src}) s "
            f"CROSS JOIN (VALUES {vals}) k(o, w) JOIN {src} q ON {same} AND q.{axis} = {pos} GROUP BY ALL)")


GW = st.gaussian_weights(1.2)


@query("w7_gaussian_smooth", with_sql("cells_evs") + ", " + filter_sql("cells_evs", "f1", "y", GW) + ", "
       + filter_sql("f1", "f2", "x", GW) + " SELECT img, c, y, x, round(v, 6) AS v FROM f2")
def _w7(spark, sf):
    return st.gaussian_smooth(fx.cells_evs(spark, sf), 1.2).select("img", "c", "y", "x", rnd("v").alias("v"))


@query("w7_gaussian_smooth_ragged", with_sql("cells_emb") + """,
emb AS (SELECT img, c, z, x, v, (dense_rank() OVER (PARTITION BY c ORDER BY y) - 1)::INT AS y FROM cells_emb), """
       + filter_sql("emb", "f1", "y", GW) + ", "
       + filter_sql("f1", "f2", "x", GW) + " SELECT c, y, x, round(v, 6) AS v FROM f2")
def _w7c(spark, sf):
    """Channels of different height are smoothed inside their own borders."""
    e = fx.table(spark, sf, "embeddings")
    place = e.select("vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("_y"))
    cells = fx.cells_emb(spark, sf).join(place, F.col("y") == F.col("vec_id")).withColumn("y", F.col("_y")).drop("_y", "vec_id")
    return st.gaussian_smooth(cells, 1.2).select("c", "y", "x", rnd("v").alias("v"))


@query("w7_gaussian_smooth_3d", with_sql("cells_stack") + ", " + filter_sql("cells_stack", "f0", "z", GW) + ", "
       + filter_sql("f0", "f1", "y", GW) + ", " + filter_sql("f1", "f2", "x", GW)
       + " SELECT c, z, y, x, round(v, 6) AS v FROM f2")
def _w7b(spark, sf):
    s = st.gaussian_smooth(fx.cells_stack(spark, sf), 1.2)
    return s.select("c", "z", "y", "x", rnd("v").alias("v"))


B3 = [1 / 7] * 7
BOX = ", " + filter_sql("cells_evs", "f1", "y", B3) + ", " + filter_sql("f1", "f2", "x", B3)


@query("w8_box_mean", with_sql("cells_evs") + BOX + " SELECT img, c, y, x, round(v, 6) AS v FROM f2")
def _w8(spark, sf):
    return st.box_mean(fx.cells_evs(spark, sf), 3).select("img", "c", "y", "x", rnd("v").alias("v"))


@query("a7_local_background", with_sql("cells_evs") + BOX + LOW("f2", 0.01)
       + " SELECT img, c, round(quantile_disc(v, 0.5), 6) AS background FROM low GROUP BY img, c")
def _a7(spark, sf):
    b = st.local_background(fx.cells_evs(spark, sf), 3)
    return b.select("img", "c", rnd("background").alias("background"))


@query("w9_anscombe_prefilter", with_sql("cells_evs")
       + ", up AS (SELECT img, c, z, y, x, 2 * sqrt(greatest(v, 0) + 0.375) AS v FROM cells_evs), "
       + filter_sql("up", "f1", "y", st.gaussian_weights(0.7)) + ", " + filter_sql("f1", "f2", "x", st.gaussian_weights(0.7))
       + " SELECT img, c, y, x, round(greatest((v / 2) * (v / 2) - 0.375, 0), 6) AS v FROM f2")
def _w9(spark, sf):
    return st.anscombe_prefilter(fx.cells_evs(spark, sf), 0.7).select("img", "c", "y", "x", rnd("v").alias("v"))


@query("j9_stencil", with_sql("cells_li") + """
SELECT a.y, a.x, a.v, b.v AS east, d.v AS diagonal FROM cells_li a
LEFT JOIN cells_li b ON b.y = a.y AND b.x = a.x + 1 LEFT JOIN cells_li d ON d.y = a.y + 1 AND d.x = a.x + 1""")
def _j9(spark, sf):
    n = stencil(fx.cells_li(spark, sf), {"east": (0, 0, 1), "diagonal": (0, 1, 1)})
    return n.select("y", "x", "v", "east", "diagonal")
