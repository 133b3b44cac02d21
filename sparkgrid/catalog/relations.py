from __future__ import annotations

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.core import rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.operators import relate, shape, stats
from sparkgrid.sources.cells import densify


@query("p12_strided_sample", with_sql("cells_wk") + """,
d AS (SELECT greatest(ceil((max(y) + 1) / 32.0), 1)::INT AS sy, greatest(ceil((max(x) + 1) / 32.0), 1)::INT AS sx FROM cells_wk)
SELECT (y // sy)::INT AS y, (x // sx)::INT AS x, v FROM cells_wk, d WHERE y % sy = 0 AND x % sx = 0""")
def _p12(spark, sf):
    return shape.strided_sample(fx.cells_wk(spark, sf), 8, 32).select("y", "x", "v")


@query("p13_center_crop", with_sql("cells_stack") + """,
d AS (SELECT max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM cells_stack),
o AS (SELECT *, (nz - least(nz, 4)) // 2 AS z0, (ny - least(ny, 5)) // 2 AS y0, (nx - least(nx, 16)) // 2 AS x0 FROM d)
SELECT c, (z - z0)::INT AS z, (y - y0)::INT AS y, (x - x0)::INT AS x, v FROM cells_stack, o
WHERE z >= z0 AND z < z0 + least(nz, 4) AND y >= y0 AND y < y0 + least(ny, 5) AND x >= x0 AND x < x0 + least(nx, 16)""")
def _p13(spark, sf):
    return shape.center_crop(fx.cells_stack(spark, sf), 4, 5, 16).select("c", "z", "y", "x", "v")


@query("p14_select_plane", with_sql("cells_t") + """
SELECT img, t, c, y, x, v FROM cells_t WHERE t = 4 AND z = 0""")
def _p14(spark, sf):
    return shape.select_plane(fx.cells_t(spark, sf), t=99, z=-3).select("img", "t", "c", "y", "x", "v")


@query("j1_with_channel_meta", with_sql("cells_ev", "channels") + """
SELECT s.img, s.c, y, x, round(v * coalesce(emission, 520), 4) AS v, name FROM cells_ev s JOIN channels USING (img, c)""")
def _j1(spark, sf):
    j = relate.with_channel_meta(fx.cells_ev(spark, sf), fx.channels(spark, sf))
    return j.select("img", "c", "y", "x", rnd(F.col("v") * F.coalesce("emission", F.lit(520.0)), 4).alias("v"), "name")


@query("j2_pair_panes", with_sql("cells_ev", "cells_evs") + """
SELECT img, c, y, x, a.v AS src, b.v AS res FROM cells_ev a JOIN cells_evs b USING (img, t, c, z, y, x)""")
def _j2(spark, sf):
    return stats.pair_panes(fx.cells_ev(spark, sf), fx.cells_evs(spark, sf)).select("img", "c", "y", "x", "src", "res")


@query("j3_densify", with_sql("cells_li") + """,
b AS (SELECT y, x FROM (SELECT unnest(range(-2, (SELECT max(y) + 3 FROM cells_li)))::INT AS y),
  (SELECT unnest(range(-1, (SELECT max(x) + 2 FROM cells_li)))::INT AS x))
SELECT b.y, b.x, coalesce(v, 1.5) AS v FROM b LEFT JOIN cells_li USING (y, x)""")
def _j3(spark, sf):
    cells = fx.cells_li(spark, sf)
    groups = cells.groupBy("img", "t", "c").agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    box = {"z": (F.lit(0), F.lit(0)), "y": (F.lit(-2), F.col("my") + 2), "x": (F.lit(-1), F.col("mx") + 1)}
    return densify(cells, groups, box, 1.5).select("y", "x", "v")


def _results(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("img"), F.col("o_orderpriority").alias("method"),
                    (F.year("o_orderdate") - 1990).alias("iters"))


@query("j7_comparison_matrix", """
SELECT o_custkey AS img, o_orderpriority AS method, (year(o_orderdate) - 1990)::INT AS iters,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS grid_row,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS grid_col
FROM (SELECT DISTINCT o_custkey, o_orderpriority, year(o_orderdate) - 1990 + 1990 AS y, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1, 2, 3)""")
def _j7(spark, sf):
    return relate.comparison_matrix(_results(spark, sf)).select("img", "method", "iters", "grid_row", "grid_col")


def _done(spark, sf):
    inputs = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    best = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.max("o_totalprice").alias("best"))
    outputs = best.filter("best > 450000").select("name")
    return inputs, outputs


@query("j8_failed_items", """
SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 450000)""")
def _j8(spark, sf):
    return relate.failed_items(*_done(spark, sf))


@query("j8_exit_status", """
SELECT count(*) AS failed, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::INT AS status FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 450000)""")
def _j8b(spark, sf):
    return relate.exit_status(relate.failed_items(*_done(spark, sf)))


@query("k3_first_image", "SELECT lang, min(url) AS name FROM (SELECT url, substr(url, 8, 2) AS lang FROM pages) GROUP BY lang")
def _k3(spark, sf):
    p = fx.table(spark, sf, "pages").select(F.col("url").alias("name"), F.substring("url", 8, 2).alias("lang"))
    return relate.first_image(p, "name", ["lang"])


@query("k4_sorted_report", """
SELECT o_orderpriority AS label, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders GROUP BY 1 ORDER BY 1""")
def _k4(spark, sf):
    g = fx.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 3).alias("mean"))
    return relate.sorted_report(g, "label")


@query("u1_union_panes", with_sql("cells_ev", "cells_emb") + """
SELECT 'original' AS pane, img, c, y, x, v FROM cells_ev UNION ALL SELECT 'restored', img, c, y, x, v FROM cells_emb""")
def _u1(spark, sf):
    u = relate.union_panes(fx.cells_ev(spark, sf), fx.cells_emb(spark, sf))
    return u.select("pane", "img", "c", "y", "x", "v")


@query("u2_route_inputs", """
SELECT c_custkey AS name, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 450000)
  THEN 'plate' ELSE 'image' END AS kind FROM customer""")
def _u2(spark, sf):
    return relate.route_inputs(*_done(spark, sf))


@query("u3_dictionary_encode", with_sql("cells_wk") + """
SELECT y, x, v, dense_rank() OVER (PARTITION BY y ORDER BY v) - 1 AS code, round(exp(-v / 50), 8) AS val FROM cells_wk""")
def _u3(spark, sf):
    e = relate.dictionary_encode(
        fx.cells_wk(spark, sf), "v", lambda v: rnd(F.exp(-v / 50), 8), "val", keys=["img", "y"])
    return e.select("y", "x", "v", "code", "val")
