from __future__ import annotations

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.core import rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.operators import hist, rank, relate, shape, stats


@query("a1_array_stats", with_sql("cells_evs") + """
SELECT img, c, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
  round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.99), 6) AS p99,
  round(100.0 * count(*) FILTER (v <> 0) / count(*), 6) AS nonzero_percent
FROM cells_evs GROUP BY img, c""")
def _a1(spark, sf):
    s = stats.array_stats(fx.cells_evs(spark, sf))
    return s.select("img", "c", *[rnd(n).alias(n) for n in s.columns if n not in ("img", "t", "c")])


@query("a3_percentiles", with_sql("cells_emb") + """
SELECT c, round(quantile_cont(v, 0.005), 6) AS p_lo, round(quantile_cont(v, 0.995), 6) AS p_hi,
  round(quantile_cont(v, 0.995) - quantile_cont(v, 0.005), 6) AS robust_range
FROM cells_emb GROUP BY c""")
def _a3(spark, sf):
    r = rank.robust_range(fx.cells_emb(spark, sf))
    return r.select("c", *[rnd(n).alias(n) for n in ("p_lo", "p_hi", "robust_range")])


@query("a4_gini", with_sql("cells_evs") + """,
r AS (SELECT img, c, v, row_number() OVER (PARTITION BY img, c ORDER BY v) AS i FROM cells_evs)
SELECT img, c, round(CASE WHEN sum(v) > 1e-12
  THEN 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*) ELSE 0 END, 6) AS gini
FROM r GROUP BY img, c""")
def _a4(spark, sf):
    return rank.gini(fx.cells_evs(spark, sf)).select("img", "c", rnd("gini").alias("gini"))


LOW = lambda src, frac: f""",
rk AS (SELECT img, c, v, row_number() OVER (PARTITION BY img, c ORDER BY v) AS i,
  count(*) OVER (PARTITION BY img, c) AS n FROM {src}),
low AS (SELECT img, c, v, i, n FROM rk WHERE i <= greatest(floor(n * {frac}), 1))"""


@query("a2_normalize", with_sql("cells_evs") + """
SELECT img, c, y, x, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM (
  SELECT *, min(v) OVER (PARTITION BY img, c) AS lo, max(v) OVER (PARTITION BY img, c) AS hi FROM cells_evs)""")
def _a2(spark, sf):
    return stats.normalize(fx.cells_evs(spark, sf)).select("img", "c", "y", "x", rnd("v").alias("v"))


@query("k1_lowest_fraction", with_sql("cells_evs") + LOW("cells_evs", 0.25) + """
SELECT img, c, v, count(*) AS copies FROM low GROUP BY img, c, v""")
def _k1(spark, sf):
    return rank.lowest_fraction(fx.cells_evs(spark, sf), 0.25).select("img", "c", "v", "copies")


def _offset(spark, sf):
    """Many distinct values around a large offset: all in a few buckets."""
    return fx.table(spark, sf, "lineitem").select(
        F.lit("o").alias("img"), F.lit(0).alias("t"), (F.col("l_orderkey") % 3).cast("int").alias("c"),
        (F.lit(300.0) + F.col("l_extendedprice") / 1e7).alias("v"))


OFFSET = """WITH o AS (SELECT (l_orderkey % 3)::INT AS c, 300.0 + l_extendedprice / 1e7 AS v FROM lineitem)"""


@query("a3_percentiles_offset", OFFSET + """
SELECT c, round(quantile_cont(v, 0.005), 9) AS p_lo, round(quantile_cont(v, 0.5), 9) AS mid, round(quantile_cont(v, 0.995), 9) AS p_hi FROM o GROUP BY c""")
def _a3b(spark, sf):
    r = rank.percentiles(_offset(spark, sf), {"p_lo": 0.5, "mid": 50, "p_hi": 99.5})
    return r.select("c", *[rnd(n, 9).alias(n) for n in ("p_lo", "mid", "p_hi")])


@query("a4_gini_offset", OFFSET + """,
r AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS i FROM o)
SELECT c, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*), 8) AS gini FROM r GROUP BY c""")
def _a4b(spark, sf):
    return rank.gini(_offset(spark, sf)).select("c", rnd("gini", 8).alias("gini"))


@query("a5_background_level", with_sql("cells_evs") + LOW("cells_evs", 0.1) + """
SELECT img, c, quantile_disc(v, 0.5) AS background FROM low GROUP BY img, c""")
def _a5(spark, sf):
    return rank.background_level(fx.cells_evs(spark, sf)).select("img", "c", "background")


@query("a6_noise_sigma", with_sql("cells_evs") + LOW("cells_evs", 0.25) + """,
m AS (SELECT img, c, quantile_disc(v, 0.5) AS med FROM low GROUP BY img, c)
SELECT img, c, round(greatest(1.4826 * quantile_disc(abs(v - med), 0.5), 1e-12), 6) AS sigma
FROM low JOIN m USING (img, c) GROUP BY img, c""")
def _a6(spark, sf):
    return rank.noise_sigma(fx.cells_evs(spark, sf)).select("img", "c", rnd("sigma").alias("sigma"))


HIST = """,
lim AS (SELECT img, c, 0.0::DOUBLE AS lo, greatest(max(v), 1.0) AS hi FROM cells_evs GROUP BY img, c),
cnt AS (SELECT s.img, s.c, least(floor((s.v - lo) / (hi - lo) * 64), 63)::INT AS bin, count(*) AS k
  FROM cells_evs s JOIN lim USING (img, c) GROUP BY ALL),
h AS (SELECT l.img, l.c, b.bin, lo + (hi - lo) * b.bin / 64 AS lft, lo + (hi - lo) * (b.bin + 1) / 64 AS rgt,
  coalesce(k, 0)::BIGINT AS n FROM lim l, (SELECT unnest(range(64))::INT AS bin) b
  LEFT JOIN cnt ON cnt.img = l.img AND cnt.c = l.c AND cnt.bin = b.bin)"""


def _hist(spark, sf):
    cells = fx.cells_evs(spark, sf)
    return hist.histogram(cells, hist.pane_limits(cells, ["img", "c"]), 64, ["img", "c"])


@query("a8_histogram", with_sql("cells_evs") + HIST + "SELECT img, c, bin, n FROM h")
def _a8(spark, sf):
    return _hist(spark, sf).select("img", "c", "bin", "n")


HP = lambda p: f"""(SELECT img, c, min_by(CASE WHEN true THEN lft + ({p} * total - (cum - n)) / greatest(n, 1) * (rgt - lft) END, bin)
   FROM cu WHERE cum >= {p} * total GROUP BY img, c)"""


@query("a9_hist_percentile", with_sql("cells_evs") + HIST + f""",
cu AS (SELECT *, sum(n) OVER (PARTITION BY img, c ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY img, c) AS total FROM h)
SELECT a.img, a.c, round(a.q, 6) AS p05, round(b.q, 6) AS p98 FROM {HP(0.05)} a(img, c, q)
JOIN {HP(0.98)} b(img, c, q) ON a.img = b.img AND a.c = b.c""")
def _a9(spark, sf):
    p = hist.hist_percentile(_hist(spark, sf), {"p05": 5, "p98": 98}, ["img", "c"])
    return p.select("img", "c", rnd("p05").alias("p05"), rnd("p98").alias("p98"))


@query("a10_auto_levels", with_sql("cells_ev", "cells_evs") + f""",
panes AS (SELECT 'original' AS pane, * FROM cells_ev UNION ALL SELECT 'restored', * FROM cells_evs),
lim AS (SELECT pane, img, c, greatest(max(v), 0) AS top, greatest(max(v), 1.0) AS hi FROM panes GROUP BY ALL),
cnt AS (SELECT s.pane, s.img, s.c, least(floor(s.v / hi * 512), 511)::INT AS bin, count(*) AS n
  FROM panes s JOIN lim USING (pane, img, c) GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER w AS cum, sum(n) OVER (PARTITION BY pane, img, c) AS total FROM cnt
  WINDOW w AS (PARTITION BY pane, img, c ORDER BY bin)),
q AS (SELECT pane, img, c,
  min_by((bin + (0.01 * total - (cum - n)) / n), bin) FILTER (cum >= 0.01 * total) / 512 AS lo_p,
  min_by((bin + (0.998 * total - (cum - n)) / n), bin) FILTER (cum >= 0.998 * total) / 512 AS hi_p FROM cu GROUP BY ALL)
SELECT pane, img, c, round(greatest(lo_p * hi, 0), 5) AS min, round(least(greatest(hi_p, lo_p) * hi, top), 5) AS max
FROM q JOIN lim USING (pane, img, c)""")
def _a10(spark, sf):
    panes = relate.union_panes(fx.cells_ev(spark, sf), fx.cells_evs(spark, sf))
    lv = hist.auto_levels(panes)
    return lv.select("pane", "img", "c", rnd("min", 5).alias("min"), rnd("max", 5).alias("max"))


@query("a11_i_divergence", with_sql("cells_ev", "cells_evs") + """
SELECT a.img, a.c, round(avg(greatest(a.v, 1e-12) * ln(greatest(a.v, 1e-12) / greatest(b.v, 1e-12))
  - greatest(a.v, 1e-12) + greatest(b.v, 1e-12)), 6) AS i_divergence
FROM cells_ev a JOIN cells_evs b USING (img, t, c, z, y, x) GROUP BY a.img, a.c""")
def _a11(spark, sf):
    d = stats.i_divergence(stats.pair_panes(fx.cells_ev(spark, sf), fx.cells_evs(spark, sf)))
    return d.select("img", "c", rnd("i_divergence").alias("i_divergence"))


@query("a12_poisson_nll", with_sql("cells_ev", "cells_evs") + """
SELECT a.img, a.c, round(avg(greatest(b.v, 1e-12) - a.v * ln(greatest(b.v, 1e-12))), 6) AS poisson_nll
FROM cells_ev a JOIN cells_evs b USING (img, t, c, z, y, x) GROUP BY a.img, a.c""")
def _a12(spark, sf):
    d = stats.poisson_nll(stats.pair_panes(fx.cells_ev(spark, sf), fx.cells_evs(spark, sf)))
    return d.select("img", "c", rnd("poisson_nll").alias("poisson_nll"))


def _simple_metrics(cells):
    return cells.groupBy("img", "c").agg(F.avg("v").alias("mean"), F.max("v").alias("peak"))


@query("a14_metrics_rollup", with_sql("cells_evs") + """,
m AS (SELECT img, c, avg(v) AS mean, max(v) AS peak FROM cells_evs GROUP BY img, c)
SELECT img, c, 0::BIGINT AS gid, round(mean, 5) AS mean, round(peak, 5) AS peak FROM m
UNION ALL SELECT img, NULL, 1, round(avg(mean), 5), round(avg(peak), 5) FROM m GROUP BY img HAVING count(*) > 1""")
def _a14(spark, sf):
    r = stats.metrics_rollup(_simple_metrics(fx.cells_evs(spark, sf)), ["mean", "peak"])
    return r.select("img", "c", F.col("gid").cast("long").alias("gid"), rnd("mean", 5).alias("mean"), rnd("peak", 5).alias("peak"))


@query("a15_metric_change", with_sql("cells_ev", "cells_evs") + """,
a AS (UNPIVOT (SELECT img, c, avg(v) AS mean, max(v) AS peak FROM cells_ev GROUP BY img, c) ON mean, peak INTO NAME metric VALUE src),
b AS (UNPIVOT (SELECT img, c, avg(v) AS mean, max(v) AS peak FROM cells_evs GROUP BY img, c) ON mean, peak INTO NAME metric VALUE res)
SELECT img, c, metric, round(src, 5) AS src, round(res, 5) AS res,
  round(CASE WHEN abs(src) > 1e-12 THEN res / src ELSE res - src END, 5) AS change,
  CASE WHEN abs(src) > 1e-12 THEN 'ratio' ELSE 'difference' END AS kind FROM a JOIN b USING (img, c, metric)""")
def _a15(spark, sf):
    ch = stats.metric_change(
        _simple_metrics(fx.cells_ev(spark, sf)), _simple_metrics(fx.cells_evs(spark, sf)), ["mean", "peak"], ["img", "c"])
    return ch.select("img", "c", "metric", "kind", *[rnd(n, 5).alias(n) for n in ("src", "res", "change")])


@query("a16_telemetry_rollup", with_sql("telemetry") + """
SELECT proc, round(avg(value), 5) AS avg, round(max(value), 5) AS peak,
  round(max(value) - arg_min(value, (ts, value)), 5) AS delta, round(max(value) / 200 * 100, 5) AS percent,
  round(greatest(max(value) - arg_min(value, (ts, value)) - 200, 0), 5) AS spill FROM telemetry GROUP BY proc""")
def _a16(spark, sf):
    r = stats.telemetry_rollup(fx.telemetry(spark, sf), 200.0)
    return r.select("proc", *[rnd(n, 5).alias(n) for n in ("avg", "peak", "delta", "percent", "spill")])


@query("a18_channel_maxima", with_sql("cells_ev", "cells_emb") + """,
a AS (SELECT img, c, greatest(max(v), 0) AS o FROM cells_ev GROUP BY img, c),
b AS (SELECT img, c, greatest(max(v), 0) AS r FROM cells_emb GROUP BY img, c)
SELECT img, c, round(coalesce(o, 0), 6) AS original, round(coalesce(r, 0), 6) AS restored,
  round(greatest(coalesce(o, 0), coalesce(r, 0), 1), 6) AS shared FROM a FULL JOIN b USING (img, c)""")
def _a18(spark, sf):
    m = stats.channel_maxima(fx.cells_ev(spark, sf), fx.cells_emb(spark, sf))
    return m.select("img", "c", *[rnd(n).alias(n) for n in ("original", "restored", "shared")])


@query("a24_validate_shapes", with_sql("cells_emb") + """,
s AS (SELECT img, c, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM cells_emb GROUP BY img, c)
SELECT img, c::BIGINT AS c, nz::BIGINT AS nz, ny::BIGINT AS ny, nx::BIGINT AS nx, (nz, ny, nx) = first_value((nz, ny, nx)) OVER (PARTITION BY img ORDER BY c) AS matches FROM s""")
def _a24(spark, sf):
    s = stats.channel_shapes(fx.cells_emb(spark, sf))
    return s.select("img", *[F.col(n).cast("long").alias(n) for n in ("c", "nz", "ny", "nx")], "matches")


@query("a24_checked_cells", with_sql("cells_stack") + "SELECT c, count(*) AS n, sum(v) AS total FROM cells_stack GROUP BY c")
def _a24b(spark, sf):
    return stats.validate_shapes(fx.cells_stack(spark, sf)).groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("a19_project_mip", with_sql("cells_stack") + "SELECT c, y, x, max(v) AS v FROM cells_stack GROUP BY ALL")
def _a19a(spark, sf):
    return shape.project_z(fx.cells_stack(spark, sf), "mip").select("c", "y", "x", "v")


@query("a19_project_sum", with_sql("cells_stack") + "SELECT c, y, x, sum(v) AS v FROM cells_stack GROUP BY ALL")
def _a19b(spark, sf):
    return shape.project_z(fx.cells_stack(spark, sf), "sum").select("c", "y", "x", "v")


@query("a19_project_slice", with_sql("cells_stack") + "SELECT c, y, x, v FROM cells_stack WHERE z = 6")
def _a19c(spark, sf):
    return shape.project_z(fx.cells_stack(spark, sf), "slice", z=99).select("c", "y", "x", "v")


def _pyr_sql(levels: int) -> str:
    one = lambda lv: (f"SELECT {lv} AS level, {float(2**lv)}::DOUBLE AS scale, (y // {2**lv})::INT AS y, (x // {2**lv})::INT AS x, round(avg(v), 6) AS v "
                      f"FROM cells_wk, d WHERE y < (ny // {2**lv}) * {2**lv} AND x < (nx // {2**lv}) * {2**lv} GROUP BY ALL")
    return (with_sql("cells_wk") + ", d AS (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM cells_wk) "
            + " UNION ALL ".join(one(lv) for lv in range(levels)))


@query("a20_pyramid", _pyr_sql(3))
def _a20(spark, sf):
    return shape.pyramid(fx.cells_wk(spark, sf), 3).select("level", "scale", "y", "x", rnd("v").alias("v"))


@query("a21_block_mean", with_sql("cells_li") + """
SELECT (y // 4)::INT AS y, (x // 4)::INT AS x, round(avg(v), 6) AS v FROM cells_li GROUP BY y // 4, x // 4""")
def _a21(spark, sf):
    rows = fx.table(spark, sf, "lineitem").count()  # no fewer than cells
    return shape.block_mean(fx.cells_li(spark, sf), 4, rows, ["y", "x"]).select("y", "x", rnd("v").alias("v"))


@query("a22_simpson", with_sql("cells_stack") + """
SELECT c, y, x, round(sum(v * CASE WHEN z IN (0, 6) THEN 1 WHEN z % 2 = 1 THEN 4 ELSE 2 END) * 0.5 / 3, 6) AS integral
FROM cells_stack GROUP BY c, y, x""")
def _a22(spark, sf):
    s = shape.simpson(fx.cells_stack(spark, sf), 0.5, ["c", "y", "x"], "z", "v")
    return s.select("c", "y", "x", rnd("integral").alias("integral"))


@query("a23_composite_rgb", with_sql("cells_evs") + """,
lv AS (SELECT img, c, min(v) AS lo, max(v) AS hi FROM cells_evs GROUP BY img, c),
n AS (SELECT s.img, s.t, s.y, s.x, least(greatest((v - lo) / (hi - lo), 0), 1) AS n, c FROM cells_evs s JOIN lv USING (img, c))
SELECT img, t, y, x, floor(least(round(sum(n * CASE c WHEN 1 THEN 255 WHEN 3 THEN 255 WHEN 4 THEN 255 ELSE 0 END) / 255, 9), 1) * 255)::INT AS r,
  floor(least(round(sum(n * CASE c WHEN 0 THEN 255 WHEN 2 THEN 255 WHEN 3 THEN 255 ELSE 0 END) / 255, 9), 1) * 255)::INT AS g,
  floor(least(round(sum(n * CASE c WHEN 1 THEN 255 WHEN 2 THEN 255 ELSE 0 END) / 255, 9), 1) * 255)::INT AS b
FROM n GROUP BY img, t, y, x""")
def _a23(spark, sf):
    cells = fx.cells_evs(spark, sf)
    lv = cells.groupBy("img", "c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(1.0).alias("gamma"))
    # green, magenta, cyan, yellow, red by channel
    c = F.col("c")
    on = lambda *cs: F.when(c.isin(*cs), F.lit(255)).otherwise(F.lit(0))
    colors = lv.select("img", "c", on(1, 3, 4).alias("r"), on(0, 2, 3).alias("g"), on(1, 2).alias("b"))
    return shape.composite_rgb(cells, colors, lv)
