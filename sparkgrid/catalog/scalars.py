from __future__ import annotations

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.core import finite, rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.functions import color, scalar as sc
from sparkgrid.sources import metadata as md

P1_USER = {"q": 9}
P1_DEF = {"q": 1, "toxic": 7}


@query("p1_resolve_overrule", with_sql("images_meta") + """
SELECT img, lang, 9 AS q, coalesce(toxic, 7) AS toxic, CASE WHEN toxic IS NULL THEN 'toxic' ELSE '' END AS defaulted FROM images_meta""")
def _p1a(spark, sf):
    r = md.resolve_metadata(fx.images_meta(spark, sf), P1_USER, True, P1_DEF)
    return r.select("img", "lang", "q", "toxic", F.array_join("defaulted", ",").alias("defaulted"))


@query("p1_resolve_fill", with_sql("images_meta") + """
SELECT img, lang, coalesce(q, 9) AS q, coalesce(toxic, 7) AS toxic,
  CASE WHEN toxic IS NULL THEN 'toxic' ELSE '' END AS defaulted FROM images_meta""")
def _p1b(spark, sf):
    r = md.resolve_metadata(fx.images_meta(spark, sf), P1_USER, False, P1_DEF)
    return r.select("img", "lang", "q", "toxic", F.array_join("defaulted", ",").alias("defaulted"))


def _counts(spark, sf):
    return fx.channels(spark, sf).groupBy("img").agg((F.sum("n") % 8).cast("int").alias("n"))


COUNTS = with_sql("channels") + """,
im AS (SELECT img, (sum(n) % 8)::INT AS n FROM channels GROUP BY img),
sl AS (SELECT img, unnest(range(n))::INT AS c FROM im)"""


@query("p2_align_channels", COUNTS + """
SELECT s.img, s.c, coalesce(h.name, 'Ch' || s.c) AS name, h.emission FROM sl s LEFT JOIN channels h USING (img, c)""")
def _p2(spark, sf):
    return md.align_channels(_counts(spark, sf), fx.channels(spark, sf)).select("img", "c", "name", "emission")


@query("p3_per_channel_param", """
SELECT l_linenumber AS c, (list_extract([40, 30, 20], least(l_linenumber + 1, 3)::BIGINT))::INT AS niter, count(*) AS n
FROM lineitem GROUP BY ALL""")
def _p3(spark, sf):
    niter = sc.per_channel_param(F.array(F.lit(40), F.lit(30), F.lit(20)), F.col("l_linenumber"))
    return fx.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("c"), niter.alias("niter")).agg(
        F.count(F.lit(1)).alias("n"))


def _choices(spark, sf):
    k = F.col("c_nationkey") % 6
    raw = (
        F.when(k == 0, F.lit("Oil (1.515)")).when(k == 1, F.col("c_acctbal").cast("string"))
        .when(k == 2, F.lit(" Water (1.333)")).when(k == 3, F.lit("auto")).when(k == 4, F.lit("")).otherwise(F.col("c_mktsegment")))
    return fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", raw.alias("raw"))


@query("p4_parse_choice", """
SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 1.515 WHEN 1 THEN c_acctbal WHEN 2 THEN 1.333 END::DOUBLE AS ri FROM customer""")
def _p4(spark, sf):
    return _choices(spark, sf).select("c_custkey", sc.parse_choice(F.col("raw"), sc.IMMERSION_INDEX).alias("ri"))


@query("p5_parse_float_list", """
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 2 ELSE 3 END::BIGINT AS n,
  CASE WHEN c_nationkey % 3 = 0 THEN 488 + 561 ELSE c_custkey + c_nationkey + c_acctbal END::DOUBLE AS total FROM customer""")
def _p5(spark, sf):
    text = F.concat(F.col("c_custkey"), F.lit(" , "), F.col("c_nationkey"), F.lit(",, "), F.col("c_acctbal"))
    raw = F.when(F.col("c_nationkey") % 3 == 0, F.lit(" Auto ")).otherwise(text)
    vals = sc.parse_float_list(raw, "488,561")
    return fx.table(spark, sf, "customer").select(
        "c_custkey", F.size(vals).cast("long").alias("n"), F.aggregate(vals, F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("p5_parse_float_list_lenient", """
SELECT c_custkey, 2::BIGINT AS n, (c_custkey + c_acctbal)::DOUBLE AS total FROM customer""")
def _p5b(spark, sf):
    raw = F.concat(F.col("c_custkey"), F.lit(", none, nan,"), F.col("c_mktsegment"), F.lit(", "), F.col("c_acctbal"))
    vals = sc.parse_float_list_lenient(raw)
    return fx.table(spark, sf, "customer").select(
        "c_custkey", F.size(vals).cast("long").alias("n"), F.aggregate(vals, F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("p6_parse_bool", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS flag FROM orders")
def _p6(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", F.lit(" TRUE")).when(F.col("o_orderstatus") == "O", F.lit("yes ")).otherwise(F.lit("no"))
    return fx.table(spark, sf, "orders").select("o_orderkey", sc.parse_bool(raw).alias("flag"))


@query("p7_infer_mode", with_sql("channels") + """
SELECT img, CASE WHEN bool_or(lower(mode) LIKE '%confocal%') THEN 'confocal' ELSE 'widefield' END AS microscope_type
FROM channels GROUP BY img""")
def _p7(spark, sf):
    return md.infer_mode(fx.channels(spark, sf))


@query("p7_vendor_mode", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'confocal' WHEN 'de' THEN 'widefield' WHEN 'fr' THEN 'widefield' END AS kind FROM documents""")
def _p7b(spark, sf):
    key = F.when(F.col("lang") == "en", F.lit("SPINNING_DISK_CONFOCAL")).when(F.col("lang") == "de", F.lit("WIDE_FIELD")).when(
        F.col("lang") == "fr", F.lit("OTHER")).otherwise(F.col("lang"))
    return fx.table(spark, sf, "documents").select("doc_id", sc.lookup(key, sc.ACQUISITION_MODE).alias("kind"))


RGB = lambda nm: f"""CASE WHEN {nm} IS NULL OR {nm} < 380 OR {nm} > 780 THEN 255
  WHEN {nm} < 440 THEN floor((440 - {nm}) / 60 * 255) WHEN {nm} < 510 THEN 0 WHEN {nm} < 580 THEN floor(({nm} - 510) / 70 * 255) ELSE 255 END::INT AS r,
CASE WHEN {nm} IS NULL OR {nm} < 380 OR {nm} > 780 THEN 255 WHEN {nm} < 440 THEN 0 WHEN {nm} < 490 THEN floor(({nm} - 440) / 50 * 255)
  WHEN {nm} < 580 THEN 255 WHEN {nm} < 645 THEN floor((645 - {nm}) / 65 * 255) ELSE 0 END::INT AS g,
CASE WHEN {nm} IS NULL OR {nm} < 380 OR {nm} > 780 THEN 255 WHEN {nm} < 490 THEN 255 WHEN {nm} < 510 THEN floor((510 - {nm}) / 20 * 255) ELSE 0 END::INT AS b"""


@query("p8_emission_to_rgb", f"""
SELECT l_orderkey, l_linenumber, {RGB('nm')} FROM (SELECT *, 350 + l_extendedprice % 450 AS nm FROM lineitem)""")
def _p8(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumn("rgb", sc.emission_to_rgb(F.col("l_extendedprice") % 450 + 350))
    return li.select("l_orderkey", "l_linenumber", "rgb.r", "rgb.g", "rgb.b")


@query("p9_resolve_colors", with_sql("channels") + f""",
a AS (SELECT img, c, {RGB('emission')} FROM channels)
SELECT img, c, CASE WHEN r + g + b = 765 THEN [0, 255, 0, 255, 0, 255][c % 6 + 1] ELSE r END::INT AS r,
  CASE WHEN r + g + b = 765 THEN [255, 0, 255, 0, 0, 255][c % 6 + 1] ELSE g END::INT AS g,
  CASE WHEN r + g + b = 765 THEN [0, 255, 255, 0, 255, 0][c % 6 + 1] ELSE b END::INT AS b FROM a""")
def _p9(spark, sf):
    return color.resolve_colors(fx.channels(spark, sf))


@query("p9_equal_colors", with_sql("channels") + """
SELECT img, c, [0, 0, 255, 0, 255, 255][c % 6 + 1]::INT AS r, [0, 255, 0, 255, 255, 0][c % 6 + 1]::INT AS g,
  [255, 0, 0, 255, 0, 255][c % 6 + 1]::INT AS b FROM channels""")
def _p9b(spark, sf):
    return color.resolve_colors(fx.channels(spark, sf).withColumn("emission", F.lit(520.0)))


@query("p10_classify_channels", """
SELECT 'd' || source AS img, CASE WHEN bool_or(lang = 'en') THEN 'fluorescence' ELSE 'other' END AS kind FROM documents GROUP BY source
UNION ALL SELECT 'c' || c_nationkey, 'rgb' FROM customer GROUP BY c_nationkey""")
def _p10(spark, sf):
    d = fx.table(spark, sf, "documents").groupBy(F.concat(F.lit("d"), "source").alias("img"), "lang").agg(F.count(F.lit(1)).alias("n"))
    d = d.select("img", F.ascii("lang").alias("c"), F.when(F.col("lang") == "en", F.lit("mCherry 2")).otherwise(F.col("lang")).alias("name"),
                 F.lit(None).cast("double").alias("emission"))
    rgb = fx.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("img")).distinct()
    rgb = rgb.select("img", F.posexplode(F.array(F.lit("Red"), F.lit(" green"), F.lit("BLUE"))).alias("c", "name"),
                     F.lit(500.0).alias("emission"))
    return color.classify_channels(d.unionByName(rgb))


@query("p9_explicit_colors", with_sql("channels") + f""",
a AS (SELECT img, c, n, {RGB('emission')} FROM channels)
SELECT img, c, CASE WHEN c = 0 THEN n % 200 WHEN r + g + b = 765 THEN [0, 255, 0, 255, 0, 255][c % 6 + 1] ELSE r END::INT AS r,
  CASE WHEN c = 0 THEN 7 WHEN r + g + b = 765 THEN [255, 0, 255, 0, 0, 255][c % 6 + 1] ELSE g END::INT AS g,
  CASE WHEN c = 0 THEN 9 WHEN r + g + b = 765 THEN [0, 255, 255, 0, 255, 0][c % 6 + 1] ELSE b END::INT AS b FROM a""")
def _p9c(spark, sf):
    """Channel 0 has a colour of its own, channel 2 is white, which says nothing, channel 3 lacks a part, the others have none."""
    color_of = lambda r, g, b: F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))
    given = F.when(F.col("c") == 0, color_of(F.col("n") % 200, F.lit(7), F.lit(9))).when(
        F.col("c") == 2, color_of(*[F.lit(255)] * 3)).when(F.col("c") == 3, color_of(F.lit(1), F.lit(None), F.lit(2)))
    return color.resolve_colors(fx.channels(spark, sf).withColumn("color", given))


@query("p10_rgb_by_colors", """
SELECT 'c' || c_nationkey AS img, CASE WHEN c_nationkey % 3 = 0 THEN 'rgb' WHEN c_nationkey % 3 = 1 THEN 'other' ELSE 'fluorescence' END AS kind
FROM customer GROUP BY c_nationkey""")
def _p10b(spark, sf):
    """The colours of RGB channels in any order; one of them replaced; all of them, but four channels with a wavelength."""
    nations = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")).distinct()
    shown = [color.RGB_CHANNELS[i] for i in (2, 0, 1)]
    colors = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("rgb", c)]) for c in shown])
    other = F.array(F.struct(*[F.lit(v).alias(k) for k, v in zip("rgb", (1, 2, 3))]))
    given = F.when(F.col("n") % 3 == 0, colors).when(F.col("n") % 3 == 1, F.concat(F.slice(colors, 1, 2), other)).otherwise(F.concat(colors, other))
    rows = nations.select("n", F.posexplode(given).alias("c", "color"))
    return color.classify_channels(rows.select(
        F.concat(F.lit("c"), "n").alias("img"), "c", F.lit("layer").alias("name"), "color",
        F.when(F.col("n") % 3 == 2, F.lit(520.0)).alias("emission")))


@query("p11_kernel_size", """
SELECT p_partkey, CASE WHEN n % 2 = 0 THEN n + 1 ELSE n END::BIGINT AS size FROM (SELECT p_partkey,
  greatest(2 * floor(4.0 * 0.61 * (400 + p_size * 6) / (0.2 + p_size / 50.0) / (p_retailprice / 20)) + 1, 64) AS n FROM part)""")
def _p11a(spark, sf):
    size = sc.kernel_size(F.col("p_size") * 6 + 400, F.col("p_size") / 50.0 + 0.2, F.col("p_retailprice") / 20)
    return fx.table(spark, sf, "part").select("p_partkey", size.alias("size"))


@query("p11_axial_step", """
SELECT p_partkey, round(greatest(least((400 + p_size * 6) / (2 * greatest(n - sqrt(greatest(n * n - a * a, 1e-9)), 1e-6)), 1000), p_retailprice / 2), 4) AS step
FROM (SELECT *, greatest(1.33, a + 1e-6) AS n FROM (SELECT *, 0.2 + p_size / 40.0 AS a FROM part))""")
def _p11b(spark, sf):
    step = sc.axial_step(F.col("p_size") * 6 + 400, F.col("p_size") / 40.0 + 0.2, F.lit(1.33), F.col("p_retailprice"))
    return fx.table(spark, sf, "part").select("p_partkey", rnd(step, 4).alias("step"))


@query("p15_finite_only", with_sql("cells_emb") + "SELECT c, count(*) FILTER (v > 0) AS n FROM cells_emb GROUP BY c")
def _p15(spark, sf):
    # logarithms and divisions make NaN, null and infinite cells that must go
    cells = fx.cells_emb(spark, sf).withColumn(
        "v", F.when(F.col("v") > 0, F.col("v")).when(F.col("y") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf"))))
    return cells.filter(finite("v")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def _wl(mode, gain, sql):
    n = "pow(least(greatest((v + 0.2) / 0.5, 0), 1), 1 / 1.5)"
    return with_sql("cells_emb") + f" SELECT c, y, x, round(least(greatest({sql.format(n=n, gain=gain)}, 0), 1), 6) AS v FROM cells_emb"


def _window(mode, gain):
    def fn(spark, sf):
        v = sc.window_level(F.col("v"), F.lit(-0.2), F.lit(0.3), F.lit(1.5), mode, gain)
        return fx.cells_emb(spark, sf).select("c", "y", "x", rnd(v).alias("v"))
    return fn


query("p16_window_level", _wl("additive", 1.2, "{n} * {gain}"))(_window("additive", 1.2))
query("p16_window_translucent", _wl("translucent", 0.8, "sqrt({n}) * {gain}"))(_window("translucent", 0.8))
query("p16_window_average", _wl("average", 1.8, "1 - exp(pow({n}, 0.7) * -1.8 * {gain})"))(_window("average", 1.8))


@query("p17_anscombe", with_sql("cells_evs") + """
SELECT img, c, y, x, round(2 * sqrt(greatest(v, 0) + 0.375), 6) AS f, round(greatest(v * v / 4 - 0.375, 0), 4) AS i FROM cells_evs""")
def _p17(spark, sf):
    v = F.col("v")
    return fx.cells_evs(spark, sf).select("img", "c", "y", "x", rnd(sc.anscombe(v)).alias("f"), rnd(sc.inverse_anscombe(v), 4).alias("i"))


@query("p18_damping_exponent", with_sql("cells_evs") + """
SELECT img, c, y, x, round(g, 6) AS g, round(pow(greatest(v / 20, 1e-12), g), 6) AS corr FROM (
  SELECT *, least(greatest(1 - exp(-greatest(v - 3, 0) / 6.0), 1e-3), 1) AS g FROM cells_evs)""")
def _p18(spark, sf):
    g = sc.damping_exponent(F.col("v"), F.lit(2.0), 3.0, F.lit(3.0))
    return fx.cells_evs(spark, sf).select("img", "c", "y", "x", rnd(g).alias("g"), rnd(sc.damped(F.col("v") / 20, g)).alias("corr"))
