from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from sparkgrid import fixtures as fx
from sparkgrid.catalog import query
from sparkgrid.core import ensure_checkpoint_dir, rnd
from sparkgrid.fixtures import with_sql
from sparkgrid.sources import cells as cs, metadata as md, report


def shared_folder(spark) -> str:
    """A fresh folder below the session's checkpoint folder (all executors see it)."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    local = base[5:] if base.startswith("file:") else base
    if os.path.isdir(local):
        return tempfile.mkdtemp(dir=local)
    return f"{base}/{os.urandom(8).hex()}"


@query("s1_read_cells", with_sql("cells_t") + "SELECT img, t, c, y, x, v FROM cells_t WHERE t = 2 AND c = 3")
def _s1(spark, sf):
    path = shared_folder(spark)
    cs.write_cells(fx.cells_t(spark, sf), path)
    return cs.read_cells(spark, path, t=2, c=3).select("img", "t", "c", "y", "x", "v")


@query("s2_arrays_to_cells", """
SELECT vec_id, label, unnest(range(64))::INT % 8 AS x, unnest(range(64))::INT // 8 AS y, unnest(embedding)::DOUBLE AS v FROM embeddings""")
def _s2(spark, sf):
    # each vector as an 8 x 8 plane
    plane = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    df = fx.table(spark, sf, "embeddings").select("vec_id", "label", plane.alias("data"))
    return cs.arrays_to_cells(df).select("vec_id", "label", "y", "x", "v")


@query("s3_cells_to_arrays", with_sql("cells_ev") + """
SELECT img, c, y, string_agg(v::INT::VARCHAR, ',' ORDER BY x) AS line FROM cells_ev GROUP BY img, c, y""")
def _s3(spark, sf):
    a = cs.cells_to_arrays(fx.cells_ev(spark, sf))
    return a.select("img", "c", "y", F.array_join(F.transform("line", lambda v: v.cast("int").cast("string")), ",").alias("line"))


@query("s4_list_files")
def _s4(spark, sf):
    files = cs.list_files(spark, sf, [".parquet"])
    return files.select("name", "length")


EXT = """CASE page_id % 5 WHEN 0 THEN '.ome.tiff' WHEN 1 THEN '.OME.TIF' WHEN 2 THEN '.czi' WHEN 3 THEN '.tif.tiff' ELSE '' END"""


@query("s5_output_names", f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url || {EXT}, '[^/]*$'),
  '^(.+)\\.[^.]+$', '\\1'), '(?i)\\.tiff$', ''), '(?i)\\.tif$', ''), '(?i)\\.ome$', '') || '_decon_mip-proj.ome.tiff' AS output
FROM pages""")
def _s5(spark, sf):
    k = F.col("page_id") % 5
    ext = F.when(k == 0, F.lit(".ome.tiff")).when(k == 1, F.lit(".OME.TIF")).when(k == 2, F.lit(".czi")).when(
        k == 3, F.lit(".tif.tiff")).otherwise(F.lit(""))
    p = fx.table(spark, sf, "pages").select("page_id", F.concat("url", ext).alias("name"))
    return md.output_names(p, "mip").select("page_id", "output")


def _plates(spark, sf):
    """One plate document per customer; every second one has no image lists."""
    o = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("plate"), F.concat_ws("/", "o_orderstatus", F.month("o_orderdate").cast("string")).alias("path"),
        F.col("o_orderkey").cast("string").alias("f"))
    w = o.groupBy("plate", "path").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    listed = F.col("plate") % 2 == 0
    images = F.when(listed, F.transform("fs", lambda f: F.struct(f.alias("path"))))
    keys = F.array_append("fs", F.lit("labels"))
    children = F.when(~listed, F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit("g"))))
    wells = w.select("plate", F.struct("path", images.alias("images"), children.alias("children")).alias("w"))
    packed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("w.path").alias("k"), F.to_json("w").alias("j")))), lambda s: s["j"])
    return wells.groupBy("plate").agg(
        F.concat(F.lit('{"wells":['), F.array_join(packed, ","), F.lit("]}")).alias("attrs"))


PL = """SELECT o_custkey AS plate, o_orderstatus AS row, month(o_orderdate)::VARCHAR AS col, o_orderkey::VARCHAR AS field FROM orders"""


@query("s6_plate_fields", PL)
def _s6(spark, sf):
    return md.plate_fields(_plates(spark, sf)).select("plate", "row", "col", "field")


@query("s7_first_field", f"""
SELECT plate, f.row AS row, f.col AS col, f.field AS field FROM (
  SELECT plate, arg_min({{'row': row, 'col': col, 'field': field}}, (row || '/' || col, field)) AS f FROM ({PL}) GROUP BY plate)""")
def _s7(spark, sf):
    return md.first_field(_plates(spark, sf))


@query("s8_wells_index", f"""
SELECT plate, row, col, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM ({PL}) GROUP BY plate, row, col""")
def _s8(spark, sf):
    w = md.wells_index(md.plate_fields(_plates(spark, sf)))
    return w.select("plate", "row", "col", F.array_join("fields", ",").alias("fields"))


@query("s9_axis_scales", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 3.0 WHEN 1 THEN p_retailprice END::DOUBLE AS pixel_size_z,
  CASE WHEN p_size % 4 < 3 THEN p_size END::DOUBLE AS pixel_size_y, CASE WHEN p_size % 4 < 3 THEN p_size / 2 END::DOUBLE AS pixel_size_x FROM part""")
def _s9(spark, sf):
    d = lambda *v: F.array(*[x.cast("double") for x in v])
    s, p, one = F.col("p_size"), F.col("p_retailprice"), F.lit(1)
    scale = (
        F.when(s % 4 == 0, d(one, one, F.lit(3), s, s / 2)).when(s % 4 == 1, d(one, p, s, s / 2)).when(s % 4 == 2, d(one, s, s / 2)))
    arr = F.when(scale.isNull(), F.array(F.struct(F.lit("translation").alias("type"), d(one, one).alias("scale")))).otherwise(
        F.array(F.struct(F.lit("translation").alias("type"), d(one, one).alias("scale")),
                F.struct(F.lit("scale").alias("type"), scale.alias("scale"))))
    return md.axis_scales_from_transforms(fx.table(spark, sf, "part").select("p_partkey", arr.alias("arr")))


@query("s10_xml_metadata", """
SELECT p_partkey, p_size / 50.0 AS na, 'Oil' AS immersion, CASE WHEN p_size % 3 > 0 THEN 1.33 END::DOUBLE AS refractive_index,
  p_retailprice AS pixel_size_x, NULL::DOUBLE AS pixel_size_z, p_size::INT AS size_x, 0::INT AS size_t, 2::BIGINT AS n_channels,
  p_brand AS name0, (500 + p_size)::DOUBLE AS emission0, CASE WHEN p_size % 2 = 0 THEN 'confocal' ELSE 'widefield' END AS microscope_type FROM part""")
def _s10(spark, sf):
    f = lambda t, *a: F.format_string(t, *a)
    s = F.col("p_size")
    xml = F.concat(
        F.lit('<ome:OME xmlns:ome="urn:ome">'),
        f('<ome:Instrument ID="I:0"><ome:Objective LensNA="%s" Immersion="Oil"/></ome:Instrument>', (s / 50).cast("string")),
        F.lit('<ome:Instrument ID="I:1"><ome:Objective LensNA="9.9" Immersion="Air"/></ome:Instrument><ome:Image ID="G:0">'), F.when(s % 3 > 0, F.lit('<ome:ObjectiveSettings RefractiveIndex="1.33"/>')).otherwise(F.lit("")),
        f('<ome:Pixels PhysicalSizeX="%s" SizeX="%d">', F.col("p_retailprice").cast("string"), s),
        f('<ome:Channel Name="%s" EmissionWavelength="%d"/>', F.col("p_brand"), s + 500),
        f('<ome:Channel Name="b" AcquisitionMode="%s"/>', F.when(s % 2 == 0, F.lit("SpinningDiskConfocal")).otherwise(F.lit("WideField"))),
        F.lit('</ome:Pixels></ome:Image><ome:Image ID="G:1"><ome:Pixels PhysicalSizeX="7" SizeX="7"/></ome:Image></ome:OME>'))
    m = md.xml_metadata(fx.table(spark, sf, "part").select("p_partkey", xml.alias("xml")))
    return m.select("p_partkey", "na", "immersion", "refractive_index", "pixel_size_x", "pixel_size_z", "size_x", "size_t",
                    F.size("channels").cast("long").alias("n_channels"), F.col("channels")[0]["name"].alias("name0"),
                    F.col("channels")[0]["emission"].alias("emission0"), "microscope_type")


@query("s11_write_cells", with_sql("cells_stack") + "SELECT img, c, z, y, x, v, 0::INT AS level FROM cells_stack")
def _s11(spark, sf):
    path = shared_folder(spark)
    cells = fx.cells_stack(spark, sf)
    cs.write_cells(cells, path)
    cs.write_cells(cells, path)  # a repeated run must not duplicate rows
    return spark.read.parquet(path).select("img", "c", "z", "y", "x", "v", "level")


@query("s11_write_time_points", """
SELECT printf('%03d', o_custkey % 9) AS img, year(o_orderdate)::INT - 1990 AS t, 0::INT AS c, (o_orderkey % 7)::INT AS x, sum(o_orderkey)::DOUBLE AS v
FROM orders GROUP BY ALL""")
def _s11b(spark, sf):
    """Time points written in turn stay beside each other, and image names stay text."""
    path = shared_folder(spark)
    cells = fx.table(spark, sf, "orders").groupBy(
        F.lpad((F.col("o_custkey") % 9).cast("string"), 3, "0").alias("img"), (F.year("o_orderdate") - 1990).alias("t"), F.lit(0).alias("c"),
        F.lit(0).alias("z"), F.lit(0).alias("y"), (F.col("o_orderkey") % 7).cast("int").alias("x")).agg(F.sum("o_orderkey").cast("double").alias("v"))
    cs.write_cells(cells.filter("t % 2 = 0"), path)
    cs.write_cells(cells.filter("t % 2 = 1"), path)
    return cs.read_cells(spark, path).select("img", "t", "c", "x", "v")


@query("s12_metrics_csv", """
SELECT event_type AS label, '' AS device, printf('%.2f', round(avg(value), 9)) AS time_s, '0.00' AS cpu_percent_avg,
  printf('%.2f', max(value)) AS detail_energy_mean FROM events GROUP BY event_type""")
def _s12(spark, sf):
    m = fx.telemetry(spark, sf).groupBy(F.col("proc").alias("label")).agg(
        F.round(F.avg("value"), 9).alias("time_s"), F.max("value").alias("detail_energy_mean"))
    return report.metrics_report(m, ["time_s", "cpu_percent_avg"], ["detail_energy_mean"])


@query("s13_metadata_documents", with_sql("channels") + """,
im AS (SELECT img, (sum(n) % 8)::INT AS n FROM channels GROUP BY img),
sl AS (SELECT img, unnest(range(n))::INT AS c FROM im),
j AS (SELECT s.img, s.c, coalesce(h.name, 'Ch' || s.c) AS name, h.emission, h.excitation FROM sl s LEFT JOIN channels h USING (img, c)),
l AS (SELECT img, string_agg(name, ',' ORDER BY c) AS names, string_agg(emission::INT::VARCHAR, ',' ORDER BY c) AS em,
  string_agg(excitation::INT::VARCHAR, ',' ORDER BY c) AS ex FROM j GROUP BY img)
SELECT img, names, CASE WHEN n > 0 THEN coalesce(em, '') END AS emission, CASE WHEN n > 0 THEN coalesce(ex, '') END AS excitation,
  CASE WHEN n > 3 THEN 'NA=1.4; ' ELSE '' END || 'RI=1.515; Microscope=confocal' AS description FROM im LEFT JOIN l USING (img)""")
def _s13(spark, sf):
    im = fx.channels(spark, sf).groupBy("img").agg((F.sum("n") % 8).cast("int").alias("n")).select(
        "img", "n", F.when(F.col("n") > 3, F.lit(1.4)).alias("na"), F.lit(1.515).alias("refractive_index"),
        F.lit("confocal").alias("microscope_type"), F.lit(None).cast("double").alias("magnification"),
        F.lit(None).cast("string").alias("immersion"))
    d = md.metadata_documents(im, fx.channels(spark, sf))
    ints = lambda c: F.array_join(F.transform(c, lambda v: v.cast("int").cast("string")), ",")
    return d.select("img", F.array_join("names", ",").alias("names"), ints("emission").alias("emission"),
                    ints("excitation").alias("excitation"), "description")


CHANNELS_RESOLVED = with_sql("channels") + """,
im AS (SELECT img, (sum(n) % 8)::INT AS n FROM channels GROUP BY img),
sl AS (SELECT img, unnest(range(n))::INT AS c FROM im),
al AS (SELECT s.img, s.c, coalesce(h.name, 'Ch' || s.c) AS name, h.emission, h.excitation FROM sl s LEFT JOIN channels h USING (img, c)),
us AS (SELECT * FROM (VALUES (0, 610.0, NULL), (1, NULL, 405.0), (3, 700.0, 640.0)) u(c, em, ex)),
rs AS (SELECT img, c, name, coalesce({em}, 520.0)::DOUBLE AS emission,
  CASE WHEN {ef} ELSE 'default' END AS emission_from, coalesce({ex})::DOUBLE AS excitation, CASE WHEN {xf} END AS excitation_from
  FROM al LEFT JOIN us USING (c))"""
USER_FIRST = CHANNELS_RESOLVED.format(
    em="em, emission", ef="em IS NOT NULL THEN 'user' WHEN emission IS NOT NULL THEN 'file'", ex="ex, excitation",
    xf="ex IS NOT NULL THEN 'user' WHEN excitation IS NOT NULL THEN 'file'")
FILE_FIRST = CHANNELS_RESOLVED.format(
    em="emission, em", ef="emission IS NOT NULL THEN 'file' WHEN em IS NOT NULL THEN 'user'", ex="excitation, ex",
    xf="excitation IS NOT NULL THEN 'file' WHEN ex IS NOT NULL THEN 'user'")
WAVES = ([610.0, None, None, 700.0], [None, 405.0, None, 640.0])


def _metadata_images(spark, sf):
    return fx.channels(spark, sf).groupBy("img").agg((F.sum("n") % 8).cast("int").alias("n"), F.max("n").alias("m")).select(
        "img", "n", (F.col("m") % 3).cast("int").alias("size_z"), F.when(F.col("n") > 3, F.lit(1.2)).alias("na"),
        F.when(F.col("n") % 2 == 0, F.col("m") / 8).alias("pixel_size_x"))


@query("p1_channel_wavelengths", USER_FIRST + " SELECT img, c, name, emission, emission_from, excitation, excitation_from FROM rs")
def _p1c(spark, sf):
    rows = md.align_channels(_metadata_images(spark, sf).select("img", "n"), fx.channels(spark, sf).select("img", "c", "name", "emission", "excitation"))
    return md.resolve_channels(rows, *WAVES)


@query("p1_resolve_all", FILE_FIRST + """,
d AS (SELECT img, bool_or(emission_from = 'default') AS em FROM rs GROUP BY img),
m AS (SELECT img, max(n) AS m FROM channels GROUP BY img)
SELECT im.img, coalesce(CASE WHEN n > 3 THEN 1.2 END, 1.45)::DOUBLE AS na, coalesce(CASE WHEN n % 2 = 0 THEN m / 8 END, 0.065)::DOUBLE AS pixel_size_x,
  1.47::DOUBLE AS sample_refractive_index,
  concat_ws(',', 'refractive_index', 'microscope_type', CASE WHEN n % 2 = 1 THEN 'pixel_size_x' END, 'pixel_size_y', 'pixel_size_z',
    CASE WHEN em THEN 'emission_wavelength' END) AS defaulted
FROM im JOIN m USING (img) LEFT JOIN d USING (img)""")
def _p1d(spark, sf):
    """User values as fallbacks, assumed keys listed, a wavelength list per channel."""
    images, _ = md.resolve_all(
        _metadata_images(spark, sf), fx.channels(spark, sf).select("img", "c", "name", "emission", "excitation"), {"na": 1.45}, *WAVES, overrule=False)
    return images.select("img", "na", "pixel_size_x", "sample_refractive_index", F.array_join("defaulted", ",").alias("defaulted"))


@query("s13_document", FILE_FIRST + """,
m AS (SELECT img, max(n) AS m FROM channels GROUP BY img),
l AS (SELECT img, string_agg(c || ':' || coalesce(excitation::INT::VARCHAR, '-'), ',' ORDER BY c) AS places,
  string_agg(excitation::INT::VARCHAR, ',' ORDER BY c) AS known, string_agg(name, ',' ORDER BY c) AS names FROM rs GROUP BY img)
SELECT im.img, CASE WHEN m % 3 > 1 THEN 'CZYX' ELSE 'CYX' END AS axes, CASE WHEN n % 2 = 0 THEN m / 8 END::DOUBLE AS size_x,
  CASE WHEN n % 2 = 0 THEN 'µm' END AS unit_x, l.places, l.known, l.names, CASE WHEN n > 3 THEN 'NA=1.2; ' ELSE '' END || 'RI=1.5' AS description
FROM im JOIN m USING (img) LEFT JOIN l USING (img)""")
def _s13b(spark, sf):
    """The document read back: axes, sizes with units, channels at their places."""
    images = _metadata_images(spark, sf)
    rows = md.resolve_channels(
        md.align_channels(images.select("img", "n"), fx.channels(spark, sf).select("img", "c", "name", "emission", "excitation")), *WAVES, overrule=False)
    nothing = lambda t: F.lit(None).cast(t)
    d = md.metadata_documents(images.withColumns({
        "refractive_index": F.lit(1.5), "microscope_type": nothing("string"), "magnification": nothing("double"), "immersion": nothing("string")}), rows)
    doc = F.from_json("document", "axes string, PhysicalSizeX double, PhysicalSizeXUnit string, Description string, "
                      "Channel struct<Name: array<string>, ExcitationWavelength: array<double>>, "
                      "Channels array<struct<Index: int, ExcitationWavelength: double>>")
    ints = lambda v: v.cast("int").cast("string")
    place = lambda s: F.concat_ws(":", s["Index"].cast("string"), F.coalesce(ints(s["ExcitationWavelength"]), F.lit("-")))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return d.select("img", doc.alias("d")).select(
        "img", F.col("d.axes").alias("axes"), F.col("d.PhysicalSizeX").alias("size_x"), F.col("d.PhysicalSizeXUnit").alias("unit_x"),
        joined(F.transform("d.Channels", place)).alias("places"), joined(F.transform("d.Channel.ExcitationWavelength", ints)).alias("known"),
        joined(F.col("d.Channel.Name")).alias("names"), F.col("d.Description").alias("description"))
