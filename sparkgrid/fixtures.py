"""Grids, kernels and metadata derived from the star-schema test tables.

Each fixture exists twice: as a DataFrame and as an SQL fragment with the same
rows, so any operator can be compared with a second engine.  All of them read
whole tables, and all grow with the scale factor.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgrid.core import CELL, KEYS, dealt, settle
from sparkgrid.sources.cells import densify

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _cells(spark, sf, name: str, rows: DataFrame, by: list[str], v) -> DataFrame:
    """Rows of a table summed to cells, in tasks by the number of its rows (read from file footers).

    ``by`` are the keys that are no constants: Spark groups by these alone, and
    dealt by others the rows would move a second time.
    """
    return dealt(rows, table(spark, sf, name).count(), *by).groupBy(*CELL).agg(v.alias("v"))


def _lit(*vals):
    return [F.lit(v).cast("int") for v in vals]


def event_channel():
    return F.array_position(F.array(*[F.lit(e) for e in EVENT_TYPES]), F.col("event_type")).cast("int") - 1


EVENT_CHANNEL_SQL = "list_position(['click','error','purchase','signup','view'], event_type)::INT - 1"


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.floor(F.col("user_id") / 50)).alias("img"), F.lit(0).alias("t"),
        event_channel().alias("c"), F.lit(0).alias("z"), F.hour("ts").alias("y"),
        (F.dayofmonth("ts") - 1).alias("x"), "value",
    )


def _event_box(ev: DataFrame, cells: DataFrame) -> DataFrame:
    cells = settle(cells)
    imgs = ev.select("img", "t").distinct()
    groups = imgs.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4))))
    lo0 = F.lit(0)
    return densify(cells, groups, {"z": (lo0, lo0), "y": (lo0, F.lit(23)), "x": (lo0, F.lit(29))}).select(*CELL, "v")


def cells_ev(spark, sf):
    """Event counts per hour and day: one image per 50 users, five channels."""
    ev = _events(spark, sf)
    return _event_box(ev, _cells(spark, sf, "events", ev, ["img", "c", "y", "x"], F.count(F.lit(1)).cast("double")))


def cells_evs(spark, sf):
    """Event values summed on the same grid (not integers)."""
    ev = _events(spark, sf)
    return _event_box(ev, _cells(spark, sf, "events", ev, ["img", "c", "y", "x"], F.round(F.sum("value"), 2)))


def cells_stack(spark, sf):
    """3-D stacks: return flag x year x month x supplier, summed quantity."""
    li = table(spark, sf, "lineitem").select(
        F.lit("s").alias("img"), F.lit(0).alias("t"),
        (F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1).cast("int").alias("c"),
        (F.year("l_shipdate") - 1995).alias("z"), (F.month("l_shipdate") - 1).alias("y"),
        F.col("l_suppkey").cast("int").alias("x"), "l_quantity",
    )
    cells = settle(_cells(spark, sf, "lineitem", li, ["c", "z", "y", "x"], F.sum("l_quantity")))
    nx = li.groupBy("img", "t").agg(F.max("x").alias("mx"))
    groups = nx.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    lo0 = F.lit(0)
    return densify(cells, groups, {"z": (lo0, F.lit(6)), "y": (lo0, F.lit(11)), "x": (lo0, F.col("mx"))}).select(*CELL, "v")


def _li(spark, sf, days: int):
    li = table(spark, sf, "lineitem").select(
        F.lit("li").alias("img"), F.lit(0).alias("t"), F.lit(0).alias("c"), F.lit(0).alias("z"),
        F.col("l_suppkey").cast("int").alias("y"),
        F.floor(F.datediff("l_shipdate", F.lit("1995-01-01")) / days).cast("int").alias("x"),
        "l_quantity",
    )
    return _cells(spark, sf, "lineitem", li, ["y", "x"], F.sum("l_quantity"))


def cells_li(spark, sf):
    """One sparse image: supplier x day."""
    return _li(spark, sf, 1)


def cells_wk(spark, sf):
    """One dense image: supplier x week, zero-filled."""
    cells = settle(_li(spark, sf, 7))
    groups = cells.groupBy(*KEYS).agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    lo0 = F.lit(0)
    return densify(cells, groups, {"z": (lo0, lo0), "y": (lo0, F.col("my")), "x": (lo0, F.col("mx"))}).select(*CELL, "v")


def cells_emb(spark, sf):
    """Embedding values: label x vector x component; channels differ in height."""
    e = table(spark, sf, "embeddings").select(
        F.lit("e").alias("img"), F.lit(0).alias("t"), F.col("label").alias("c"), F.lit(0).alias("z"),
        F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return e.withColumn("v", F.col("v").cast("double"))


def cells_t(spark, sf):
    """The value grid as a series: one time point per week."""
    return cells_evs(spark, sf).select(
        "img", F.floor(F.col("x") / 7).cast("int").alias("t"), "c", "z", "y",
        F.pmod(F.col("x"), F.lit(7)).alias("x"), "v")


def kernel_ev(spark, sf):
    """One 3-D kernel per image: event counts by day (z), hour (y) and type (x)."""
    return cells_ev(spark, sf).select(
        F.col("img").alias("kid"), F.col("x").alias("z"), "y", F.col("c").alias("x"), F.col("v").alias("w"))


def channels(spark, sf):
    """One metadata row per image and event type, with gaps to fill."""
    g = _events(spark, sf).groupBy("img", "c").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("c")
    return g.select(
        "img", "c",
        F.element_at(F.array(*[F.lit(e) for e in EVENT_TYPES]), c + 1).alias("name"),
        F.when(c == 1, F.lit(None)).when(c == 4, F.lit(900.0)).otherwise(400.0 + 60.0 * c).cast("double").alias("emission"),
        F.when(c == 3, F.lit(None)).otherwise(360.0 + 60.0 * c).cast("double").alias("excitation"),
        F.when(c == 2, F.lit("SpinningDiskConfocal")).otherwise(F.lit("WideField")).alias("mode"), "n")


def images_meta(spark, sf):
    """Documents with their partial labels: real nulls for metadata rules."""
    d = table(spark, sf, "documents")
    return d.join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("img"), F.col("quality").alias("q"), "toxic", "lang", "n_chars")


def telemetry(spark, sf):
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("proc"), "value")


_EVENTS_SQL = f"""ev AS (SELECT 'u' || (user_id // 50) AS img, {EVENT_CHANNEL_SQL} AS c,
  hour(ts)::INT AS y, (day(ts) - 1)::INT AS x, value FROM events),
ev_box AS (SELECT img, 0 AS t, c, 0 AS z, y, x FROM (SELECT DISTINCT img FROM ev),
  (SELECT unnest(range(5))::INT AS c), (SELECT unnest(range(24))::INT AS y), (SELECT unnest(range(30))::INT AS x))"""


def _ev_sql(name, agg):
    return f"""{name} AS (SELECT b.*, coalesce(g.v, 0)::DOUBLE AS v FROM ev_box b LEFT JOIN
  (SELECT img, c, y, x, {agg} AS v FROM ev GROUP BY ALL) g
  ON b.img = g.img AND b.c = g.c AND b.y = g.y AND b.x = g.x)"""


_LI = lambda days: f"""SELECT 'li' AS img, 0 AS t, 0 AS c, 0 AS z, l_suppkey::INT AS y,
  (date_diff('day', DATE '1995-01-01', l_shipdate::DATE) // {days})::INT AS x, sum(l_quantity) AS v
  FROM lineitem GROUP BY ALL"""

#: name -> (fragments it needs, SQL of the fragment itself)
SQL: dict[str, tuple[list[str], str]] = {
    "ev": ([], _EVENTS_SQL),
    "cells_ev": (["ev"], _ev_sql("cells_ev", "count(*)::DOUBLE")),
    "cells_evs": (["ev"], _ev_sql("cells_evs", "round(sum(value), 2)")),
    "cells_stack": ([], """st AS (SELECT list_position(['A','N','R'], l_returnflag)::INT - 1 AS c,
  (year(l_shipdate) - 1995)::INT AS z, (month(l_shipdate) - 1)::INT AS y, l_suppkey::INT AS x,
  sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
cells_stack AS (SELECT 's' AS img, 0 AS t, b.c, b.z, b.y, b.x, coalesce(st.v, 0)::DOUBLE AS v FROM
  (SELECT c, z, y, x FROM (SELECT unnest(range(3))::INT AS c), (SELECT unnest(range(7))::INT AS z),
   (SELECT unnest(range(12))::INT AS y), (SELECT unnest(range((SELECT max(l_suppkey) + 1 FROM lineitem)))::INT AS x)) b
  LEFT JOIN st ON st.c = b.c AND st.z = b.z AND st.y = b.y AND st.x = b.x)"""),
    "cells_li": ([], f"cells_li AS ({_LI(1)})"),
    "cells_wk": ([], f"""wk AS ({_LI(7)}), cells_wk AS (SELECT 'li' AS img, 0 AS t, 0 AS c, 0 AS z, b.y, b.x,
  coalesce(wk.v, 0)::DOUBLE AS v FROM (SELECT y, x FROM (SELECT unnest(range((SELECT max(y) + 1 FROM wk)))::INT AS y),
  (SELECT unnest(range((SELECT max(x) + 1 FROM wk)))::INT AS x)) b LEFT JOIN wk ON wk.y = b.y AND wk.x = b.x)"""),
    "cells_emb": ([], """cells_emb AS (SELECT 'e' AS img, 0 AS t, label AS c, 0 AS z, vec_id::INT AS y,
  (unnest(range(len(embedding))))::INT AS x, (unnest(embedding))::DOUBLE AS v FROM embeddings)"""),
    "cells_t": (["cells_evs"], """cells_t AS (SELECT img, (x // 7)::INT AS t, c, z, y, (x % 7)::INT AS x, v FROM cells_evs)"""),
    "cells_ti": (["cells_t"], "cells_ti AS (SELECT img || '#' || t AS img, 0 AS t, c, z, y, x, v FROM cells_t)"),
    "cells_pl": (["cells_ev"], "cells_pl AS (SELECT img || '/A/1/' || c AS img, 0 AS t, 0 AS c, z, y, x, v FROM cells_ev)"),
    "kernel_ev": (["cells_ev"], "kernel_ev AS (SELECT img AS kid, x AS z, y, c AS x, v AS w FROM cells_ev)"),
    "channels": (["ev"], """channels AS (SELECT img, c, (['click','error','purchase','signup','view'])[c + 1] AS name,
  CASE WHEN c = 1 THEN NULL WHEN c = 4 THEN 900.0 ELSE 400.0 + 60.0 * c END::DOUBLE AS emission,
  CASE WHEN c = 3 THEN NULL ELSE 360.0 + 60.0 * c END::DOUBLE AS excitation,
  CASE WHEN c = 2 THEN 'SpinningDiskConfocal' ELSE 'WideField' END AS mode, count(*) AS n FROM ev GROUP BY img, c)"""),
    "images_meta": ([], """images_meta AS (SELECT d.doc_id AS img, l.quality AS q, l.toxic AS toxic, d.lang, d.n_chars
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""),
    "telemetry": ([], "telemetry AS (SELECT ts, event_type AS proc, value FROM events)"),
}


def with_sql(*names: str) -> str:
    """``WITH`` clause that defines the named fixtures and what they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for need in SQL[n][0]:
            add(need)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n][1] for n in done)
