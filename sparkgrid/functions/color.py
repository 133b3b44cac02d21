"""Channel colours and channel kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.functions.scalar import emission_to_rgb

# Colour cycles as (r, g, b).
FALLBACK = [(0, 255, 0), (255, 0, 255), (0, 255, 255), (255, 0, 0), (0, 0, 255), (255, 255, 0)]
CYCLE = [(0, 0, 255), (0, 255, 0), (255, 0, 0), (0, 255, 255), (255, 255, 0), (255, 0, 255)]
# The colours that three channels of an RGB image are shown in.
RGB_CHANNELS = [(220, 68, 68), (56, 184, 104), (72, 136, 255)]
# Fluorescence markers looked for in channel names.
MARKERS = ["dapi", "fitc", "gfp", "yfp", "cfp", "rfp", "mcherry", "tdtomato",
           "tritc", "cy3", "cy5", "alexa", "hoechst", "far red"]


def _palette(colors: list[tuple[int, int, int]], c: Column) -> Column:
    entries = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", rgb)]) for rgb in colors])
    return F.element_at(entries, (c % len(colors) + 1).cast("int"))


def _rgb(r: int, g: int, b: int) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", (r, g, b))])


def _explicit(channels: DataFrame) -> Column:
    """The ``color`` (a struct of r, g, b) that the table gives a channel; null where it gives none or lacks a part."""
    if "color" not in channels.columns:
        return F.lit(None).cast("struct<r:int,g:int,b:int>")
    parts = [F.col(f"color.{n}").cast("int") for n in "rgb"]
    given = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(given, F.struct(*[p.alias(n) for p, n in zip(parts, "rgb")]))


def resolve_colors(channels: DataFrame) -> DataFrame:
    """Colour per channel: its own ``color``, else by emission, else palette; a cycle when all are equal.

    ``color`` is optional, and white counts as none.
    """
    white = _rgb(255, 255, 255)
    explicit = _explicit(channels)
    own = F.when(explicit != white, explicit).otherwise(emission_to_rgb(F.col("emission")))
    shown = channels.withColumn("_rgb", F.when(own == white, _palette(FALLBACK, F.col("c"))).otherwise(own))
    w = Window.partitionBy("img")
    same = (F.size(F.collect_set("_rgb").over(w)) == 1) & (F.count(F.lit(1)).over(w) > 1)
    rgb = F.when(same, _palette(CYCLE, F.col("c"))).otherwise(F.col("_rgb"))
    return shown.withColumn("_rgb", rgb).select(
        "img", "c", *[F.col(f"_rgb.{n}").alias(n) for n in "rgb"])


def classify_channels(channels: DataFrame) -> DataFrame:
    """Kind per image: ``rgb``, ``fluorescence`` or ``other``.

    ``rgb`` are three channels of those names, or whose ``color`` (optional) are ``RGB_CHANNELS``.
    """
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    g = channels.groupBy("img").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c", name.alias("n")))), lambda s: s["n"]).alias("names"),
        F.sort_array(F.collect_set(F.coalesce(_explicit(channels), _rgb(0, 0, 0)))).alias("colors"),
        F.bool_or((F.coalesce("emission", F.lit(0.0)) > 0) | name.rlike("|".join(MARKERS))).alias("marked"))
    as_list = lambda *n: F.array(*[F.lit(x) for x in n])
    rgb = (F.col("names") == as_list("r", "g", "b")) | (F.col("names") == as_list("red", "green", "blue"))
    shown = F.sort_array(F.array(*[_rgb(*c) for c in RGB_CHANNELS]))
    rgb |= (F.size("names") == 3) & (F.col("colors") == shown)
    return g.select("img", F.when(rgb, F.lit("rgb")).when(F.col("marked"), F.lit("fluorescence"))
                    .otherwise(F.lit("other")).alias("kind"))
