"""Image, channel and plate metadata from JSON and XML columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLATE = ("struct<wells:array<struct<path:string,images:array<struct<path:string>>,"
         "children:map<string,string>>>>")

OME = ("struct<Instrument:array<struct<Objective:array<struct<_LensNA:double,_NominalMagnification:double,_Immersion:string>>>>,"
       "Image:array<struct<ObjectiveSettings:struct<_RefractiveIndex:double>,"
       "Pixels:struct<_PhysicalSizeX:double,_PhysicalSizeY:double,_PhysicalSizeZ:double,"
       "_SizeX:int,_SizeY:int,_SizeZ:int,_SizeC:int,_SizeT:int,"
       "Channel:array<struct<_Name:string,_EmissionWavelength:double,_ExcitationWavelength:double,"
       "_PinholeSize:double,_AcquisitionMode:string>>>>>>")


OBJECTIVES = "array<struct<_LensNA:double,_NominalMagnification:double,_Immersion:string>>"


def stem(name: Column) -> Column:
    """File name without its last suffix and without .tiff, .tif, .ome endings."""
    base = F.element_at(F.split(name, "/"), -1)
    out = F.regexp_replace(base, r"^(.+)\.[^.]+$", "$1")
    for ext in ("tiff", "tif", "ome"):
        out = F.regexp_replace(out, rf"(?i)\.{ext}$", "")
    return out


def output_names(df: DataFrame, projection: str = "none", col: str = "name") -> DataFrame:
    """Result file name per input; projected outputs carry the projection."""
    suffix = {"mip": "_mip-proj", "sum": "_sum-proj"}.get(projection.strip().lower(), "")
    return df.withColumn("output", F.concat(stem(F.col(col)), F.lit(f"_decon{suffix}.ome.tiff")))


def plate_fields(df: DataFrame, col: str = "attrs") -> DataFrame:
    """One row per (plate, row, col, field) of plate attribute documents.

    Wells without an ``images`` list fall back to their numeric children, in
    sorted order.  Positions are kept, so a first field can be chosen.
    """
    well = (
        df.withColumn("_p", F.from_json(col, PLATE))
        .select("plate", F.posexplode_outer("_p.wells").alias("well_pos", "w"))
    )
    digits = F.array_sort(F.filter(F.map_keys("w.children"), lambda k: k.rlike("^[0-9]+$")))
    listed = F.transform(F.col("w.images"), lambda i: i["path"])
    at = lambda i: F.element_at(F.split("w.path", "/"), i)
    return well.select(
        "plate", at(1).alias("row"), at(2).alias("col"), "well_pos",
        F.posexplode_outer(F.coalesce(listed, digits)).alias("field_pos", "field"))


def first_field(df: DataFrame, col: str = "attrs") -> DataFrame:
    """First field of every plate; a plate without any field fails the job."""
    pick = F.min_by(F.struct("row", "col", "field"), F.when(F.col("field").isNotNull(), F.struct("well_pos", "field_pos")))
    f = plate_fields(df, col).groupBy("plate").agg(pick.alias("f"), F.count("field").alias("n"))
    none = F.raise_error(F.concat(F.lit("no image fields in plate "), F.col("plate").cast("string"))).cast("string")
    return f.select("plate", *[F.when(F.col("n") > 0, F.col(f"f.{n}")).otherwise(none).alias(n) for n in ("row", "col", "field")])


def wells_index(fields: DataFrame) -> DataFrame:
    """Sorted fields per well."""
    return fields.groupBy("plate", "row", "col").agg(F.sort_array(F.collect_set("field")).alias("fields"))


def axis_scales_from_transforms(df: DataFrame, col: str = "arr") -> DataFrame:
    """Pixel sizes from the first ``scale`` transform of rank 5, 4 or 3."""
    s = F.get(F.filter(F.col(col), lambda t: t["type"] == "scale"), F.lit(0))["scale"]
    rank = F.size("_s")
    last = lambda k: F.when(rank.between(3, 5), F.element_at("_s", -k))
    return df.withColumn("_s", s).select(
        *[c for c in df.columns if c != col],
        F.when(rank.between(4, 5), F.element_at("_s", -3)).alias("pixel_size_z"),
        last(2).alias("pixel_size_y"), last(1).alias("pixel_size_x"))


def xml_metadata(df: DataFrame, col: str = "xml") -> DataFrame:
    """Objective, pixel sizes, shape and channels of OME-like XML documents: of the first objective and image."""
    x = df.withColumn("_d", F.from_xml(F.col(col), OME, {"ignoreNamespace": "true"}))
    first = lambda c: F.get(c, F.lit(0))
    objectives = F.flatten(F.transform("_d.Instrument", lambda i: F.coalesce(i["Objective"], F.array().cast(OBJECTIVES))))
    x = x.withColumn("_x", F.struct(first(objectives).alias("Objective"), first(F.col("_d.Image")).alias("Image")))
    obj, px = "_x.Objective", "_x.Image.Pixels"
    chans = F.transform(F.col(f"{px}.Channel"), lambda c: F.struct(
        c["_Name"].alias("name"), c["_EmissionWavelength"].alias("emission"),
        c["_ExcitationWavelength"].alias("excitation"), c["_PinholeSize"].alias("pinhole"),
        c["_AcquisitionMode"].alias("mode")))
    confocal = F.exists(F.col("channels"), lambda c: F.lower(F.coalesce(c["mode"], F.lit(""))).contains("confocal"))
    return x.select(
        *[c for c in df.columns if c != col],
        F.col(f"{obj}._LensNA").alias("na"), F.col(f"{obj}._NominalMagnification").alias("magnification"),
        F.col(f"{obj}._Immersion").alias("immersion"),
        F.col("_x.Image.ObjectiveSettings._RefractiveIndex").alias("refractive_index"),
        *[F.col(f"{px}._PhysicalSize{a.upper()}").alias(f"pixel_size_{a}") for a in "xyz"],
        *[F.coalesce(f"{px}._Size{a.upper()}", F.lit(0)).alias(f"size_{a}") for a in "xyzct"],
        F.coalesce(chans, F.array().cast("array<struct<name:string,emission:double,excitation:double,pinhole:double,mode:string>>"))
        .alias("channels"),
    ).withColumn("microscope_type", F.when(confocal, F.lit("confocal")).otherwise(F.lit("widefield")))


def infer_mode(channels: DataFrame) -> DataFrame:
    """An image is confocal when any of its channels is."""
    hit = F.bool_or(F.lower(F.coalesce("mode", F.lit(""))).contains("confocal"))
    return channels.groupBy("img").agg(
        F.when(hit, F.lit("confocal")).otherwise(F.lit("widefield")).alias("microscope_type"))


# What is assumed when neither file nor user give a value.
DEFAULTS = {"na": 1.4, "refractive_index": 1.515, "microscope_type": "widefield",
            "pixel_size_x": 0.065, "pixel_size_y": 0.065, "pixel_size_z": 0.2}


def resolve_metadata(
    df: DataFrame,
    user: Mapping[str, object],
    overrule: bool = True,
    defaults: Mapping[str, object] = DEFAULTS,
) -> DataFrame:
    """Merge file, user and default values; ``defaulted`` lists assumed keys."""
    cols, assumed = [], []
    for k in dict.fromkeys([*user, *defaults]):
        own = F.col(k) if k in df.columns else F.lit(None)
        given = F.lit(user.get(k))
        known = F.coalesce(given, own) if overrule else F.coalesce(own, given)
        cols.append(F.coalesce(known, F.lit(defaults.get(k))).alias(k))
        if defaults.get(k) is not None:
            assumed.append(F.when(known.isNull(), F.lit(k)))
    rest = [c for c in df.columns if c not in user and c not in defaults]
    return df.select(*rest, *cols, F.array_compact(F.array(*assumed)).alias("defaulted"))


def align_channels(images: DataFrame, channels: DataFrame) -> DataFrame:
    """Exactly ``n`` channel rows per image; gaps are named ``Ch{i}``."""
    slots = images.select("img", F.explode(
        F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))).alias("c"))
    joined = slots.join(channels, ["img", "c"], "left")
    return joined.withColumn("name", F.coalesce("name", F.concat(F.lit("Ch"), F.col("c"))))


# What is assumed without being reported as assumed, and the wavelength of an unknown channel.
QUIET_DEFAULTS = {"sample_refractive_index": 1.47}
DEFAULT_EMISSION = 520.0


def resolve_channels(
    channels: DataFrame,
    emission: Sequence[float | None] = (),
    excitation: Sequence[float | None] = (),
    overrule: bool = True,
    default: float = DEFAULT_EMISSION,
) -> DataFrame:
    """Merge lists of wavelengths by channel into aligned channel rows, and say where each value came from.

    The i-th value belongs to channel i; a null or missing one leaves the
    channel as the file has it.  With ``overrule=False`` the lists only fill
    gaps.  ``emission_from`` and ``excitation_from`` are ``file``, ``user``,
    ``default`` or null; only emission has a default.
    """
    def merged(name: str, values: Sequence[float | None], fallback: float | None) -> list[Column]:
        given = F.array(*[F.lit(v).cast("double") for v in values]) if values else F.array().cast("array<double>")
        user, own = F.get(given, F.col("c")), F.col(name).cast("double")
        first, second = ((user, "user"), (own, "file")) if overrule else ((own, "file"), (user, "user"))
        origin = F.when(first[0].isNotNull(), F.lit(first[1])).when(second[0].isNotNull(), F.lit(second[1]))
        origin = origin.otherwise(F.lit(None if fallback is None else "default"))
        return [F.coalesce(first[0], second[0], F.lit(fallback).cast("double")).alias(name), origin.alias(f"{name}_from")]

    rest = [c for c in channels.columns if c not in ("emission", "excitation")]
    return channels.select(*rest, *merged("emission", emission, default), *merged("excitation", excitation, None))


def resolve_all(
    images: DataFrame,
    channels: DataFrame,
    user: Mapping[str, object],
    emission: Sequence[float | None] = (),
    excitation: Sequence[float | None] = (),
    overrule: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Image rows and exactly ``n`` channel rows each, resolved; ``defaulted`` also tells of assumed wavelengths."""
    rows = resolve_channels(align_channels(images.select("img", "n"), channels), emission, excitation, overrule)
    merged = resolve_metadata(images, user, overrule)
    for key, value in QUIET_DEFAULTS.items():
        own = F.col(key).cast("double") if key in images.columns else F.lit(None).cast("double")
        given = F.lit(user.get(key)).cast("double")
        merged = merged.withColumn(key, F.coalesce(given, own, F.lit(value)) if overrule else F.coalesce(own, given, F.lit(value)))
    assumed = rows.groupBy("img").agg(F.bool_or(F.col("emission_from") == "default").alias("_assumed"))
    merged = merged.join(assumed, "img", "left").withColumn("defaulted", F.when(
        F.coalesce("_assumed", F.lit(False)), F.array_append("defaulted", F.lit("emission_wavelength"))).otherwise(F.col("defaulted"))).drop("_assumed")
    return merged, rows


def metadata_documents(images: DataFrame, channels: DataFrame) -> DataFrame:
    """Result metadata per image: padded names, known wavelengths, description, and the whole as a JSON document.

    The document has the axes, the pixel sizes with their unit, the lists of
    known values, and under ``Channels`` every channel with its place, so that
    a gap in the wavelengths does not shift those behind it.
    """
    rows = align_channels(images.select("img", "n"), channels)
    ordered = F.array_sort(F.collect_list(F.struct("c", "name", "emission", "excitation")))
    lists = rows.groupBy("img").agg(ordered.alias("ch"))
    known = lambda n: F.filter(F.transform("ch", lambda s: s[n]), lambda v: v.isNotNull())
    part = lambda c, fmt: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{fmt}="), F.col(c).cast("string")))
    text = F.concat_ws(
        "; ", part("na", "NA"), part("refractive_index", "RI"), part("microscope_type", "Microscope"),
        F.concat(part("magnification", "Magnification"), F.lit("x")), part("immersion", "Immersion"))
    some = lambda n: F.when(F.size(known(n)) > 0, known(n))
    depth = F.col("size_z") if "size_z" in images.columns else F.lit(None).cast("int")
    axes = F.when(depth > 1, F.lit("CZYX")).otherwise(F.lit("CYX"))
    sizes = []
    for a in ("x", "y", "z"):
        size = F.col(f"pixel_size_{a}").cast("double") if f"pixel_size_{a}" in images.columns else F.lit(None).cast("double")
        sizes += [size.alias(f"PhysicalSize{a.upper()}"), F.when(size.isNotNull(), F.lit("µm")).alias(f"PhysicalSize{a.upper()}Unit")]
    return images.join(lists, "img", "left").select(
        "img", F.transform("ch", lambda s: s["name"]).alias("names"), known("emission").alias("emission"),
        known("excitation").alias("excitation"), text.alias("description"),
        F.to_json(F.struct(
            axes.alias("axes"), *sizes,
            F.struct(F.transform("ch", lambda s: s["name"]).alias("Name"), some("emission").alias("EmissionWavelength"),
                     some("excitation").alias("ExcitationWavelength")).alias("Channel"),
            F.transform("ch", lambda s: F.struct(
                s["c"].alias("Index"), s["name"].alias("Name"), s["emission"].alias("EmissionWavelength"),
                s["excitation"].alias("ExcitationWavelength"))).alias("Channels"),
            text.alias("Description"))).alias("document"))
