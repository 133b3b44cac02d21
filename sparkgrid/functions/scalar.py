"""Scalar derivations as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


# Name -> refractive index.
IMMERSION_INDEX = {"air": 1.0003, "water": 1.333, "oil": 1.515}
SAMPLE_INDEX = {
    "water": 1.333, "pbs": 1.334, "culture medium": 1.337, "vectashield": 1.45,
    "prolong gold": 1.47, "glycerol": 1.474, "oil": 1.515, "prolong glass": 1.52,
}
# Vendor acquisition mode -> microscope type.
ACQUISITION_MODE = {
    "LASER_SCANNING_CONFOCAL_MICROSCOPY": "confocal", "SPINNING_DISK_CONFOCAL": "confocal",
    "SLIT_SCAN_CONFOCAL": "confocal", "MULTI_PHOTON_MICROSCOPY": "confocal",
    "WIDE_FIELD": "widefield", "OTHER": "widefield",
}


def lookup(c: Column, table: dict) -> Column:
    """Value of a small literal map, null when the key is absent."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def parse_choice(c: Column, table: dict[str, float]) -> Column:
    """``"oil (1.515)"`` by name, else a bare number, else null."""
    text = F.lower(F.trim(c))
    name = F.trim(F.split_part(text, F.lit("("), F.lit(1)))
    return F.coalesce(lookup(name, table), text.try_cast("double"))


def parse_float_list(c: Column, default: str) -> Column:
    """Comma-separated numbers; null, blank and ``auto`` give the default list."""
    text = F.trim(c)
    text = F.when(text.isNull() | (text == "") | (F.lower(text) == "auto"), F.lit(default)).otherwise(text)
    parts = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    vals = F.transform(parts, lambda s: s.cast("double"))
    return F.when(F.size(vals) > 0, vals).otherwise(F.array(F.lit(float(default.split(",")[0]))))


def parse_float_list_lenient(c: Column) -> Column:
    """Comma-separated numbers; words that are not numbers are skipped."""
    vals = F.transform(F.split(c, ","), lambda s: F.trim(s).try_cast("double"))
    return F.filter(vals, lambda v: v.isNotNull() & ~F.isnan(v))


def parse_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def per_channel_param(values: Column, c: Column) -> Column:
    """The channel's own entry, or the last one for channels beyond the list."""
    return F.element_at(values, F.least(c + 1, F.size(values)))


def emission_to_rgb(nm: Column) -> Column:
    """Visible-spectrum colour of a wavelength; white when unknown or invisible."""
    # Segment bounds in nm.
    within = lambda a, b: (nm >= a) & (nm < b)
    up = lambda a, b: (nm - a) / (b - a)
    down = lambda a, b: (b - nm) / (b - a)
    red = F.when(within(380, 440), down(380, 440)).when(within(510, 580), up(510, 580)).when(
        within(580, 645) | nm.between(645, 780), F.lit(1.0)).otherwise(F.lit(0.0))
    green = F.when(within(440, 490), up(440, 490)).when(within(490, 580), F.lit(1.0)).when(
        within(580, 645), down(580, 645)).otherwise(F.lit(0.0))
    blue = F.when(within(380, 490), F.lit(1.0)).when(within(490, 510), down(490, 510)).otherwise(F.lit(0.0))
    seen = nm.isNotNull() & nm.between(380, 780)
    band = lambda b: F.when(seen, F.floor(b * 255)).otherwise(F.lit(255)).cast("int")
    return F.struct(band(red).alias("r"), band(green).alias("g"), band(blue).alias("b"))


def kernel_size(nm: Column, na: Column, px_nm: Column) -> Column:
    """Odd lateral kernel size covering four Airy radii, at least 65."""
    # 4 x 0.61 as a fraction: 2.44 is no double, and 2.44 x 460 would fall below 1122.4
    half = F.floor(nm * 244 / 100 / na / px_nm)
    size = F.greatest(2 * half + 1, F.lit(64))
    return (size + F.when(size % 2 == 0, 1).otherwise(0)).cast("long")


def axial_step(nm: Column, na: Column, ri: Column, px_nm: Column) -> Column:
    """Nyquist axial step in nm, at most 1000 and at least half a pixel."""
    a = F.greatest(na, F.lit(1e-6))
    n = F.greatest(ri, a + 1e-6)
    gap = F.greatest(n - F.sqrt(F.greatest(n * n - a * a, F.lit(1e-9))), F.lit(1e-6))
    return F.greatest(F.least(nm / (2.0 * gap), F.lit(1000.0)), px_nm / 2.0)


def window_level(v: Column, lo: Column, hi: Column, gamma: Column, mode: str = "additive", gain: float = 1.0) -> Column:
    """Contrast window, gamma and transfer curve, clipped to 0..1."""
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    n = F.pow(clip((v - lo) / span, 0, 1), 1 / F.greatest(gamma, F.lit(1e-3)))
    if mode == "translucent":
        n = F.sqrt(n) * gain
    elif mode == "average":
        n = 1 - F.exp(F.pow(n, 0.7) * (-1.8 * gain))
    else:
        n = n * gain
    return clip(n, 0, 1)


def anscombe(v: Column) -> Column:
    """Variance-stabilising transform of Poisson counts."""
    return 2.0 * F.sqrt(F.greatest(v, F.lit(0.0)) + 0.375)


def inverse_anscombe(y: Column) -> Column:
    """Algebraic inverse, clamped at zero."""
    return F.greatest((y / 2.0) * (y / 2.0) - 0.375, F.lit(0.0))


def damping_exponent(p: Column, sigma: Column, strength: float, bg: Column) -> Column:
    """Exponent in [1e-3, 1] that holds back corrections near the background."""
    scale = F.greatest(sigma * strength, F.lit(1e-12))
    return clip(1 - F.exp(-F.greatest(p - bg, F.lit(0.0)) / scale), 1e-3, 1.0)


def damped(correction: Column, gamma: Column) -> Column:
    return F.pow(F.greatest(correction, F.lit(1e-12)), gamma)
