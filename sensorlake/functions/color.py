"""Colour and tone expressions (8-bit channel values in, Columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gli(r: Column, g: Column, b: Column) -> Column:
    """Green leaf index, 0 where the denominator vanishes."""
    r, g, b = r.cast("double"), g.cast("double"), b.cast("double")
    den = 2.0 * g + r + b
    return F.when(den > 1e-6, (2.0 * g - r - b) / den).otherwise(F.lit(0.0))


def gli_u8(r: Column, g: Column, b: Column) -> Column:
    return clip((gli(r, g, b) + 1.0) * 127.5, 0.0, 255.0).cast("int")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """STRUCT<h, s, v> with hue in half degrees (0..179), saturation and value in 0..255."""
    r, g, b = r.cast("double"), g.cast("double"), b.cast("double")
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    deg = (
        F.when(d == 0, F.lit(0.0))
        .when(v == r, 60.0 * (g - b) / d)
        .when(v == g, 120.0 + 60.0 * (b - r) / d)
        .otherwise(240.0 + 60.0 * (r - g) / d)
    )
    h = F.pmod(F.bround(F.when(deg < 0, deg + 360.0).otherwise(deg) / 2.0), F.lit(180.0)).cast("int")
    s = F.when(v > 0, F.bround(255.0 * d / v)).otherwise(F.lit(0.0)).cast("int")
    return F.struct(h.alias("h"), s.alias("s"), v.cast("int").alias("v"))


# Gates on half-degree hue, saturation and value.
GREEN_HUE = (25, 100)
GREEN_MIN_SATURATION = 25
BRIGHT_VALUE = 230
PALE_SATURATION = 55


def is_green(h: Column) -> Column:
    return (h["h"] > GREEN_HUE[0]) & (h["h"] < GREEN_HUE[1]) & (h["s"] > GREEN_MIN_SATURATION)


def is_bright_pale(h: Column) -> Column:
    """Specular or panel-like pixels that must not colour the ground."""
    return (h["v"] > BRIGHT_VALUE) & (h["s"] < PALE_SATURATION)


def stretch_u8(x: Column, lo: Column, hi: Column, slack: float = 0.0) -> Column:
    """Linear stretch to 0..255, truncated; an empty range counts as width 1, NaN gives 0.

    ``slack`` is added before truncating, for ``x`` with rounding errors: what falls short of a whole step by less reaches it.
    """
    top = F.when(hi <= lo, lo + 1.0).otherwise(hi)
    y = clip((x - lo) * 255.0 / (top - lo), 0.0, 255.0)
    return F.coalesce(F.when(~F.isnan(x), y + slack), F.lit(0.0)).cast("int")


def gamma_curve(x: Column, lo: Column, hi: Column, gamma: float, empty: float = 1.0) -> Column:
    """``clip01((x - lo) / (hi - lo)) ** gamma``; ``empty`` replaces a vanishing range."""
    width = F.when(hi <= lo, F.lit(empty)).otherwise(hi - lo)
    return F.pow(clip((x - lo) / width, 0.0, 1.0), F.lit(gamma))


def red_green_signal(r: Column, g: Column) -> Column:
    """Warm minus green, the panel cue in colour-mapped thermal frames."""
    return r.cast("double") - g.cast("double")


def depth_mm(z: Column) -> Column:
    """Metres to u16 millimetres."""
    return clip(z * 1000.0, 0.0, 65535.0).cast("int")
