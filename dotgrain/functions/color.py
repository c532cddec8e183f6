"""Colour: sRGB, luma, OKLab, HSL, hex and density, as Column expressions on channels from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]

# The OKLab matrices and the luma weights.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
FROM_LAB = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.291485548))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.707614701))
LUMA = {"luma709": (0.2126, 0.7152, 0.0722), "luma601": (0.299, 0.587, 0.114)}


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def byte(v: Column) -> Column:
    """Rounded half to even into 0..255, as a clamped byte array does."""
    return F.rint(clamp(v, 0, 255)).cast("int")


def srgb_to_linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    """0..1, clamped."""
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def _sum(row: tuple[float, ...], values: tuple[Column, ...]) -> Column:
    out = values[0] * row[0]
    for w, v in zip(row[1:], values[1:], strict=True):
        out = out + v * w
    return out


def luma(rgb: RGB, mode: str = "luma709") -> Column:
    """0..1. Unknown modes count as luma709; perceptual is CIE lightness over 100."""
    if mode == "perceptual":
        y = _sum(LUMA["luma709"], tuple(map(srgb_to_linear, rgb)))
        return F.when(y > 0.008856451679, (116.0 * F.cbrt(y) - 16.0) / 100.0).otherwise(y * 903.2962962 / 100.0)
    return _sum(LUMA.get(mode, LUMA["luma709"]), rgb) / 255.0


def rgb_to_oklab(rgb: RGB) -> RGB:
    linear = tuple(map(srgb_to_linear, rgb))
    lms = tuple(F.cbrt(_sum(row, linear)) for row in TO_LMS)
    return tuple(_sum(row, lms) for row in TO_LAB)


def oklab_to_rgb(lab: RGB) -> RGB:
    """Bytes."""
    light, a, b = lab
    lms = tuple(F.pow(light + a * p + b * q, F.lit(3.0)) for p, q in FROM_LAB)
    return tuple(clamp(half_up(linear_to_srgb(_sum(row, lms)) * 255.0), 0, 255).cast("int") for row in FROM_LMS)


def rgb_to_hsl(rgb: RGB) -> RGB:
    r, g, b = (c / 255.0 for c in rgb)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = high - low, (high + low) / 2
    grey = d <= 1e-9
    s = F.when(grey, 0.0).when(light > 0.5, d / F.nullif(2 - high - low, F.lit(0.0))).otherwise(d / F.nullif(high + low, F.lit(0.0)))
    safe = F.when(grey, 1.0).otherwise(d)
    h = F.when(grey, 0.0).when(high == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(high == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0)
    return h / 6.0, s, light


def _hue(p: Column, q: Column, t: Column) -> Column:
    t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
    return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)


def hsl_to_rgb(hsl: RGB) -> RGB:
    h, s, light = hsl
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q
    put = lambda v: clamp(half_up(v * 255.0), 0, 255).cast("int")
    grey = put(light)
    return tuple(F.when(s <= 1e-9, grey).otherwise(put(_hue(p, q, h + k))) for k in (1 / 3, 0.0, -1 / 3))


def adjust(df: DataFrame, hue: float = 0, saturation: float = 1, brightness: float = 0, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Turns the hue, scales the saturation, lifts or lowers the lightness of three columns; without any change the
    input, unrounded. Steps are columns of their own: as one expression the code for it would be too long to compile."""
    if hue == 0 and saturation == 1 and brightness == 0:
        return df
    df = df.withColumns(dict(zip(("__h", "__s", "__l"), rgb_to_hsl(tuple(map(F.col, names))), strict=True)))
    k, light = brightness / 100.0, F.col("__l")
    light = clamp(light + (1 - light) * k, 0, 1) if k > 0 else clamp(light * (1 + k), 0, 1)
    turned = F.col("__h") + hue / 360.0
    df = df.withColumns({"__h": turned - F.floor(turned), "__s": clamp(F.col("__s") * float(saturation), 0, 1), "__l": light})
    new = hsl_to_rgb((F.col("__h"), F.col("__s"), F.col("__l")))
    return df.withColumns(dict(zip(names, new, strict=True))).drop("__h", "__s", "__l")


def density(rgb: RGB) -> RGB:
    """Optical density of each channel of a byte colour."""
    return tuple(-F.log10(F.greatest(F.lit(0.004), srgb_to_linear(c))) for c in rgb)


def to_hex(rgb: RGB) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("long")), 2, "0") for c in rgb))


def normalize_hex(text: Column) -> Column:
    """Upper-case #RRGGBB, null for anything else than #RGB or #RRGGBB (the # may be missing)."""
    bare = F.upper(F.regexp_replace(F.trim(text), "^#", ""))
    short = F.regexp_replace(bare, "(.)", "$1$1")
    return F.when(bare.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), bare)).when(bare.rlike("^[0-9A-F]{3}$"), F.concat(F.lit("#"), short))


def from_hex(text: Column) -> RGB:
    clean = normalize_hex(text)
    return tuple(F.conv(F.substring(clean, k, 2), 16, 10).cast("int") for k in (2, 4, 6))


def mix(one: RGB, two: RGB, t: float | Column) -> RGB:
    """The colour between two, in OKLab."""
    a, b = rgb_to_oklab(one), rgb_to_oklab(two)
    return oklab_to_rgb(tuple(x + (y - x) * t for x, y in zip(a, b, strict=True)))
