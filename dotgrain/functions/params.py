"""The parameters of a rendering: keys, kinds, ranges, defaults (fixed values, in sections)."""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matrices import ALGORITHMS

VERSION = 2


class Param(NamedTuple):
    section: str
    key: str
    kind: str
    default: Any
    low: float = 0
    high: float = 0
    choices: tuple = ()


def _n(section: str, key: str, default: float, low: float, high: float) -> Param:
    return Param(section, key, "number", default, low, high)


def _e(section: str, key: str, default: str, *choices: str) -> Param:
    return Param(section, key, "enum", default, choices=choices)


def _b(section: str, key: str, default: bool) -> Param:
    return Param(section, key, "bool", default)


PARAMS = (
    _e("mode", "mode", "halftone", "halftone", "dither"),
    _e("scale", "scaleMode", "relative", "relative", "dpi"),
    _n("scale", "dpi", 150, 5, 300), _n("scale", "density", 90, 8, 400), _n("scale", "ditherResolution", 400, 24, 2400), _n("scale", "angle", 0, 0, 90),
    _n("halftone", "radius", 100, 0, 200), _n("halftone", "radiusCurve", 0, 0, 1),
    _e("halftone", "shape", "circle", "circle", "ellipse", "square", "diamond", "cross", "line"),
    _n("halftone", "dotGain", 0, 0, 40), _e("halftone", "screenType", "am", "am", "fm"), _e("halftone", "screenMode", "single", "single", "perInk"),
    _n("halftone", "screenSpread", 1, 0, 1), _b("halftone", "edgeAware", False),
    _e("dither", "ditherAlgorithm", "floydsteinberg", *ALGORITHMS), _n("dither", "ditherStrength", 1, 0, 1), _b("dither", "serpentine", True),
    _n("press", "jitterPosition", 0, 0, 100), _n("press", "jitterSize", 0, 0, 100), _n("press", "jitterAngle", 0, 0, 180),
    _n("press", "misregistration", 0, 0, 100), _n("press", "seed", 1, 1, 999),
    _n("preprocess", "blur", 0, 0, 40), _n("preprocess", "sharpen", 0, 0, 200), _n("preprocess", "sharpenRadius", 2, 0.3, 10), _n("preprocess", "noiseReduction", 0, 0, 100),
    _n("colors", "colorCount", 3, 2, 8), _n("colors", "spread", 0.35, 0, 1), _e("colors", "quantMethod", "kmeans", "kmeans", "mediancut", "popularity"),
    Param("colors", "palette", "colors", ("#161616", "#F5EBD8", "#EC3E32")), Param("colors", "lockedSwatches", "internal", ()),
    _b("colors", "paletteLocked", True), Param("colors", "background", "color", "auto"),
    _b("tonal", "tonalMapping", False), _n("tonal", "shadowSplit", 0.33, 0.05, 0.6), _n("tonal", "highlightSplit", 0.66, 0.4, 0.95),
    Param("grade", "toneCurve", "curve", ((0, 0), (1, 1))), _n("grade", "contrast", 1, 0, 3), _n("grade", "gamma", 1, 0.1, 3),
    _n("grade", "blackPoint", 0, 0, 254), _n("grade", "whitePoint", 255, 1, 255), _n("grade", "exposure", 0, -100, 100), _n("grade", "gradeBias", 0, -1, 1),
    _e("grade", "lumaMode", "luma709", "luma709", "luma601", "perceptual"),
    _n("adjust", "hue", 0, -180, 180), _n("adjust", "saturation", 1, 0, 3), _n("adjust", "brightness", 0, -100, 100), _b("adjust", "invert", False),
    _e("batch", "batchScope", "selection", "selection", "group", "document"), _b("batch", "batchSharedPalette", True),
    _b("output", "useSelection", True), _e("output", "output", "flat", "flat", "separated"),
)
DEFAULTS = {p.key: p.default for p in PARAMS}


def sanitized(raw: dict[str, Any]) -> dict[str, Any]:
    """One set of parameters: unknown keys go, missing ones get defaults, numbers are clamped, unknown choices ignored."""
    import math
    import re

    from .tone import normalise_curve

    hex_ = re.compile(r"#?([0-9a-fA-F]{3}|[0-9a-fA-F]{6})")

    def colour(v):
        if not isinstance(v, str) or not (m := hex_.fullmatch(v)):
            return None
        d = m[1].upper()
        return "#" + (d if len(d) == 6 else "".join(c * 2 for c in d))

    out = {}
    for p in PARAMS:
        v = raw.get(p.key)
        out[p.key] = p.default
        if p.kind == "number":
            try:
                out[p.key] = min(p.high, max(p.low, float(v))) if math.isfinite(float(v)) else p.default
            except (TypeError, ValueError):
                pass
        elif p.kind == "enum" and v in p.choices or p.kind == "bool" and isinstance(v, bool):
            out[p.key] = v
        elif p.kind == "colors" and isinstance(v, (list, tuple)):
            out[p.key] = tuple(c for c in map(colour, v) if c) or p.default
        elif p.kind == "color" and v is not None:
            out[p.key] = colour(v) or p.default
        elif p.kind == "curve" and v:
            out[p.key] = tuple(normalise_curve(list(v)))
    out["colorCount"] = int(min(8, max(2, math.floor(out["colorCount"] + 0.5))))
    if out["whitePoint"] <= out["blackPoint"]:
        out["whitePoint"] = min(255, out["blackPoint"] + 1)
    if out["highlightSplit"] <= out["shadowSplit"]:
        out["highlightSplit"] = min(0.95, out["shadowSplit"] + 0.05)
    return out


def resolution(params: dict[str, Any], longest: int, ppi: float) -> int:
    """Cells or grid pixels along the longest edge."""
    import math

    dither = params["mode"] == "dither"
    key = "ditherResolution" if dither else "density"
    if params["scaleMode"] != "dpi":
        return int(params[key])
    ppi = 72 if ppi <= 1 else ppi
    p = next(p for p in PARAMS if p.key == key)
    return int(min(p.high, max(p.low, math.floor(longest / ppi * params["dpi"] + 0.5))))


def same(one: dict[str, Any], two: dict[str, Any]) -> bool:
    """Whether two sets of settings mean the same: unknown keys and spellings don't count."""
    return sanitized(one) == sanitized(two)


def stepped(value: Column, step: float, low: float, high: float) -> Column:
    """A control's value on its steps (0: none), to six decimals, within its range."""
    on = F.floor(value / step + 0.5) * step if step else value
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.floor(on * 1e6 + 0.5) / 1e6))


def with_locked(extracted: list[str], current: list[str], locked: list[int]) -> list[str]:
    """Extracted swatches, but for the locked ones, which stay."""
    return [current[i] if i in locked and i < len(current) and current[i] else c for i, c in enumerate(extracted)]


def padded(swatches: list[str], count: int) -> list[str]:
    """As many swatches as asked for: the last one again, or grey if there is none."""
    kept = list(swatches[:count])
    return kept + [kept[-1] if kept else "#808080"] * (count - len(kept))
