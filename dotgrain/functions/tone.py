"""Tone: curves and lookup tables (made at plan time), and the tone mapping expressions that use them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = list[tuple[float, float]]


def normalise_curve(points: list) -> Curve:
    """Finite points within 0..1, sorted, with steps of at least 1e-4; fewer than two give the identity."""
    good = []
    for p in points or []:
        try:
            x, y = float(p[0]), float(p[1])
        except (TypeError, ValueError, IndexError):
            continue
        if math.isfinite(x) and math.isfinite(y):
            good.append((min(1.0, max(0.0, x)), min(1.0, max(0.0, y))))
    out: Curve = []
    for x, y in sorted(good, key=lambda p: p[0]):
        if not out or x - out[-1][0] >= 1e-4:
            out.append((x, y))
    return out if len(out) > 1 else [(0.0, 0.0), (1.0, 1.0)]


def is_identity_curve(points: Curve) -> bool:
    return all(abs(x - y) <= 0.002 for x, y in points)


def eval_curve(points: Curve, x: float) -> float:
    """Monotone cubic (Fritsch-Carlson) through the points, flat beyond the ends, within 0..1."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    if x <= xs[0]:
        return ys[0]
    if x >= xs[-1]:
        return ys[-1]
    d = [(b - a) / (v - u) for a, b, u, v in zip(ys, ys[1:], xs, xs[1:], strict=False)]
    m = [d[0], *(0.0 if p * q <= 0 else (p + q) / 2 for p, q in zip(d, d[1:], strict=False)), d[-1]]
    for i, slope in enumerate(d):
        if slope == 0:
            m[i] = m[i + 1] = 0.0
        elif (h := math.hypot(m[i] / slope, m[i + 1] / slope)) > 3:
            m[i], m[i + 1] = m[i] * 3 / h, m[i + 1] * 3 / h
    i = max(k for k in range(len(d)) if xs[k] <= x)
    w = xs[i + 1] - xs[i]
    t = (x - xs[i]) / w
    v = (2 * t**3 - 3 * t**2 + 1) * ys[i] + (t**3 - 2 * t**2 + t) * w * m[i] + (3 * t**2 - 2 * t**3) * ys[i + 1] + (t**3 - t**2) * w * m[i + 1]
    return min(1.0, max(0.0, v))


def tone_lut(black: float = 0, white: float = 255, gamma: float = 1, contrast: float = 1, exposure: float = 0, curve: list | None = None) -> list[float]:
    """256 values: levels, gamma, contrast about the middle, exposure, curve."""
    low = min(254.0, max(0.0, black))
    high = min(255.0, max(low + 1, white))
    gamma, contrast = min(8.0, max(0.05, gamma)), min(4.0, max(0.0, contrast))
    points = normalise_curve(curve or [])
    clamp = lambda v: min(1.0, max(0.0, v))
    out = []
    for i in range(256):
        v = clamp((clamp((i - low) / (high - low)) ** (1 / gamma) - 0.5) * contrast + 0.5 + exposure / 100)
        out.append(v if is_identity_curve(points) else eval_curve(points, v))
    return out


def is_identity_lut(lut: list[float]) -> bool:
    return all(abs(lut[i] - i / 255) <= 0.004 for i in range(0, 256, 17))


def sample_lut(lut: list[float], v: Column) -> Column:
    """Between two entries in proportion; v from 0 to 1."""
    table = F.array(*map(F.lit, map(float, lut)))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255.0
    low = F.floor(at).cast("int")
    a, b = F.element_at(table, low + 1), F.element_at(table, F.least(low + 1, F.lit(255)) + 1)
    return a + (b - a) * (at - low)


def tone_bytes(lut: list[float], invert: bool = False) -> list[int]:
    made = [math.floor(min(255.0, max(0.0, v * 255)) + 0.5) for v in lut]
    return [255 - v for v in made] if invert else made


def bias(v: Column, amount: float) -> Column:
    """Schlick's bias; 0 and 1 stay, and so does all for an amount of 0."""
    if not amount:
        return v
    b = 0.5 + min(0.98, max(-0.98, amount)) / 2
    k = 1 / b - 2
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).otherwise(v / (k * (1 - v) + 1))


def ink_to_radius(ink: Column, most: float | Column, curve: float = 0) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ink))
    return (F.sqrt(v) * (1 - curve) + v * curve) * most


def zone_bands(n: int, shadow: float, highlight: float) -> list[tuple[int, int]] | None:
    """Ranges of palette entries for shadows, middle tones and highlights; None for fewer than three entries."""
    if n < 3:
        return None
    s, h = sorted(min(1.0, max(0.0, v)) for v in (shadow, highlight))
    first = min(max(math.floor(n * s + 0.5), 1), n - 2)
    second = min(max(math.floor(n * h + 0.5), first + 1), n - 1)
    over = 1 if n >= 4 else 0
    return [(0, min(n, first + over)), (max(0, first - over), min(n, second + over)), (max(0, second - over), n)]
