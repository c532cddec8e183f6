"""Box and Gaussian blur by window frames, sharpening and denoising.

The horizontal and the vertical passes commute, so all horizontal ones run first: two exchanges, not six.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color


def _box(names: list[str], axis: str, other: str, n: int, r: int):
    lines = Window.partitionBy("image_id", other).orderBy(axis)
    frame, whole = lines.rowsBetween(-r, r), lines.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, zero = F.col(axis), F.lit(0)
    before, after = F.greatest(zero, r - at), F.greatest(zero, at - (n - 1 - r))

    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        return (F.sum(v).over(frame) + before * F.first(v).over(whole) + after * F.last(v).over(whole)) / (2 * r + 1)

    return {c: one(c) for c in names}


def box(px: DataFrame, axis: str, n: int, r: int, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The mean over 2 r + 1 pixels along x or y, the edges' pixels repeated beyond them. n: pixels along the axis."""
    return px.withColumns(_box(list(names), axis, "y" if axis == "x" else "x", n, r)) if r >= 1 else px


def box_sizes(sigma: float, n: int = 3) -> list[int]:
    """Widths of n boxes that together come near a Gaussian."""
    low = math.floor(math.sqrt(12 * sigma * sigma / n + 1))
    low -= low % 2 == 0
    m = math.floor((12 * sigma * sigma - n * low * low - 4 * n * low - 3 * n) / (-4 * low - 4) + 0.5)
    return [low if i < m else low + 2 for i in range(n)]


def gaussian(px: DataFrame, w: int, h: int, sigma: float, rounded: bool = True) -> DataFrame:
    """Three box passes each way; alpha stays."""
    if sigma <= 0.05 or min(w, h) < 2:
        return px
    radii = [min((k - 1) // 2, (min(w, h) - 1) // 2) for k in box_sizes(sigma)]
    for axis, n in (("x", w), ("y", h)):
        for r in radii:
            px = box(px, axis, n, r)
    return px.withColumns({c: color.byte(F.col(c)).cast("long") for c in "rgb"}) if rounded else px


def _with_blur(px: DataFrame, w: int, h: int, sigma: float) -> DataFrame:
    """px with r0, g0, b0 as given and r, g, b blurred."""
    return gaussian(px.withColumns({f"{c}0": F.col(c) for c in "rgb"}), w, h, sigma)


def unsharp(px: DataFrame, w: int, h: int, amount: float, sigma: float, threshold: float = 3) -> DataFrame:
    if amount <= 0:
        return px
    both = _with_blur(px, w, h, sigma)
    diff = {c: F.col(f"{c}0") - F.col(c) for c in "rgb"}
    out = {c: F.when(F.abs(d) < threshold, F.col(f"{c}0")).otherwise(color.byte(F.col(f"{c}0") + d * (amount / 100))).cast("long") for c, d in diff.items()}
    return both.withColumns(out).drop("r0", "g0", "b0")


def denoise(px: DataFrame, w: int, h: int, amount: float, sigma: float = 1.6) -> DataFrame:
    """Flat parts go to their blur, edges stay."""
    if amount <= 0:
        return px
    s = min(1.0, amount / 100)
    limit = 4 + s * 44
    both = _with_blur(px, w, h, sigma)
    far = F.greatest(*(F.abs(F.col(f"{c}0") - F.col(c)) for c in "rgb"))
    t = F.when(far >= limit, 0.0).otherwise(1 - (far / limit) * (far / limit)) * s
    return both.withColumns({c: color.byte(F.col(f"{c}0") * (1 - t) + F.col(c) * t).cast("long") for c in "rgb"}).drop("r0", "g0", "b0")


def preprocess(px: DataFrame, w: int, h: int, noise: float = 0, blur: float = 0, sharpen: float = 0, radius: float = 2) -> DataFrame:
    """Denoise, blur, sharpen; radii follow the picture's size."""
    k = max(w, h) / 1000
    px = denoise(px, w, h, noise, max(0.8, 1.6 * k))
    px = gaussian(px, w, h, blur * k)
    return unsharp(px, w, h, sharpen, max(0.5, radius * k))
