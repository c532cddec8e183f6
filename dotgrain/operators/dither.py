"""Dithering: ordered by threshold matrices (expressions), error diffusion (one ordered scan an image)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, tone
from ..functions.kernels import KERNELS, TOTALS
from ..functions.matrices import ORDERED
from .palette import Palette, best_mix, lab, luma709, nearest

INDEX = "image_id string, x long, y long, idx int"


def threshold(name: str, x: Column, y: Column) -> Column:
    """The matrix's value at a pixel, from a literal array: no join."""
    m = ORDERED[name]()
    n = m.shape[0]
    return F.element_at(F.array(*(F.lit(float(v)) for v in m.ravel())), (y % n * n + x % n + 1).cast("int"))


@dataclass(frozen=True)
class Zones:
    """Palette ranges for shadows, middle tones and highlights, by luma."""

    shadow: float
    highlight: float
    ranges: tuple[tuple[int, int], ...]

    @classmethod
    def make(cls, count: int, shadow: float, highlight: float) -> Zones | None:
        bands = tone.zone_bands(count, shadow, highlight)
        return cls(*sorted((shadow, highlight)), tuple(bands)) if bands else None

    def __call__(self, v: float) -> tuple[int, int]:
        return self.ranges[0 if v < self.shadow else 1 if v < self.highlight else 2]


def ordered(px: DataFrame, palette: Palette, name: str, strength: float = 1, zones: Zones | None = None) -> DataFrame:
    """image_id, x, y, idx: the nearest entry, or its best partner where the threshold is below the partner's share."""
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    ranges = zones.ranges if zones else ((0, len(palette)),)
    zone = F.lit(0)
    if zones:
        px = px.withColumn("__v", color.luma(rgb))
        zone = F.when(F.col("__v") < zones.shadow, 0).when(F.col("__v") < zones.highlight, 1).otherwise(2)
    px = px.withColumn("__z", zone)

    def by_zone(made):
        out = made(0, *ranges[0])
        for k, r in enumerate(ranges[1:], 1):
            out = F.when(F.col("__z") == k, made(k, *r)).otherwise(out)
        return out

    px = px.withColumn("__a", by_zone(lambda _, a, b: nearest(rgb, palette, a, b)))
    if name == "threshold":
        return px.select("image_id", "x", "y", F.col("__a").alias("idx"))

    def mixed(_: int, a: int, b: int) -> Column:
        pair = None
        for i in range(a, b):
            j, t = best_mix(rgb, palette, i, a, b)
            own = F.struct(j.alias("j"), t.alias("t"))
            pair = F.when(F.col("__a") == i, own) if pair is None else pair.when(F.col("__a") == i, own)
        return pair

    px = px.withColumn("__m", by_zone(mixed))
    t = F.col("__m.t")
    if strength != 1:
        t = t + (F.when(t < 0.5, 0.0).otherwise(1.0) - t) * (1 - strength)
    return px.select("image_id", "x", "y", F.when(threshold(name, F.col("x"), F.col("y")) < t, F.col("__m.j")).otherwise(F.col("__a")).alias("idx"))


_LINEAR = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in range(256)]


def diffuse(rgb: np.ndarray, palette: Palette, kernel: str = "floydsteinberg", strength: float = 1, serpentine: bool = True, zones=None) -> np.ndarray:
    """Indices of one picture (h, w, 3). zones: luma -> (first, stop) of the entries allowed.

    The scan is a chain, pixel by pixel, so it runs on plain numbers: arrays of three would cost more than they hold.
    Only as many lines of errors are held as the kernel reaches.
    """
    h, w, _ = rgb.shape
    labs, colours_ = [lab(c) for c in palette], [tuple(map(float, c)) for c in palette]
    (l0, l1, l2), (m0, m1, m2), (s0, s1, s2) = color.TO_LMS
    (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = color.TO_LAB
    total = TOTALS[kernel]
    taps = [(dx, dy, weight / total) for dx, dy, weight in KERNELS[kernel]]
    reach = max(dy for _, dy, _ in taps) + 1
    errors = [[[0.0, 0.0, 0.0] for _ in range(w)] for _ in range(reach)]
    cbrt, every = math.cbrt, range(len(palette))
    out = np.zeros((h, w), np.int32)
    for y in range(h):
        forward = not serpentine or y % 2 == 0
        step = 1 if forward else -1
        line, mine, chosen = rgb[y].tolist(), errors[0], [0] * w
        for x in range(w) if forward else range(w - 1, -1, -1):
            (r, g, b), (er, eg, eb) = line[x], mine[x]
            r, g, b = min(255.0, max(0.0, r + er * strength)), min(255.0, max(0.0, g + eg * strength)), min(255.0, max(0.0, b + eb * strength))
            lr, lg, lb = _LINEAR[int(r)], _LINEAR[int(g)], _LINEAR[int(b)]  # colours are matched by their bytes
            u, v, t = cbrt(l0 * lr + l1 * lg + l2 * lb), cbrt(m0 * lr + m1 * lg + m2 * lb), cbrt(s0 * lr + s1 * lg + s2 * lb)
            light, p, q = a0 * u + a1 * v + a2 * t, b0 * u + b1 * v + b2 * t, c0 * u + c1 * v + c2 * t
            best, least = 0, math.inf
            for i in every if zones is None else range(*zones(luma709((r, g, b)))):
                k = labs[i]
                d = (light - k[0]) ** 2 + (p - k[1]) ** 2 + (q - k[2]) ** 2
                if d < least:
                    best, least = i, d
            chosen[x] = best
            k = colours_[best]
            er, eg, eb = r - k[0], g - k[1], b - k[2]
            for dx, dy, weight in taps:
                at = x + dx * step
                if 0 <= at < w:
                    e = errors[dy][at]
                    e[0] += er * weight
                    e[1] += eg * weight
                    e[2] += eb * weight
        out[y] = chosen
        errors = [*errors[1:], [[0.0, 0.0, 0.0] for _ in range(w)]]
    return out


def diffusion(px: DataFrame, palette: Palette, kernel: str = "floydsteinberg", strength: float = 1, serpentine: bool = True, zones: Zones | None = None) -> DataFrame:
    """Error diffusion of each image. A scan can't be cut, so an image is one task; many images run side by side.
    Every pixel of the rectangle from 0, 0 must be there."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y = (np.asarray(t.column(c).combine_chunks()) for c in "xy")
        picture = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3))
        picture[y, x] = np.stack([np.asarray(t.column(c).combine_chunks()) for c in "rgb"], 1)
        idx = diffuse(picture, palette, kernel, strength, serpentine, zones)
        return pa.table({"image_id": pa.array([key[0].as_py()] * len(x), pa.string()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "idx": pa.array(idx[y, x], pa.int32())})

    return px.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInArrow(run, INDEX)


def dither(px: DataFrame, palette: Palette, name: str = "floydsteinberg", strength: float = 1, serpentine: bool = True, zones: Zones | None = None) -> DataFrame:
    """By any of the 24 algorithms; unknown names count as floydsteinberg."""
    if name in ORDERED:
        return ordered(px, palette, name, strength, zones)
    return diffusion(px, palette, name if name in KERNELS else "floydsteinberg", strength, serpentine, zones)


def expand(index: DataFrame, w: int, h: int, ow: int, oh: int, view: tuple[int, int, int, int] | None = None) -> DataFrame:
    """x, y, idx of an output of ow by oh pixels, or of a view (left, top, width, height) of it, by the nearest source."""
    left, top, vw, vh = view or (0, 0, ow, oh)
    n = index.sparkSession.range(vw * vh)
    out = n.select((F.col("id") % vw).alias("x"), F.floor(F.col("id") / vw).alias("y"))
    source = lambda c, low, size, osize: F.least(F.lit(size - 1), F.floor((F.col(c) + low) * size / osize))
    out = out.withColumns({"sx": source("x", left, w, ow), "sy": source("y", top, h, oh)})
    return out.join(index.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "idx"), ["sx", "sy"]).select("image_id", "x", "y", "idx")


def colours(index: DataFrame, palette: Palette) -> DataFrame:
    """Indices to pixels; an index beyond the palette takes the first entry."""
    at = F.when(F.col("idx").between(0, len(palette) - 1), F.col("idx")).otherwise(0) + 1
    put = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in palette)), at).cast("long")
    return index.select("image_id", "x", "y", *(put(k).alias(c) for k, c in enumerate("rgb")), F.lit(255).cast("long").alias("a"))


def masks(index: DataFrame, count: int) -> DataFrame:
    """image_id, plate, x, y, v: 255 where a pixel has the plate's index, else 0."""
    plates = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    return index.withColumn("plate", plates).select("image_id", "plate", "x", "y", F.when(F.col("idx") == F.col("plate"), 255).otherwise(0).alias("v"))


def analysis_size(longest: int, mode: str, resolution: float, most: int | None = None) -> int:
    """The longest edge that a picture is worked on at."""
    if mode == "dither":
        return max(8, math.floor(min(longest, resolution, *([most] if most else [])) + 0.5))
    return math.floor(min(longest, min(3000, max(480, resolution * 8))) + 0.5)
