"""Palettes: nearest entry, mixes, quantisers, spread, paper."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .cells import opaque

Palette = list[tuple[int, int, int]]
#: Colours of the queries' own palette, dark to light.
INKS: Palette = [(26, 23, 27), (230, 0, 126), (0, 158, 224), (255, 237, 0), (245, 240, 225)]


def luma709(c: tuple[float, float, float]) -> float:
    return sum(w * v for w, v in zip(color.LUMA["luma709"], c, strict=True)) / 255


def lab(c: tuple[float, float, float]) -> tuple[float, float, float]:
    linear = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in c]
    lms = [math.cbrt(sum(w * v for w, v in zip(row, linear, strict=True))) for row in color.TO_LMS]
    return tuple(sum(w * v for w, v in zip(row, lms, strict=True)) for row in color.TO_LAB)


def nearest(rgb: color.RGB, palette: Palette, start: int = 0, stop: int | None = None) -> Column:
    """The entry that is nearest in OKLab; of equals the first. Distances are unrolled: no join, no lambda."""
    have = color.rgb_to_oklab(rgb)
    entries = []
    for i, entry in list(enumerate(palette))[start:stop]:
        d = [(h - v) for h, v in zip(have, lab(entry), strict=True)]
        entries.append(F.struct((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d"), F.lit(i).alias("i")))
    return (F.least(*entries) if len(entries) > 1 else entries[0])["i"]


def best_mix(rgb: color.RGB, palette: Palette, entry: int, start: int = 0, stop: int | None = None) -> tuple[Column, Column]:
    """The other entry (of a range) on whose line to this one the colour lies nearest, and how far along; the entry
    and 0 if none."""
    a = palette[entry]
    p = [c - v for c, v in zip(rgb, a, strict=True)]
    found = []
    for j, b in list(enumerate(palette))[start:stop]:
        d = [float(v - u) for u, v in zip(a, b, strict=True)]
        if j == entry or (n := sum(v * v for v in d)) < 1e-6:
            continue
        t = color.clamp((p[0] * d[0] + p[1] * d[1] + p[2] * d[2]) / n, 0, 1)
        e = [q - t * v for q, v in zip(p, d, strict=True)]
        found.append(F.struct((e[0] * e[0] + e[1] * e[1] + e[2] * e[2]).alias("e"), F.lit(j).alias("j"), t.alias("t")))
    if not found:
        return F.lit(entry), F.lit(0.0)
    best = F.least(*found) if len(found) > 1 else found[0]
    return best["j"], best["t"]


def stride_sample(px: DataFrame, w: int, h: int, most: int = 24_000) -> DataFrame:
    """Every k-th opaque pixel of every k-th line; most is a goal, not a limit."""
    k = max(1, math.floor(math.sqrt(w * h / most)))
    return opaque(px).where((F.col("x") % k == 0) & (F.col("y") % k == 0))


def popularity(px: DataFrame, count: int, bits: int = 4) -> DataFrame:
    """The most frequent colour cells and their rounded means: rank, n, r, g, b. One bounded row a cell."""
    s = 8 - bits
    key = sum(((F.shiftright(F.col(c).cast("int"), s) * (1 << bits * k)) for c, k in zip("rgb", (2, 1, 0), strict=True)), F.lit(0))
    groups = px.groupBy("image_id", key.alias("key")).agg(F.count(F.lit(1)).alias("n"), *(color.half_up(F.avg(c)).cast("long").alias(c) for c in "rgb"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "key"))
    return groups.withColumn("rank", rank).where(F.col("rank") <= count)


def median_cut(samples: np.ndarray, count: int) -> Palette:
    """Splits the box of the greatest range times log size at the median of its longest axis."""
    boxes = [np.arange(len(samples))]
    while len(boxes) < count:
        best, score = -1, -1.0
        for i, own in enumerate(boxes):
            if len(own) > 1 and (s := float(np.ptp(samples[own], 0).max()) * math.log2(len(own) + 1)) > score:
                best, score = i, s
        if best < 0:
            break
        own = boxes[best]
        own = own[np.argsort(samples[own, int(np.ptp(samples[own], 0).argmax())], kind="stable")]
        boxes[best : best + 1] = [own[: len(own) // 2], own[len(own) // 2 :]]
    return [tuple(int(v) for v in np.floor(samples[b].mean(0) + 0.5)) for b in boxes if len(b)]


def _lab_array(rgb: np.ndarray) -> np.ndarray:
    v = rgb / 255
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    return np.cbrt(linear @ np.array(color.TO_LMS).T) @ np.array(color.TO_LAB).T


def _rgb_array(labs: np.ndarray) -> np.ndarray:
    lms = (labs @ np.array([(1, *row) for row in color.FROM_LAB]).T) ** 3
    v = lms @ np.array(color.FROM_LMS).T
    v = np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)
    return np.floor(np.clip(v, 0, 1) * 255 + 0.5).astype(int)


def kmeans(samples: np.ndarray, count: int, rounds: int = 10) -> Palette:
    """Lloyd's rounds in OKLab from median-cut seeds; an empty cluster takes the sample that is farthest from its own."""
    different = np.unique(samples, axis=0)
    if len(different) <= count:
        return [tuple(map(int, c)) for c in different]
    x = _lab_array(samples.astype(float))
    centres = _lab_array(np.array(median_cut(samples, count), float))
    before = np.full(len(x), -1)
    for k in range(rounds):
        d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        own = d.argmin(1)
        moved, revived = bool((own != before).any()), False
        before = own
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = x[mine].mean(0)
            else:
                centres[c], revived = x[int(d.min(1).argmax())], True
        if k and not moved and not revived:
            break
    return [tuple(map(int, c)) for c in _rgb_array(centres)]


def _popular(samples: np.ndarray, count: int) -> Palette:
    key = (samples >> 4) @ np.array([256, 16, 1])
    names, own, n = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((names, -n))[:count]
    return [tuple(int(v) for v in np.floor(samples[own == k].mean(0) + 0.5)) for k in order]


QUANTISERS = {"kmeans": kmeans, "mediancut": median_cut, "popularity": _popular}


def quantise(samples: np.ndarray, count: int, method: str = "kmeans") -> Palette:
    """Distinct colours, dark to light. Unknown methods count as kmeans."""
    if not len(samples):
        return []
    return sorted(dict.fromkeys(QUANTISERS.get(method, kmeans)(samples, count)), key=luma709)


def _mix(a: tuple, b: tuple, t: float) -> tuple[int, int, int]:
    p, q = np.array(lab(a)), np.array(lab(b))
    return tuple(map(int, _rgb_array((p + (q - p) * t)[None])[0]))


def pad(palette: Palette, count: int) -> Palette:
    """Fills up to count entries by splitting the widest gap in luma."""
    out = list(palette) or [(0, 0, 0)]
    for _ in range(64):
        if len(out) >= count:
            break
        if len(out) == 1:
            out.append(_mix(out[0], (0, 0, 0) if luma709(out[0]) > 0.5 else (255, 255, 255), 0.5))
        else:
            gaps = [luma709(b) - luma709(a) for a, b in zip(out, out[1:], strict=False)]
            i = gaps.index(max(gaps))
            out.append(_mix(out[i], out[i + 1], 0.5))
        out.sort(key=luma709)
    return out[: max(1, count)]


def extract(px: DataFrame, w: int, h: int, count: int, method: str = "kmeans") -> DataFrame:
    """A palette for each image: image_id, idx, r, g, b. The stride keeps a picture's sample near 24,000 pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        samples = pdf.sort_values(["y", "x"])[["r", "g", "b"]].to_numpy(int)
        colours = pad(quantise(samples, count, method), count)
        return pd.DataFrame([(pdf["image_id"].iloc[0], i, *c) for i, c in enumerate(colours)], columns=["image_id", "idx", "r", "g", "b"])

    return stride_sample(px, w, h).groupBy("image_id").applyInPandas(run, "image_id string, idx int, r int, g int, b int")


def spread(palette: DataFrame, amount: float) -> DataFrame:
    """Entries (image_id, idx, r, g, b) moved from their mean in OKLab, lightness more than chroma."""
    s = min(1.0, max(0.0, amount))
    if not s:
        return palette
    labs = color.rgb_to_oklab((F.col("r"), F.col("g"), F.col("b")))
    p = palette.withColumns(dict(zip(("__l", "__a", "__b"), labs, strict=True)))
    every = Window.partitionBy("image_id")
    moved = [F.avg(c).over(every) + (F.col(c) - F.avg(c).over(every)) * k for c, k in (("__l", 1 + s), ("__a", 1 + 0.6 * s), ("__b", 1 + 0.6 * s))]
    moved[0] = color.clamp(moved[0], 0, 1)
    p = p.withColumns({"__x": moved[0], "__y": moved[1], "__z": moved[2]})
    rgb = color.oklab_to_rgb((F.col("__x"), F.col("__y"), F.col("__z")))
    return p.withColumns(dict(zip("rgb", rgb, strict=True))).drop("__l", "__a", "__b", "__x", "__y", "__z")


def paper(palette: DataFrame, invert: bool = False) -> DataFrame:
    """Each image's lightest entry (inverted: darkest); of equals the first."""
    light = color.luma((F.col("r"), F.col("g"), F.col("b")))
    key = F.struct((light if invert else -light).alias("l"), F.col("idx").alias("i"))
    return palette.groupBy("image_id").agg(F.min(key)["i"].alias("paper"))


def ink_palette(palette: Palette, background: tuple[int, int, int], limit: float = 0.06) -> Palette:
    """Without the entry that is the paper, if one is near enough and others are left."""
    far = [math.dist(lab(c), lab(background)) for c in palette]
    if len(palette) < 2 or min(far) > limit:
        return list(palette)
    return [c for i, c in enumerate(palette) if i != far.index(min(far))]
