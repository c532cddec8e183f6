"""Grids over a picture and aggregates of its cells."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color

OPAQUE = 8
CELL = ("image_id", "row", "col")


@dataclass(frozen=True)
class Grid:
    cell: float
    cols: int
    rows: int
    cos: float
    sin: float
    left: float
    top: float
    w: int
    h: int

    @classmethod
    def make(cls, w: int, h: int, density: float, angle: float = 0) -> Grid:
        """Square cells, turned by angle, laid evenly over the turned picture's bounds."""
        cell = max(1.2, max(w, h) / max(1.0, density))
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        wide, high = w * abs(c) + h * abs(s), w * abs(s) + h * abs(c)
        cols, rows = max(1, math.ceil(wide / cell - 1e-9)), max(1, math.ceil(high / cell - 1e-9))
        return cls(cell, cols, rows, c, s, -cols * cell / 2, -rows * cell / 2, w, h)

    def scaled(self, w: int, h: int) -> Grid:
        """For another output size: the same cells."""
        k = max(w, h) / max(self.w, self.h)
        return replace(self, cell=self.cell * k, left=self.left * k, top=self.top * k, w=w, h=h)

    def of_pixel(self) -> tuple[Column, Column]:
        """Row and column of the cell that holds a pixel's centre."""
        dx, dy = F.col("x") + 0.5 - self.w / 2, F.col("y") + 0.5 - self.h / 2
        u, v = dx * self.cos + dy * self.sin, dy * self.cos - dx * self.sin
        at = lambda p, low, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), ((p - low) / self.cell).cast("long")))
        return at(v, self.top, self.rows), at(u, self.left, self.cols)

    def centre(self, col: Column, row: Column) -> tuple[Column, Column]:
        u, v = (col + 0.5) * self.cell + self.left, (row + 0.5) * self.cell + self.top
        return u * self.cos - v * self.sin + self.w / 2, u * self.sin + v * self.cos + self.h / 2


def opaque(px: DataFrame) -> DataFrame:
    return px.where(F.col("a") >= OPAQUE)


def aggregate(px: DataFrame, grid: Grid, mode: str = "luma709") -> DataFrame:
    """Sums and counts of each cell's opaque pixels; cells without any have no row."""
    row, col = grid.of_pixel()
    cells = opaque(px).withColumns({"row": row, "col": col}).groupBy(*CELL)
    light = color.luma((F.col("r"), F.col("g"), F.col("b")), mode)
    return cells.agg(F.count(F.lit(1)).alias("n"), F.sum(light).alias("lum_sum"), *(F.sum(c).alias(f"{c}_sum") for c in "rgb"))


def edge_aware(px: DataFrame, grid: Grid, strength: float = 1, mode: str = "luma709") -> DataFrame:
    """The cells' sums with pixels weighed by how near they are to their cell's mean, in count times mean form."""
    row, col = grid.of_pixel()
    s = min(1.0, max(0.0, strength))
    cells = aggregate(px, grid, mode)
    joined = opaque(px).withColumns({"row": row, "col": col}).join(cells, list(CELL))
    far = sum(((F.col(c) - F.col(f"{c}_sum") / F.col("n")) ** 2 for c in "rgb"), F.lit(0.0))
    joined = joined.withColumn("__w", F.exp(-far / (3 * 48 * 48)))
    light = color.luma((F.col("r"), F.col("g"), F.col("b")), mode)
    first = {c: F.first(c).alias(c) for c in ("n", "lum_sum", "r_sum", "g_sum", "b_sum")}
    out = joined.groupBy(*CELL).agg(*first.values(), F.sum("__w").alias("w"), F.sum(light * F.col("__w")).alias("lum_w"), *(F.sum(F.col(c) * F.col("__w")).alias(f"{c}_w") for c in "rgb"))
    blend = lambda c: F.when(F.col("w") < 1e-6, F.col(f"{c}_sum")).otherwise(F.col(f"{c}_sum") * (1 - s) + F.col(f"{c}_w") * F.col("n") / F.col("w") * s).alias(f"{c}_sum")
    return out.select(*CELL, "n", *(blend(c) for c in ("lum", "r", "g", "b")))


def histogram(px: DataFrame, bins: int = 64, mode: str = "luma709") -> DataFrame:
    """Counts of opaque pixels by luma; empty bins have 0."""
    v = color.luma((F.col("r"), F.col("g"), F.col("b")), mode)
    counted = opaque(px).groupBy(F.least(F.lit(bins - 1), (v * bins).cast("long")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = px.sparkSession.range(bins).withColumnRenamed("id", "bucket")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def downscale(px: DataFrame, w: int, h: int, tw: int, th: int) -> DataFrame:
    """Box average, colour weighed by alpha; a copy if the picture wouldn't shrink in either direction."""
    if tw >= w and th >= h:
        return px

    def span(v: str, n: int, t: int) -> Column:
        # the target whose rounded span holds v: floor((v + .5) * t / n), put right by at most one
        k = F.floor((F.col(v) + 0.5) * t / n)
        start = lambda q: F.floor(q * n / t + 0.5)
        k = F.when(start(k) > F.col(v), k - 1).when(start(k + 1) <= F.col(v), k + 1).otherwise(k)
        return F.greatest(F.lit(0), F.least(F.lit(t - 1), k)).cast("long")

    weight = F.col("a") / 255.0
    total = F.sum(weight)
    groups = px.groupBy("image_id", span("x", w, tw).alias("tx"), span("y", h, th).alias("ty"))
    out = groups.agg(*(F.when(total > 1e-6, color.byte(F.sum(F.col(c) * weight) / total)).otherwise(0).cast("long").alias(c) for c in "rgb"), color.byte(F.avg("a")).cast("long").alias("a"))
    return out.withColumnsRenamed({"tx": "x", "ty": "y"})


def fit_within(px: DataFrame, w: int, h: int, most: int) -> DataFrame:
    k = min(1.0, most / max(w, h))
    return downscale(px, w, h, max(1, math.floor(w * k + 0.5)), max(1, math.floor(h * k + 0.5)))
