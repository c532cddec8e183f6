"""Dots: geometry, coverage of pixels, and how they are laid over each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, tone
from ..functions.matrices import blue_noise
from .cells import Grid

SMALLEST = 0.008
#: How many rows apart screens read the noise and the jitter (fixed values).
FM_STEP, JITTER_STEP = 97, 31


def fm_threshold(col: Column, row: Column) -> Column:
    """The blue noise that ink has to pass in a cell."""
    m = blue_noise()
    n = m.shape[0]
    return F.element_at(F.array(*(F.lit(float(v)) for v in m.ravel())), (row % n * n + col % n + 1).cast("int"))


def ink_dots(cov: DataFrame, grid: Grid, rank: int, *, radius: float = 100, curve: float = 0, gain: float = 0, fm: bool = False, jitter: dict | None = None, slip: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """A screen (row, col, cov) with ord, cx, cy, radius, rot. Each screen has its own part of the noise and of
    the jitter; slip is how far its plate lies off."""
    most = grid.cell * 0.5 * radius / 100
    if fm:
        own = cov.where(F.col("cov") > fm_threshold(F.col("col"), F.col("row") + rank * FM_STEP)).withColumn("radius", F.lit(float(most)))
    else:
        own = cov.withColumn("radius", tone.ink_to_radius(F.col("cov"), most, curve)).where(F.col("radius") > SMALLEST)
    cx, cy = grid.centre(F.col("col"), F.col("row"))
    dx, dy, factor, rot = geometry.dot_jitter(F.col("col"), F.col("row") + rank * JITTER_STEP, grid.cell, **(jitter or {}))
    own = own.withColumns({"cx": cx + slip[0] + dx, "cy": cy + slip[1] + dy, "radius": (F.col("radius") + grid.cell * gain / 100) * factor, "rot": rot})
    return own.where(F.col("radius") > SMALLEST).withColumn("ord", F.lit(rank * 10**10).cast("long") + F.col("row") * grid.cols + F.col("col"))


def dots(cells: DataFrame, grid: Grid, lut: list[float], *, radius: float = 100, curve: float = 0, gain: float = 0, bias: float = 0, invert: bool = False, fm: bool = False, jitter: dict | None = None, view: tuple[int, int, int, int] | None = None) -> DataFrame:
    """image_id, row, col, ord, cx, cy, radius, rot of the dots to draw, from cells with lum_sum and n.

    AM dots grow with the ink; FM dots are alike and stand where the ink passes blue noise. Dots outside the view
    (left, top, width, height) go before any pixel is made.
    """
    most = grid.cell * 0.5 * radius / 100
    graded = tone.sample_lut(lut, F.col("lum_sum") / F.col("n"))
    out = cells.withColumn("ink", tone.bias(graded if invert else 1 - graded, bias))
    if fm:
        out = out.where(F.col("ink") > fm_threshold(F.col("col"), F.col("row"))).withColumn("radius", F.lit(most))
    else:
        out = out.withColumn("radius", tone.ink_to_radius(F.col("ink"), most, curve)).where(F.col("radius") > SMALLEST)
    out = out.withColumn("radius", F.col("radius") + grid.cell * gain / 100)
    cx, cy = grid.centre(F.col("col"), F.col("row"))
    left, top, w, h = view or (0, 0, grid.w, grid.h)
    out = out.withColumns({"cx": cx - left, "cy": cy - top, "rot": F.lit(0.0), "ord": F.col("row") * grid.cols + F.col("col")})
    far = grid.cell * max(1.0, radius / 100) + 2
    out = out.where((F.col("cx") >= -far) & (F.col("cy") >= -far) & (F.col("cx") <= w + far) & (F.col("cy") <= h + far))
    if jitter and any(jitter.get(k, 0) > 0 for k in ("position", "size", "angle")):
        dx, dy, factor, rot = geometry.dot_jitter(F.col("col"), F.col("row"), grid.cell, **jitter)
        out = out.withColumns({"cx": F.col("cx") + dx, "cy": F.col("cy") + dy, "radius": F.col("radius") * factor, "rot": rot}).where(F.col("radius") > SMALLEST)
    return out


def stamp(dotted: DataFrame, shape: str, cell: float, w: int, h: int, keep: tuple[str, ...] = ("image_id", "ord")) -> DataFrame:
    """keep, x, y, a: the share of each pixel that each dot covers. Pixels are made from the dots' own bounds, so no
    join is needed; dots below half a pixel are spread over four pixels by their area."""
    r, cx, cy = F.col("radius"), F.col("cx"), F.col("cy")
    small = r < 0.5
    ext = geometry.extent(shape, r, cell) + 1
    low = lambda c: F.greatest(F.lit(0), F.floor(c - ext)).cast("long")
    high = lambda c, n: (F.least(F.lit(n), F.ceil(c + ext)) - 1).cast("long")
    big = dotted.where(~small).withColumns({"__x0": low(cx), "__x1": high(cx, w), "__y0": low(cy), "__y1": high(cy, h)}).where("__x1 >= __x0 and __y1 >= __y0")
    big = big.withColumn("y", F.explode(F.sequence("__y0", "__y1"))).withColumn("x", F.explode(F.sequence("__x0", "__x1")))
    dx, dy = F.col("x") + 0.5 - cx, F.col("y") + 0.5 - cy
    c, s = F.cos(F.col("rot")), F.sin(F.col("rot"))
    big = big.withColumns({"__dx": dx * c + dy * s, "__dy": dy * c - dx * s})
    a = geometry.coverage(geometry.shape(shape)(F.col("__dx"), F.col("__dy"), r, cell))
    big = big.withColumn("a", a).where("a > 0").select(*keep, "x", "y", "a")
    area = F.least(F.lit(1.0), geometry.area(shape, r))
    fx, fy = F.floor(cx - 0.5), F.floor(cy - 0.5)
    tx, ty = cx - 0.5 - fx, cy - 0.5 - fy
    corner = lambda i, j: F.struct((fx + i).alias("x"), (fy + j).alias("y"), (area * (tx if i else 1 - tx) * (ty if j else 1 - ty)).alias("a"))
    tiny = dotted.where(small).where(area > 0.0005).withColumn("__p", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))))
    tiny = tiny.select(*keep, F.col("__p.x").alias("x"), F.col("__p.y").alias("y"), F.col("__p.a").alias("a")).where((F.col("a") > 0) & F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    return big.unionByName(tiny)


def _folded(stamps: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], start: Column, step) -> DataFrame:
    layers = F.array_sort(F.collect_list(F.struct("ord", "a", *values)))
    return stamps.groupBy(*keys).agg(layers.alias("__l")).withColumn("__v", F.aggregate("__l", start, step)).drop("__l")


def over(stamps: DataFrame, paper: tuple[int, int, int]) -> DataFrame:
    """image_id, x, y, r, g, b: dots (with r, g, b) laid over the paper in their order, rounded to bytes each time.
    A pixel's list is as long as dots overlap there, which the radius bounds."""
    start = F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("rgb", paper, strict=True)))

    def step(o: Column, d: Column) -> Column:
        mixed = lambda c: F.when(d["a"] >= 0.999, d[c].cast("double")).otherwise(F.rint(d[c] * d["a"] + o[c] * (1 - d["a"])))
        return F.struct(*(mixed(c).alias(c) for c in "rgb"))

    return _folded(stamps, ("image_id", "x", "y"), ("r", "g", "b"), start, step).select("image_id", "x", "y", *(F.col(f"__v.{c}").cast("long").alias(c) for c in "rgb"))


def multiply(stamps: DataFrame, paper: tuple[int, int, int]) -> DataFrame:
    """As over, with inks that multiply."""
    start = F.struct(*(F.lit(float(v)).alias(c) for c, v in zip("rgb", paper, strict=True)))

    def step(o: Column, d: Column) -> Column:
        return F.struct(*(F.rint(o[c] * (1 - d["a"] + d["a"] * d[c] / 255.0)).alias(c) for c in "rgb"))

    return _folded(stamps, ("image_id", "x", "y"), ("r", "g", "b"), start, step).select("image_id", "x", "y", *(F.col(f"__v.{c}").cast("long").alias(c) for c in "rgb"))


def ink_masks(stamps: DataFrame, keys: tuple[str, ...] = ("image_id", "screen", "x", "y")) -> DataFrame:
    """keys, v: coverage of each screen, growing with every dot, 0..255, rounded each time."""
    step = lambda o, d: F.rint((o / 255.0 + d["a"] * (1 - o / 255.0)) * 255.0)
    return _folded(stamps, keys, (), F.lit(0.0), step).select(*keys, F.col("__v").cast("long").alias("v"))


def exclusive_masks(stamps: DataFrame, count: int, paper: int) -> DataFrame:
    """image_id, plate, x, y, v: what a pixel shows of each entry when dots (with idx) cover each other; sums to 255."""
    start = F.array(*(F.lit(255.0 if i == paper else 0.0) for i in range(count)))

    def step(o: Column, d: Column) -> Column:
        return F.transform(o, lambda v, i: F.rint(v * (1 - d["a"]) + F.when(i == d["idx"], 255.0 * d["a"]).otherwise(0.0)))

    folded = _folded(stamps, ("image_id", "x", "y"), ("idx",), start, step)
    return folded.select("image_id", "x", "y", F.posexplode("__v").alias("plate", "v")).withColumn("v", F.col("v").cast("long"))


def filled(painted: DataFrame, blank: DataFrame, image_id: str, paper: tuple[int, int, int]) -> DataFrame:
    """Painted pixels on a whole sheet of paper."""
    out = blank.join(painted.drop("image_id"), ["x", "y"], "left")
    return out.select(F.lit(image_id).alias("image_id"), "x", "y", *(F.coalesce(c, F.lit(v)).cast("long").alias(c) for c, v in zip("rgb", paper, strict=True)), F.lit(255).cast("long").alias("a"))


def plate_order(plate: Column, paper: int) -> Column:
    """In which order plates are written: the paper, then the inks by their index."""
    return F.when(plate == paper, 0).otherwise(plate + 1)


def plate_pictures(masks: DataFrame, blank: DataFrame, count: int, paper: int) -> DataFrame:
    """masks (image_id, plate, x, y, v) of all inks as whole grey pictures, black where there is ink: image_id, plate, x, y,
    r, g, b, a. Pixels that a mask doesn't have are white."""
    plates = masks.select("image_id").distinct().withColumn("plate", F.explode(F.array(*(F.lit(i) for i in range(count) if i != paper))))
    sheet = blank.withColumn("__p", F.explode(F.array(*(F.lit(i) for i in range(count) if i != paper)))).withColumnRenamed("__p", "plate")
    every = sheet.join(F.broadcast(plates), "plate")  # a picture's plates: at most 9 rows
    out = every.join(masks, ["image_id", "plate", "x", "y"], "left")
    grey = (255 - F.coalesce("v", F.lit(0))).cast("long")
    return out.select("image_id", "plate", "x", "y", *(grey.alias(c) for c in "rgb"), F.lit(255).cast("long").alias("a"))


def survivors(px: DataFrame) -> DataFrame:
    """image_id, share: how much of a rendering a selection has left; an error where that is nothing."""
    share = F.avg((F.col("a") > 0).cast("double"))
    none = F.raise_error(F.lit("the selection has no pixel of the picture")).cast("double")
    return px.groupBy("image_id").agg(F.when(share > 0, share).otherwise(none).alias("share"))
