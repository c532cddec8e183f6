"""Pixel relations: (image_id, x, y, r, g, b, a), with channels from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
PIXEL = ("image_id", "x", "y", "r", "g", "b", "a")


def events_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as one picture of 100 columns; events of type error are transparent."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.lit("events").alias("image_id"), (F.col("event_id") % WIDTH).alias("x"), F.floor(F.col("event_id") / WIDTH).alias("y"),
        (F.floor(F.col("value") * 7) % 256).alias("r"), (F.col("user_id") * 37 % 256).alias("g"), (F.col("event_id") * 11 % 256).alias("b"),
        F.when(F.col("event_type") == "error", 0).otherwise(255).cast("long").alias("a"),
    )


def size(px: DataFrame) -> tuple[int, int]:
    """Width and height, by one aggregate; grids are laid out from it at plan time."""
    r = px.agg(F.max("x"), F.max("y")).first()
    return (r[0] + 1, r[1] + 1) if r[0] is not None else (0, 0)


def blank(spark: SparkSession, w: int, h: int) -> DataFrame:
    """x and y of every pixel."""
    n = spark.range(w * h)
    return n.select((F.col("id") % w).alias("x"), F.floor(F.col("id") / w).alias("y"))


def _image(name: str, at: DataFrame, r: Column, g: Column, b: Column, a: Column | None = None) -> DataFrame:
    a = F.lit(255) if a is None else a
    return at.select(F.lit(name).alias("image_id"), "x", "y", *(c.cast("long").alias(n) for n, c in zip("rgba", (r, g, b, a), strict=True)))


def solid(spark: SparkSession, w: int, h: int, rgba: tuple[int, int, int, int] = (0, 0, 0, 255), name: str = "solid") -> DataFrame:
    return _image(name, blank(spark, w, h), *map(F.lit, rgba))


def gradient(spark: SparkSession, w: int, h: int) -> DataFrame:
    v = F.floor(F.col("x") * 255 / (w - 1) + 0.5)
    return _image("gradient", blank(spark, w, h), v, v, v)


#: Bands of the flat-colour fixture (fixed values).
FLATS = ((230, 30, 40), (250, 200, 40), (30, 120, 220), (20, 20, 24), (245, 240, 225))


def flats(spark: SparkSession, w: int, h: int) -> DataFrame:
    band = F.least(F.lit(4), F.floor(F.col("x") * 5 / w)) + 1
    return _image("flats", blank(spark, w, h), *(F.element_at(F.array(*(F.lit(c[k]) for c in FLATS)), band.cast("int")) for k in range(3)))


def with_alpha(spark: SparkSession, w: int, h: int) -> DataFrame:
    return _image("alpha", blank(spark, w, h), F.lit(220), F.lit(40), F.lit(40), F.when(F.col("x") < w / 2, 255).otherwise(0))


def widen(px: DataFrame, components: Column) -> DataFrame:
    """Four components stay, three get an alpha of 255, one is grey; any other number is an error."""
    known = components.isin(1, 3, 4)
    grey = components == 1
    check = F.when(known, F.col("r")).otherwise(F.raise_error(F.lit("images have 1, 3 or 4 components")).cast("long"))
    return px.withColumns({"r": check, "g": F.when(grey, F.col("r")).otherwise(F.col("g")), "b": F.when(grey, F.col("r")).otherwise(F.col("b")), "a": F.when(components == 4, F.col("a")).otherwise(255)})


def mask_by_selection(px: DataFrame, selection: DataFrame, left: int, top: int) -> DataFrame:
    """Alpha from a selection (mx, my, a) whose corner lies at left, top; 0 beyond it."""
    s = selection.select((F.col("mx") + left).alias("x"), (F.col("my") + top).alias("y"), F.col("a").alias("__a"))
    return px.join(s, ["x", "y"], "left").withColumn("a", F.coalesce("__a", F.lit(0)).cast("long")).select(*PIXEL)


def crop(px: DataFrame, left: int, top: int, w: int, h: int) -> DataFrame:
    """The window's pixels, counted from its corner."""
    inside = F.col("x").between(left, left + w - 1) & F.col("y").between(top, top + h - 1)
    return px.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def black(spark: SparkSession, w: int, h: int) -> DataFrame:
    return solid(spark, w, h, (0, 0, 0, 255), "black")


def white(spark: SparkSession, w: int, h: int) -> DataFrame:
    return solid(spark, w, h, (255, 255, 255, 255), "white")
