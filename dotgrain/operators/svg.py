"""Vector output: a dot's markup, groups by ink in order of first use, the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

BUSY = 200_000


def number(v: Column) -> Column:
    """At most two decimals, none that are zeros; next to nothing is 0."""
    text = F.regexp_replace(F.format_string("%.2f", v), r"\.?0+$", "")
    return F.when(F.abs(v) < 0.005, "0").otherwise(text)


def markup(shape: str, cell: float) -> Column:
    """Of columns cx, cy, radius, rot and hex."""
    r, cx, cy = F.col("radius"), F.col("cx"), F.col("cy")
    turned = F.when(F.abs(F.col("rot")) < 1e-9, F.lit("")).otherwise(F.concat(F.lit(' transform="rotate('), number(F.degrees("rot")), F.lit(" "), number(cx), F.lit(" "), number(cy), F.lit(')"')))

    def rect(w: Column, h: Column) -> Column:
        return F.concat(F.lit('<rect x="'), number(cx - w / 2), F.lit('" y="'), number(cy - h / 2), F.lit('" width="'), number(w), F.lit('" height="'), number(h), F.lit('"'), turned, F.lit("/>"))

    if shape == "square":
        return rect(r * 2 * geometry.SQUARE, r * 2 * geometry.SQUARE)
    if shape == "line":
        return rect(F.lit(float(cell)), r * r * 3.141592653589793 / cell)
    if shape == "cross":
        return F.concat(rect(r * 2 * geometry.ARM, r * 2 * geometry.THICK), rect(r * 2 * geometry.THICK, r * 2 * geometry.ARM))
    if shape == "diamond":
        d = r * geometry.DIAMOND
        at = lambda x, y: F.concat(number(x), F.lit(","), number(y))
        return F.concat(F.lit('<polygon points="'), F.concat_ws(" ", at(cx, cy - d), at(cx + d, cy), at(cx, cy + d), at(cx - d, cy)), F.lit('"'), turned, F.lit("/>"))
    if shape == "ellipse":
        a, b = r * 1.3**0.5, r / 1.3**0.5
        spin = F.concat(F.lit(' transform="rotate('), number(F.degrees("rot") + 45), F.lit(" "), number(cx), F.lit(" "), number(cy), F.lit(')"'))
        return F.concat(F.lit('<ellipse cx="'), number(cx), F.lit('" cy="'), number(cy), F.lit('" rx="'), number(a), F.lit('" ry="'), number(b), F.lit('"'), spin, F.lit("/>"))
    return F.concat(F.lit('<circle cx="'), number(cx), F.lit('" cy="'), number(cy), F.lit('" r="'), number(r), F.lit('"/>'))


def _joined(text: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "\n")


def document(dots: DataFrame, shape: str, cell: float, w: int, h: int, screens: bool = False, paper: str | None = None) -> DataFrame:
    """image_id, svg, shapes, busy: one group an ink (hex), in order of first use; with screens, one a screen (with its
    angle), multiplied. paper: the colour of a sheet below them, in a document that stands alone."""
    by = "screen" if screens else "hex"
    marked = dots.withColumn("m", markup(shape, cell))
    angle = F.first("angle") if screens else F.lit(0.0)
    groups = marked.groupBy("image_id", by).agg(F.min("ord").alias("first"), _joined("m", "ord").alias("body"), F.count(F.lit(1)).alias("n"), F.first("hex").alias("fill"), angle.alias("angle"))
    bare = F.substring("fill", 2, 6)
    if screens:
        name = F.concat(F.lit("screen-"), F.col("screen").cast("string"), F.lit("-"), bare, F.lit('" data-angle="'), number(F.col("angle")))
    else:
        name = F.concat(F.lit("ink-"), bare)
    style = F.lit(' style="mix-blend-mode: multiply"' if screens else "")
    group = F.concat(F.lit('<g id="'), name, F.lit('" fill="'), F.col("fill"), F.lit('"'), style, F.lit(">\n"), F.col("body"), F.lit("\n</g>"))
    place = F.col("screen").cast("long") if screens else F.col("first")
    groups = groups.withColumns({"g": group, "place": place})
    out = groups.groupBy("image_id").agg(_joined("g", "place").alias("body"), F.sum("n").alias("shapes"))
    alone = ' style="isolation: isolate"' if screens else ""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}"{alone}>\n'
    if paper:
        head = f'<?xml version="1.0" encoding="UTF-8"?>\n{head}<rect width="{w}" height="{h}" fill="{paper}"/>\n'
    tail = "\n</svg>\n" if paper else "\n</svg>"
    return out.select("image_id", F.concat(F.lit(head), F.col("body"), F.lit(tail)).alias("svg"), "shapes", (F.col("shapes") > BUSY).alias("busy"))
