"""A whole rendering from parameters: analysis, palette, dots or dither, composite. Every step is a plan; only sizes
and palettes (a few rows) come to the driver."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, geometry, tone
from ..functions.params import resolution, sanitized
from ..operators import blur, cells, dither, palette, raster, records, separation, svg
from ..operators.palette import Palette
from ..sources import codecs, images


@dataclass(frozen=True)
class Colours:
    """The palette that pixels are matched with, the one that is painted, and which entry is the paper."""

    match: Palette
    painted: Palette
    paper: int

    @property
    def inks(self) -> list[int]:
        return [i for i in range(len(self.match)) if i != self.paper] or [self.paper]


def _hex(text: str) -> tuple[int, int, int]:
    return tuple(int(text[k : k + 2], 16) for k in (1, 3, 5))


def lut(p: dict[str, Any]) -> list[float]:
    return tone.tone_lut(p["blackPoint"], p["whitePoint"], p["gamma"], p["contrast"], p["exposure"], list(p["toneCurve"]))


def _frame(px: DataFrame, entries: Palette) -> DataFrame:
    return px.sparkSession.createDataFrame([("p", i, *c) for i, c in enumerate(entries)], "image_id string, idx int, r int, g int, b int")


def _rows(df: DataFrame) -> Palette:
    return [(r["r"], r["g"], r["b"]) for r in df.orderBy("idx").collect()]


def colours(px: DataFrame, w: int, h: int, p: dict[str, Any]) -> Colours:
    """Locked colours, or extracted ones; spread; hue, saturation and brightness on what is painted; the paper."""
    if p["paletteLocked"]:
        base = palette.pad(sorted(map(_hex, p["palette"]), key=palette.luma709), len(p["palette"]))
    else:
        base = _rows(palette.extract(px.withColumn("image_id", F.lit("p")), w, h, p["colorCount"], p["quantMethod"]))
    match = _rows(palette.spread(_frame(px, base), p["spread"]))
    painted = _rows(color.adjust(_frame(px, match), p["hue"], p["saturation"], p["brightness"]))
    if p["background"] != "auto":
        given = _hex(p["background"])
        near = palette.ink_palette(match, given)
        if len(near) < len(match):
            paper = next(i for i, c in enumerate(match) if c not in near)
            painted[paper] = given
        else:
            match, painted, paper = [*match, given], [*painted, given], len(match)
    else:
        pick = min if p["invert"] else max
        paper = pick(range(len(match)), key=lambda i: palette.luma709(match[i]))
    return Colours(match, painted, paper)


def analyse(px: DataFrame, w: int, h: int, p: dict[str, Any], ppi: float = 72) -> tuple[DataFrame, int, int]:
    """The picture at the size that it is worked on, cleaned; for dithering also graded."""
    most = dither.analysis_size(max(w, h), p["mode"], resolution(p, max(w, h), ppi))
    k = min(1.0, most / max(w, h))
    aw, ah = (max(1, int(v * k + 0.5)) for v in (w, h))
    px = blur.preprocess(cells.downscale(px, w, h, aw, ah), aw, ah, p["noiseReduction"], p["blur"], p["sharpen"], p["sharpenRadius"])
    table = tone.tone_bytes(lut(p), p["invert"])
    if p["mode"] == "dither" and table != list(range(256)):
        graded = F.array(*map(F.lit, table))
        px = px.withColumns({c: F.element_at(graded, (F.col(c) + 1).cast("int")).cast("long") for c in "rgb"})
    return px, aw, ah


def _dithered(px: DataFrame, p: dict[str, Any], c: Colours) -> DataFrame:
    zones = dither.Zones.make(len(c.match), p["shadowSplit"], p["highlightSplit"]) if p["tonalMapping"] else None
    return dither.dither(px, c.match, p["ditherAlgorithm"], p["ditherStrength"], p["serpentine"], zones)


def _dots(px: DataFrame, w: int, h: int, p: dict[str, Any], c: Colours, ow: int, oh: int, ppi: float) -> tuple[DataFrame, cells.Grid]:
    grid = cells.Grid.make(w, h, resolution(p, max(w, h), ppi), p["angle"])
    found = cells.edge_aware(px, grid, 1, p["lumaMode"]) if p["edgeAware"] else cells.aggregate(px, grid, p["lumaMode"])
    found = found.withColumns({k: F.col(f"{k}_sum") / F.col("n") for k in "rgb"})
    found = color.adjust(found, p["hue"], p["saturation"], p["brightness"])
    inks = c.inks
    found = found.withColumn("__i", palette.nearest(tuple(map(F.col, "rgb")), [c.painted[i] for i in inks]))
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), F.col("__i") + 1)
    found = found.withColumns({"idx": pick(inks), **{k: pick([c.painted[i][n] for i in inks]) for n, k in enumerate("rgb")}})
    jitter = {"position": p["jitterPosition"], "size": p["jitterSize"], "angle": p["jitterAngle"], "seed": int(p["seed"])}
    out = grid.scaled(ow, oh)
    made = raster.dots(found, out, lut(p), radius=p["radius"], curve=p["radiusCurve"], gain=p["dotGain"], bias=p["gradeBias"], invert=p["invert"], fm=p["screenType"] == "fm", jitter=jitter)
    return made, out


def screen_dots(px: DataFrame, w: int, h: int, p: dict[str, Any], c: Colours, ow: int, oh: int, ppi: float, press: bool = True) -> tuple[DataFrame, float]:
    """Dots of all inks, darkest first, each screen at its own angle, and the cells' size. press: with slipped plates,
    jitter and FM screens, which masks don't have."""
    order = sorted(c.inks, key=lambda i: palette.luma709(c.match[i]))
    paper = c.match[c.paper] if p["background"] == "auto" else c.painted[c.paper]
    d = resolution(p, max(w, h), ppi)
    covs = separation.each_screen(px, w, h, [c.match[i] for i in order], paper, d, p["angle"], p["screenSpread"], p["gradeBias"], lut=lut(p), invert=p["invert"], edge=p["edgeAware"], mode=p["lumaMode"])
    jitter = {"position": p["jitterPosition"], "size": p["jitterSize"], "angle": p["jitterAngle"], "seed": int(p["seed"])}
    out, cell = None, 0.0
    for rank, (i, angle) in enumerate(zip(order, geometry.screen_angles(len(order), p["angle"], p["screenSpread"]), strict=True)):
        grid = cells.Grid.make(w, h, d, angle).scaled(ow, oh)
        slip = geometry.ink_offset(rank, p["misregistration"] if press else 0, grid.cell, int(p["seed"]))
        own = raster.ink_dots(covs[rank], grid, rank, radius=p["radius"], curve=p["radiusCurve"], gain=p["dotGain"], fm=press and p["screenType"] == "fm", jitter=jitter if press else None, slip=slip)
        own = own.withColumns({"idx": F.lit(i), "angle": F.lit(float(angle)), **{k: F.lit(v) for k, v in zip("rgb", c.painted[i], strict=True)}})
        out, cell = own if out is None else out.unionByName(own), grid.cell
    return out, cell


def _screens(px: DataFrame, w: int, h: int, p: dict[str, Any], c: Colours, ow: int, oh: int, ppi: float, press: bool = True) -> DataFrame:
    made, cell = screen_dots(px, w, h, p, c, ow, oh, ppi, press)
    return raster.stamp(made, p["shape"], cell, ow, oh, ("image_id", "ord", "screen", "idx", "r", "g", "b"))


def screen_plates(px: DataFrame, w: int, h: int, p: dict[str, Any], c: Colours, ow: int, oh: int, ppi: float, image: str) -> DataFrame:
    """image_id, plate, x, y, v: the paper, covered everywhere, and each ink's coverage; plates carry palette indices."""
    inks = raster.ink_masks(_screens(px, w, h, p, c, ow, oh, ppi, press=False), ("image_id", "idx", "x", "y")).withColumnRenamed("idx", "plate")
    sheet = images.blank(px.sparkSession, ow, oh).select(F.lit(image).alias("image_id"), F.lit(c.paper).alias("plate"), "x", "y", F.lit(255).cast("long").alias("v"))
    return sheet.unionByName(inks)


def render(px: DataFrame, settings: dict[str, Any], out: tuple[int, int] | None = None, ppi: float = 72) -> DataFrame:
    """Pixels of one picture (image_id, x, y, r, g, b, a) rendered by settings at a size (its own by default)."""
    p = sanitized(settings)
    w, h = images.size(px)
    ow, oh = out or (w, h)
    image = px.first()["image_id"]
    work, aw, ah = analyse(px, w, h, p, ppi)
    c = colours(work, aw, ah, p)
    if p["mode"] == "dither":
        index = _dithered(work, p, c)
        return dither.colours(dither.expand(index, aw, ah, ow, oh), c.painted)
    paper = c.painted[c.paper]
    blank = images.blank(px.sparkSession, ow, oh)
    if p["screenMode"] == "perInk":
        return raster.filled(raster.multiply(_screens(work, aw, ah, p, c, ow, oh, ppi), paper), blank, image, paper)
    made, grid = _dots(work, aw, ah, p, c, ow, oh, ppi)
    stamps = raster.stamp(made, p["shape"], grid.cell, ow, oh, ("image_id", "ord", "r", "g", "b"))
    return raster.filled(raster.over(stamps, paper), blank, image, paper)


def plates(px: DataFrame, settings: dict[str, Any], ppi: float = 72) -> DataFrame:
    """image_id, plate, x, y, v, hex, blend: the rendering taken apart, one mask a palette entry."""
    p = sanitized(settings)
    w, h = images.size(px)
    work, aw, ah = analyse(px, w, h, p, ppi)
    c = colours(work, aw, ah, p)
    if p["mode"] == "dither":
        found = dither.masks(dither.expand(_dithered(work, p, c), aw, ah, w, h), len(c.match))
        blend = "normal"
    elif p["screenMode"] == "perInk":
        found = screen_plates(work, aw, ah, p, c, w, h, ppi, px.first()["image_id"])
        blend = "multiply"
    else:
        made, grid = _dots(work, aw, ah, p, c, w, h, ppi)
        stamps = raster.stamp(made, p["shape"], grid.cell, w, h, ("image_id", "ord", "idx"))
        found, blend = raster.exclusive_masks(stamps, len(c.match), c.paper), "normal"
    names = F.array(*(F.lit("#%02X%02X%02X" % e) for e in c.painted))
    return found.select("image_id", "plate", "x", "y", "v", F.element_at(names, (F.col("plate") + 1).cast("int")).alias("hex"), F.lit(blend).alias("blend"))


def export_plates(px: DataFrame, settings: dict[str, Any], base: str = "halftone", ppi: float = 72) -> DataFrame:
    """file, hex, png: a grey picture for each ink, black where it prints, in the order in which inks come."""
    p = sanitized(settings)
    if p["mode"] == "dither":
        raise ValueError("a dithered picture has no printable plates")
    found = plates(px, p, ppi)
    entries = found.select("plate", "hex").distinct().orderBy("plate").collect()  # a palette
    w, h = images.size(px)
    work, aw, ah = analyse(px, w, h, p, ppi)
    c = colours(work, aw, ah, p)
    pictures = raster.plate_pictures(found.select("image_id", "plate", "x", "y", "v"), images.blank(px.sparkSession, w, h), len(c.match), c.paper)
    inks = {e["plate"]: e["hex"] for e in entries if e["plate"] != c.paper}
    named = pictures.where(F.col("plate").isin(*inks)).withColumn("image_id", F.col("plate").cast("string"))
    rows = [(str(i), f"{base} plate {n} {v[1:]}", v) for n, (i, v) in enumerate(inks.items(), 1)]
    files = px.sparkSession.createDataFrame(rows, "image_id string, file string, hex string")
    pngs = codecs.images_to_png(named)
    return pngs.join(F.broadcast(files), "image_id").select(F.concat(records.safe_name(F.col("file")), F.lit(".png")).alias("file"), "hex", "png")


def render_svg(px: DataFrame, settings: dict[str, Any], ppi: float = 72) -> DataFrame:
    """One document an image; dithering has no vector form."""
    p = sanitized(settings)
    if p["mode"] == "dither":
        raise ValueError("a dithered picture has no vector form")
    w, h = images.size(px)
    work, aw, ah = analyse(px, w, h, p, ppi)
    c = colours(work, aw, ah, p)
    paper, inked = "#%02X%02X%02X" % c.painted[c.paper], color.to_hex(tuple(map(F.col, "rgb")))
    if p["screenMode"] == "perInk":
        made, cell = screen_dots(work, aw, ah, p, c, w, h, ppi)
        return svg.document(made.withColumn("hex", inked), p["shape"], cell, w, h, screens=True, paper=paper)
    made, grid = _dots(work, aw, ah, p, c, w, h, ppi)
    return svg.document(made.withColumn("hex", inked), p["shape"], grid.cell, w, h, paper=paper)


def batch(pictures: dict[str, DataFrame], settings: dict[str, Any]) -> list[tuple[str, DataFrame | None, str | None]]:
    """A plan for each picture, or why there is none; unless the palette is locked, all take the first one's."""
    p, out = sanitized(settings), []
    for name, px in pictures.items():
        try:
            if p["batchSharedPalette"] and not p["paletteLocked"]:
                w, h = images.size(px)
                first = palette.extract(px, w, h, p["colorCount"], p["quantMethod"])
                p = {**p, "paletteLocked": True, "palette": ["#%02X%02X%02X" % c for c in _rows(first)]}
            out.append((name, render(px, p), None))
        except Exception as e:  # one picture's failure is reported, and the others go on
            out.append((name, None, str(e)))
    return out
