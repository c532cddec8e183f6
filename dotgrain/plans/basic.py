"""Queries on colour, tone, cells, palettes and filters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, geometry, tone
from ..operators import blur, cells, palette
from ..operators.palette import INKS
from ..sources import images
from . import sql

DENSITY = 20
LUT = dict(black=10, white=240, gamma=1.2, contrast=1.1, exposure=4, curve=[[0, 0.05], [0.4, 0.35], [1, 0.95]])
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def RGB():  # noqa: N802
    return tuple(map(F.col, "rgb"))


def six(c):
    return F.round(c, 6)


def pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    px = images.events_image(spark, sf_dir)
    return px, *images.size(px)


@query(f"""WITH {sql.PX} SELECT x, y, round({sql.luma709()}, 6) AS l709, round((r * 0.299e0 + g * 0.587e0 + b * 0.114e0) / 255e0, 6) AS l601,
  round(CASE WHEN yy > 0.008856451679e0 THEN (116e0 * cbrt(yy) - 16e0) / 100e0 ELSE yy * 903.2962962e0 / 100e0 END, 6) AS lp
FROM (SELECT *, 0.2126e0 * {sql.lin("r")} + 0.7152e0 * {sql.lin("g")} + 0.0722e0 * {sql.lin("b")} AS yy FROM px)""")
def luma_modes(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    return px.select("x", "y", six(color.luma(RGB())).alias("l709"), six(color.luma(RGB(), "luma601")).alias("l601"), six(color.luma(RGB(), "perceptual")).alias("lp"))


@query(f"WITH {sql.PX} SELECT x, y, round(okl, 6) AS okl, round(oka, 6) AS oka, round(okb, 6) AS okb FROM {sql.with_lab('px')}")
def oklab(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    return px.select("x", "y", *(six(c).alias(n) for c, n in zip(color.rgb_to_oklab(RGB()), ("okl", "oka", "okb"), strict=True)))


@query(f"WITH {sql.PX} SELECT x, y, nr, ng, nb FROM {sql.from_lab(sql.with_lab('px'))}")
def oklab_round_trip(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    return px.select("x", "y", *(c.cast("long").alias(n) for c, n in zip(color.oklab_to_rgb(color.rgb_to_oklab(RGB())), ("nr", "ng", "nb"), strict=True)))


_HUE = "CASE WHEN t{k} < 1e0/6 THEN p + (q - p) * 6 * t{k} WHEN t{k} < 0.5e0 THEN q WHEN t{k} < 2e0/3 THEN p + (q - p) * (2e0/3 - t{k}) * 6 ELSE p END"
_HSL = f"""WITH {sql.PX}, v AS (SELECT x, y, r / 255e0 AS r, g / 255e0 AS g, b / 255e0 AS b FROM px),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM v),
k AS (SELECT *, (hi + lo) / 2 AS l0, CASE WHEN hi - lo <= 1e-9 THEN 0 WHEN (hi + lo) / 2 > 0.5e0 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s0,
  CASE WHEN hi - lo <= 1e-9 THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6e0 AS h0 FROM m),
j AS (SELECT *, h0 + 40 / 360e0 - floor(h0 + 40 / 360e0) AS h, greatest(0e0, least(1e0, s0 * 1.25e0)) AS s, greatest(0e0, least(1e0, l0 + (1 - l0) * 0.1e0)) AS l FROM k),
q AS (SELECT *, CASE WHEN l < 0.5e0 THEN l * (1 + s) ELSE l + s - l * s END AS q FROM j),
p AS (SELECT *, 2 * l - q AS p, CASE WHEN h + 1e0/3 > 1 THEN h + 1e0/3 - 1 ELSE h + 1e0/3 END AS t1, h AS t2, CASE WHEN h - 1e0/3 < 0 THEN h - 1e0/3 + 1 ELSE h - 1e0/3 END AS t3 FROM q)
SELECT x, y, {", ".join(f"floor((CASE WHEN s <= 1e-9 THEN l ELSE {_HUE.format(k=k)} END) * 255e0 + 0.5e0)::BIGINT AS {n}" for k, n in ((1, "nr"), (2, "ng"), (3, "nb")))} FROM p"""


@query(_HSL)
def hsl_adjust(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    new = color.adjust(px, hue=40, saturation=1.25, brightness=10)
    return new.select("x", "y", *(F.col(c).cast("long").alias(f"n{c}") for c in "rgb"))


@query(f"""WITH {sql.PX}, t AS (SELECT x, y, '#' || printf('%02X%02X%02X', r, g, b) AS hex, CASE WHEN x % 5 = 0 THEN printf('%x%x%x', r % 16, g % 16, b % 16) WHEN x % 5 = 1 THEN 'no colour' ELSE printf('#%02x%02x%02x', r, g, b) END AS raw FROM px)
SELECT x, y, hex, CASE WHEN regexp_full_match(upper(raw), '#?[0-9A-F]{{6}}') THEN '#' || upper(ltrim(raw, '#')) WHEN regexp_full_match(upper(raw), '#?[0-9A-F]{{3}}') THEN
 '#' || regexp_replace(upper(ltrim(raw, '#')), '(.)', '\\1\\1', 'g') END AS norm FROM t""")
def hex_codec(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    low = lambda c: F.lower(F.hex(c))
    short = F.concat(*(low(c % 16) for c in RGB()))
    raw = F.when(F.col("x") % 5 == 0, short).when(F.col("x") % 5 == 1, "no colour").otherwise(F.lower(color.to_hex(RGB())))
    return px.select("x", "y", color.to_hex(RGB()).alias("hex"), color.normalize_hex(raw).alias("norm"))


@query(f"WITH {sql.PX} SELECT x, y, {', '.join(f'round(-log10(greatest(0.004e0, {sql.lin(c)})), 6) AS d{c}' for c in 'rgb')} FROM px")
def density(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    return px.select("x", "y", *(six(d).alias(f"d{c}") for c, d in zip("rgb", color.density(RGB()), strict=True)))


_TONE = f"""{sql.lut(tone.tone_lut(**LUT))}, lum AS (SELECT *, lum_sum / n AS lm FROM cells),
graded AS (SELECT lum.*, a.v + (b.v - a.v) * ({sql.clamp01("lm")} * 255 - a.i) AS gr FROM lum JOIN lut a ON a.i = floor({sql.clamp01("lm")} * 255)::BIGINT JOIN lut b ON b.i = least(a.i + 1, 255)),
ink AS (SELECT *, CASE WHEN v0 <= 0 THEN 0e0 WHEN v0 >= 1 THEN 1e0 ELSE v0 / ((1 / 0.6e0 - 2) * (1 - v0) + 1) END AS ink FROM (SELECT *, 1 - gr AS v0 FROM graded)),
rad AS (SELECT *, (sqrt({sql.clamp01("ink")}) * 0.75e0 + {sql.clamp01("ink")} * 0.25e0) * (cell * 0.5e0) AS radius FROM ink)"""


def graded(spark, sf_dir, grid_of=None):
    px, w, h = pixels(spark, sf_dir)
    grid = cells.Grid.make(w, h, DENSITY)
    c = cells.aggregate(px, grid)
    ink = tone.bias(1 - tone.sample_lut(tone.tone_lut(**LUT), F.col("lum_sum") / F.col("n")), 0.2)
    return c.withColumn("ink", ink).withColumn("radius", tone.ink_to_radius(F.col("ink"), grid.cell * 0.5, 0.25)), grid


@query(f"""WITH {sql.PX}, {sql.grid(DENSITY)}, {sql.in_cells()}, {sql.CELLS}, {_TONE}
SELECT row, col, n, floor(r_sum / n::DOUBLE + 0.5)::BIGINT AS r, floor(g_sum / n::DOUBLE + 0.5)::BIGINT AS g, floor(b_sum / n::DOUBLE + 0.5)::BIGINT AS b, round(radius, 6) AS radius FROM rad""")
def cell_tone(spark, sf_dir):
    """The flagship: a picture's cells with mean colour and dot radius."""
    c, _ = graded(spark, sf_dir)
    return c.select("row", "col", "n", *(color.half_up(F.col(f"{k}_sum") / F.col("n")).alias(k) for k in "rgb"), six(F.col("radius")).alias("radius"))


@query(f"""WITH {sql.PX}, c AS (SELECT least(63, trunc({sql.luma709()} * 64))::BIGINT AS bucket, count(*) AS n FROM px WHERE a >= 8 GROUP BY 1)
SELECT i AS bucket, coalesce(n, 0)::BIGINT AS n FROM range(64) t(i) LEFT JOIN c ON c.bucket = i""")
def histogram(spark, sf_dir):
    return cells.histogram(images.events_image(spark, sf_dir))


@query(f"""WITH {sql.PX}, c AS (SELECT least(63, trunc({sql.luma709()} * 64))::BIGINT AS bucket, count(*) AS n FROM px WHERE a >= 8 GROUP BY 1),
f AS (SELECT i AS bucket, coalesce(n, 0)::BIGINT AS n FROM range(64) t(i) LEFT JOIN c ON c.bucket = i) SELECT bucket, round(sqrt(n / max(n) OVER ()::DOUBLE), 6) AS bar FROM f""")
def histogram_bars(spark, sf_dir):
    h = cells.histogram(images.events_image(spark, sf_dir))
    top = F.max("n").over(Window.partitionBy(F.lit(0)))  # as many rows as bins
    return h.select("bucket", six(F.sqrt(F.col("n") / top)).alias("bar"))


@query(f"""WITH {sql.PX}, {sql.grid(DENSITY)}, {sql.in_cells()}, {sql.CELLS},
wt AS (SELECT cp.row, cp.col, r, g, b, n, lum_sum, r_sum, g_sum, b_sum, exp(-((r - r_sum / n::DOUBLE) ** 2 + (g - g_sum / n::DOUBLE) ** 2 + (b - b_sum / n::DOUBLE) ** 2) / 6912e0) AS k FROM cp JOIN cells USING (row, col))
SELECT row, col, any_value(n) AS n, round(CASE WHEN sum(k) < 1e-6 THEN any_value(lum_sum) ELSE sum({sql.luma709()} * k) * any_value(n) / sum(k) END, 6) AS lum_sum,
  round(CASE WHEN sum(k) < 1e-6 THEN any_value(r_sum) ELSE sum(r * k) * any_value(n) / sum(k) END, 4) AS r_sum FROM wt GROUP BY row, col""")
def edge_aware(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    out = cells.edge_aware(px, cells.Grid.make(w, h, DENSITY))
    return out.select("row", "col", "n", six(F.col("lum_sum")).alias("lum_sum"), F.round("r_sum", 4).alias("r_sum"))


@query(f"""WITH {sql.PX}, {sql.lut([float(v) for v in tone.tone_bytes(tone.tone_lut(**LUT), True)])} SELECT x, y, lr.v::BIGINT AS r, lg.v::BIGINT AS g, lb.v::BIGINT AS b, a::BIGINT AS a
FROM px JOIN lut lr ON lr.i = r JOIN lut lg ON lg.i = g JOIN lut lb ON lb.i = b""")
def tone_map(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    table = F.array(*map(F.lit, tone.tone_bytes(tone.tone_lut(**LUT), True)))
    return px.select("x", "y", *(F.element_at(table, (F.col(c) + 1).cast("int")).cast("long").alias(c) for c in "rgb"), "a")


def _levels_sql() -> str:
    v = f"pow({sql.clamp01('(i - 10) / 230e0')}, 1 / 1.2e0)"
    return f"SELECT i::BIGINT AS i, round({sql.clamp01(f'({v} - 0.5e0) * 1.1e0 + 0.5e0 + 0.04e0')}, 6) AS v FROM range(256) t(i)"


@query(_levels_sql())
def tone_lut(spark, sf_dir):
    values = tone.tone_lut(**{**LUT, "curve": None})
    return spark.createDataFrame(list(enumerate(values)), "i long, v double").select("i", six(F.col("v")).alias("v"))


@query(f"""WITH {sql.PX}, v AS (SELECT x, y, {sql.luma709()} AS v FROM px) SELECT x, y, round(CASE WHEN v <= 0 THEN 0e0 WHEN v >= 1 THEN 1e0 ELSE v / ((1 / 0.25e0 - 2) * (1 - v) + 1) END, 6) AS biased,
  round((sqrt({sql.clamp01("v")}) * 0.7e0 + {sql.clamp01("v")} * 0.3e0) * 4e0, 6) AS radius FROM v""")
def bias_radius(spark, sf_dir):
    px, v = images.events_image(spark, sf_dir), color.luma(RGB())
    return px.select("x", "y", six(tone.bias(v, -0.5)).alias("biased"), six(tone.ink_to_radius(v, 4.0, 0.3)).alias("radius"))


@query(f"""WITH {sql.PX}, {sql.grid(DENSITY)}, {sql.in_cells()} SELECT row, col, count(*) AS n, round(row * cell + cell / 2 + gt + h / 2e0, 6) AS cy, round(col * cell + cell / 2 + gl + w / 2e0, 6) AS cx
FROM cp GROUP BY row, col, cell, gt, gl, h, w""")
def grid_centres(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    grid = cells.Grid.make(w, h, DENSITY)
    c = cells.aggregate(px, grid)
    cx, cy = grid.centre(F.col("col"), F.col("row"))
    return c.select("row", "col", "n", six(cy).alias("cy"), six(cx).alias("cx"))


@query(f"""WITH {sql.PX}, g AS (SELECT *, -cols * cell / 2 AS gl, -nrows * cell / 2 AS gt FROM (SELECT *, ceil((w * cos(radians(30)) + h * sin(radians(30))) / cell - 1e-9)::BIGINT AS cols,
 ceil((w * sin(radians(30)) + h * cos(radians(30))) / cell - 1e-9)::BIGINT AS nrows FROM (SELECT w, h, greatest(1.2e0, greatest(w, h) / 20e0) AS cell FROM dim))),
p AS (SELECT px.*, g.*, x + 0.5e0 - w / 2e0 AS dx, y + 0.5e0 - h / 2e0 AS dy FROM px, g WHERE a >= 8)
SELECT greatest(0, least(nrows - 1, trunc((dy * cos(radians(30)) - dx * sin(radians(30)) - gt) / cell)))::BIGINT AS row, greatest(0, least(cols - 1, trunc((dx * cos(radians(30)) + dy * sin(radians(30)) - gl) / cell)))::BIGINT AS col,
 count(*) AS n, sum(r)::BIGINT AS r_sum FROM p GROUP BY 1, 2""")
def cells_turned(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return cells.aggregate(px, cells.Grid.make(w, h, DENSITY, 30)).select("row", "col", "n", "r_sum")


@query(f"""WITH {sql.PX}, k AS (SELECT (r // 16) * 256 + (g // 16) * 16 + b // 16 AS key, count(*) AS n, floor(avg(r) + 0.5)::BIGINT AS r, floor(avg(g) + 0.5)::BIGINT AS g, floor(avg(b) + 0.5)::BIGINT AS b FROM px WHERE a >= 8 GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, key) AS rank, n, r, g, b FROM k QUALIFY rank <= 8""")
def popularity_topk(spark, sf_dir):
    out = palette.popularity(cells.opaque(images.events_image(spark, sf_dir)), 8)
    return out.select(F.col("rank").cast("long"), "n", "r", "g", "b")


@query(f"WITH {sql.PX}, k AS (SELECT greatest(1, floor(sqrt(w * h / 900e0)))::BIGINT AS k FROM dim) SELECT x, y, r, g, b FROM px, k WHERE a >= 8 AND x % k = 0 AND y % k = 0")
def stride_sample(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return palette.stride_sample(px, w, h, 900).select("x", "y", "r", "g", "b")


@query(f"WITH {sql.PX}, {sql.pal(INKS)} SELECT x, y, idx::INT AS idx FROM {sql.nearest('px')}")
def nearest_palette(spark, sf_dir):
    return images.events_image(spark, sf_dir).select("x", "y", palette.nearest(RGB(), INKS).alias("idx"))


@query(f"""WITH {sql.PX}, {sql.pal(INKS)}, n AS {sql.nearest("px")} SELECT idx::INT AS idx, count(*) AS n, round(avg(okl), 6) AS okl, round(avg(oka), 6) AS oka, round(avg(okb), 6) AS okb
FROM n JOIN {sql.with_lab("px")} USING (x, y) GROUP BY idx""")
def kmeans_round(spark, sf_dir):
    """One round of Lloyd's: assign to the nearest centre, then average in OKLab."""
    labs = dict(zip(("okl", "oka", "okb"), color.rgb_to_oklab(RGB()), strict=True))
    px = images.events_image(spark, sf_dir).withColumns({"idx": palette.nearest(RGB(), INKS), **labs})
    return px.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), *(six(F.avg(c)).alias(c) for c in labs))


@query(f"""WITH {sql.pal(INKS)}, m AS (SELECT avg(okl) AS ml, avg(oka) AS ma, avg(okb) AS mb FROM pal),
s AS (SELECT idx, {sql.clamp01("ml + (okl - ml) * 1.4e0")} AS okl, ma + (oka - ma) * 1.24e0 AS oka, mb + (okb - mb) * 1.24e0 AS okb FROM pal, m) SELECT idx::INT AS idx, nr AS r, ng AS g, nb AS b FROM {sql.from_lab("s")}""")
def palette_spread(spark, sf_dir):
    p = spark.createDataFrame([("p", i, *c) for i, c in enumerate(INKS)], "image_id string, idx int, r int, g int, b int")
    return palette.spread(p, 0.4).select("idx", *(F.col(c).cast("long").alias(c) for c in "rgb"))


@query(f"WITH {sql.pal(INKS)} SELECT arg_max(idx, {sql.luma709()})::INT AS lightest, arg_min(idx, {sql.luma709()})::INT AS darkest FROM pal")
def paper_pick(spark, sf_dir):
    p = spark.createDataFrame([("p", i, *c) for i, c in enumerate(INKS)], "image_id string, idx int, r int, g int, b int")
    return palette.paper(p).join(palette.paper(p, True).withColumnRenamed("paper", "darkest"), "image_id").select(F.col("paper").alias("lightest"), "darkest")


@query(f"""WITH {sql.pal(INKS)} SELECT idx::INT AS idx, row_number() OVER (ORDER BY {sql.luma709()}, idx)::INT AS rank FROM pal WHERE idx <> (SELECT arg_max(idx, {sql.luma709()}) FROM pal)""")
def ink_order(spark, sf_dir):
    """All but the paper, darkest first."""
    p = spark.createDataFrame([("p", i, *c) for i, c in enumerate(INKS)], "image_id string, idx int, r int, g int, b int")
    inks = p.join(palette.paper(p), "image_id").where("idx <> paper")
    return inks.select("idx", F.row_number().over(Window.partitionBy("image_id").orderBy(color.luma(RGB()), "idx")).alias("rank"))



@query(f"""WITH {sql.PX}, tx AS (SELECT x, max(k) AS tx FROM (SELECT DISTINCT x FROM px), range(37) r(k) WHERE floor(k * 100 / 37e0 + 0.5) <= x GROUP BY x),
ty AS (SELECT y, max(k) AS ty FROM (SELECT DISTINCT y FROM px), range(13) r(k), dim WHERE floor(k * h / 13e0 + 0.5) <= y GROUP BY y)
SELECT tx AS x, ty AS y, {", ".join(f"CASE WHEN sum(a / 255e0) > 1e-6 THEN {sql.byte(f'sum({c} * (a / 255e0)) / sum(a / 255e0)')} ELSE 0 END AS {c}" for c in "rgb")}, {sql.byte("avg(a)")} AS a
FROM px JOIN tx USING (x) JOIN ty USING (y) GROUP BY tx, ty""")
def box_downscale(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return cells.downscale(px, w, h, 37, 13).select("x", "y", "r", "g", "b", "a")


def _blurred(table: str) -> str:
    return f"WITH {sql.PX} SELECT x, y, {', '.join(f'round({c}, 6) AS {c}' for c in 'rgb')} FROM {table}"


@query(_blurred(sql.box("px", list("rgb"), "x", "y", "100", 3)))
def box_blur_h(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return blur.box(px, "x", w, 3).select("x", "y", *(six(F.col(c)).alias(c) for c in "rgb"))


@query(_blurred(sql.box("px", list("rgb"), "y", "x", "(SELECT h FROM dim)", 3)))
def box_blur_v(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return blur.box(px, "y", h, 3).select("x", "y", *(six(F.col(c)).alias(c) for c in "rgb"))


def _radii(sigma: float) -> list[int]:
    return [(k - 1) // 2 for k in blur.box_sizes(sigma)]


@query(f"WITH {sql.PX} SELECT x, y, r, g, b, a::BIGINT AS a FROM {sql.gaussian('px', _radii(2), list('rgb'))}")
def gaussian3(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return blur.gaussian(px, w, h, 2).select("x", "y", "r", "g", "b", "a")



@query(f"""WITH {sql.PX}, p2 AS (SELECT *, r AS r0, g AS g0, b AS b0 FROM px), bl AS {sql.gaussian("p2", _radii(2), list("rgb"))}
SELECT x, y, {", ".join(f"CASE WHEN abs({c}0 - {c}) < 3 THEN {c}0 ELSE {sql.byte(f'{c}0 + ({c}0 - {c}) * 0.6e0')} END AS {c}" for c in "rgb")} FROM bl""")
def unsharp(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return blur.unsharp(px, w, h, 60, 2).select("x", "y", "r", "g", "b")


_T = "((CASE WHEN far >= 26 THEN 0e0 ELSE 1 - (far / 26e0) * (far / 26e0) END) * 0.5e0)"


@query(f"""WITH {sql.PX}, p2 AS (SELECT *, r AS r0, g AS g0, b AS b0 FROM px), bl AS (SELECT *, greatest(abs(r0 - r), abs(g0 - g), abs(b0 - b)) AS far FROM {sql.gaussian("p2", _radii(1.6), list("rgb"))})
SELECT x, y, {", ".join(f"{sql.byte(f'{c}0 * (1 - {_T}) + {c} * {_T}')} AS {c}" for c in "rgb")} FROM bl""")
def denoise(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return blur.denoise(px, w, h, 50).select("x", "y", "r", "g", "b")


@query(f"WITH {sql.PX} SELECT x, y, {', '.join(f'round({sql.hash01("x", "y", 7, k)}, 9) AS h{k}' for k in (1, 4))} FROM px")
def positional_hash(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    return px.select("x", "y", *(F.round(geometry.hash01(F.col("x"), F.col("y"), 7, k), 9).alias(f"h{k}") for k in (1, 4)))


@query("""SELECT (i)::BIGINT AS i, round((10 + 45 + ([45, 15, 75, 0, 30, 60, 22.5, 67.5, 52.5][i + 1] - 45) * 0.8e0) % 180, 6) AS angle FROM range(9) t(i)""")
def screen_angles(spark, sf_dir):
    return spark.createDataFrame([(i, round(a, 6)) for i, a in enumerate(geometry.screen_angles(9, 10, 0.8))], "i long, angle double")


@query(f"""SELECT i::BIGINT AS i, round(cos({sql.hash01("i", "0", 3, 11)} * pi() * 2) * (0.35e0 + 0.65e0 * {sql.hash01("i", "0", 3, 12)}) * 2e0, 6) AS dx,
 round(sin({sql.hash01("i", "0", 3, 11)} * pi() * 2) * (0.35e0 + 0.65e0 * {sql.hash01("i", "0", 3, 12)}) * 2e0, 6) AS dy FROM range(9) t(i)""")
def misregistration(spark, sf_dir):
    return spark.createDataFrame([(i, *(round(v, 6) for v in geometry.ink_offset(i, 25, 8.0, 3))) for i in range(9)], "i long, dx double, dy double")


def _bands_sql() -> str:
    luma = sql.luma709()
    return f"""WITH {sql.PX}, {sql.pal(INKS)}, z AS (SELECT *, {luma} AS l FROM px),
n AS {sql.nearest("z", where="(t.l < 0.33e0 AND p.idx < 3) OR (t.l >= 0.33e0 AND t.l < 0.66e0 AND p.idx BETWEEN 1 AND 3) OR (t.l >= 0.66e0 AND p.idx >= 2)")} SELECT x, y, idx::INT AS idx FROM n"""


@query(_bands_sql())
def tonal_zones(spark, sf_dir):
    bands, light = tone.zone_bands(len(INKS), 0.33, 0.66), color.luma(RGB())
    low, mid, high = (palette.nearest(RGB(), INKS, *b) for b in bands)
    return images.events_image(spark, sf_dir).select("x", "y", F.when(light < 0.33, low).when(light < 0.66, mid).otherwise(high).alias("idx"))


@query(f"""WITH {sql.PX} SELECT x, y, r, CASE WHEN n = 1 THEN r ELSE g END AS g, CASE WHEN n = 1 THEN r ELSE b END AS b, CASE WHEN n = 4 THEN a ELSE 255 END::BIGINT AS a FROM (SELECT *, [1, 3, 4][x % 3 + 1] AS n FROM px)""")
def widen_components(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    return images.widen(px, F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.col("x") % 3 + 1).cast("int"))).select("x", "y", "r", "g", "b", "a")


@query(f"""WITH {sql.PX}, s AS (SELECT x // 2 AS x, y AS y, any_value(event_type) FILTER (WHERE false) AS z, max((r + g) % 256)::BIGINT AS a FROM (SELECT px.*, NULL AS event_type FROM px) WHERE x < 80 GROUP BY 1, 2)
SELECT px.x, px.y, coalesce(s.a, 0)::BIGINT AS a FROM px LEFT JOIN s ON px.x = s.x + 10 AND px.y = s.y + 2""")
def selection_mask(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    s = px.where("x < 80").groupBy(F.floor(F.col("x") / 2).alias("mx"), F.col("y").alias("my")).agg(F.max((F.col("r") + F.col("g")) % 256).alias("a"))
    return images.mask_by_selection(px, s, 10, 2).select("x", "y", "a")


@query("SELECT x, y, r, 255::BIGINT AS a FROM (SELECT i % 64 AS x, i // 64 AS y, floor((i % 64) * 255 / 63e0 + 0.5)::BIGINT AS r FROM range(64 * 16) t(i))")
def gradient_image(spark, sf_dir):
    return images.gradient(spark, 64, 16).select("x", "y", "r", "a")


@query("""SELECT i % 50 AS x, i // 50 AS y, [230, 250, 30, 20, 245][least(4, floor((i % 50) * 5 / 50))::INT + 1]::BIGINT AS r, [30, 200, 120, 20, 240][least(4, floor((i % 50) * 5 / 50))::INT + 1]::BIGINT AS g,
  [40, 40, 220, 24, 225][least(4, floor((i % 50) * 5 / 50))::INT + 1]::BIGINT AS b FROM range(50 * 30) t(i)""")
def flats_image(spark, sf_dir):
    return images.flats(spark, 50, 30).select("x", "y", "r", "g", "b")


@query(f"WITH {sql.PX} SELECT floor(avg(r) + 0.5)::BIGINT AS r, floor(avg(g) + 0.5)::BIGINT AS g, round(avg(CASE WHEN abs(r - 245) + abs(g - 240) + abs(b - 225) > 6 THEN 1e0 ELSE 0 END), 6) AS coverage, round(avg((abs(r - 245) + abs(g - 240) + abs(b - 225)) / 765e0), 6) AS ink, min(a) = 255 AS opaque FROM px")
def image_metrics(spark, sf_dir):
    far = sum((F.abs(F.col(c) - v) for c, v in zip("rgb", INKS[-1], strict=True)), F.lit(0))
    px = images.events_image(spark, sf_dir)
    return px.agg(*(color.half_up(F.avg(c)).alias(c) for c in "rg"), six(F.avg((far > 6).cast("double"))).alias("coverage"), six(F.avg(far / 765.0)).alias("ink"), F.bool_and(F.col("a") == 255).alias("opaque"))
