"""Queries on dithering, dots, masks, vector output, records and batches, with their SQL where it has a form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, geometry, tone
from ..functions.kernels import KERNELS
from ..functions.matrices import ORDERED
from ..functions.params import sanitized, stepped
from ..operators import cells, dither, palette, raster, records, separation, svg
from ..operators.palette import INKS
from ..sources import codecs, images
from . import render, sql
from .basic import _TONE, DENSITY, LUT, pixels, six

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PAPER = INKS[-1]


def add(name: str, f, oracle: str | None = None) -> None:
    QUERIES[name] = f
    if oracle:
        ORACLE[name] = oracle


def query(oracle: str | None = None):
    def put(f):
        add(f.__name__, f, oracle)
        return f

    return put


def _matrix_sql(name: str) -> str:
    m = ORDERED[name]()
    rows = ", ".join(f"({y}, {x}, {float(v)!r}e0)" for y, line in enumerate(m) for x, v in enumerate(line))
    return f"mat(my, mx, th) AS (VALUES {rows})"


def _mix_ctes(strength: float = 1) -> str:
    pull = f"t + ((CASE WHEN t < 0.5e0 THEN 0 ELSE 1 END) - t) * {1 - strength}e0" if strength != 1 else "t"
    return f"""{sql.pal(INKS)}, n AS {sql.nearest("px")},
pairs AS (SELECT px.x, px.y, n.idx AS a, p.idx AS j, px.r - q.r AS pr, px.g - q.g AS pg, px.b - q.b AS pb, p.r - q.r AS dr, p.g - q.g AS dg, p.b - q.b AS db
  FROM px JOIN n USING (x, y) JOIN pal q ON q.idx = n.idx JOIN pal p ON p.idx <> n.idx),
ts AS (SELECT *, {sql.clamp01("(pr * dr + pg * dg + pb * db) / (dr * dr + dg * dg + db * db)::DOUBLE")} AS t FROM pairs),
es AS (SELECT *, (pr - t * dr) ** 2 + (pg - t * dg) ** 2 + (pb - t * db) ** 2 AS e FROM ts),
mix AS (SELECT x, y, any_value(a) AS a, arg_min(j, struct_pack(e := e, j := j)) AS j, arg_min({pull}, struct_pack(e := e, j := j)) AS t FROM es GROUP BY x, y)"""


def _ordered_sql(name: str, strength: float = 1) -> str:
    n = ORDERED[name]().shape[0]
    return f"WITH {sql.PX}, {_matrix_sql(name)}, {_mix_ctes(strength)} SELECT x, y, CASE WHEN th < t THEN j ELSE a END::INT AS idx FROM mix JOIN mat ON my = y % {n} AND mx = x % {n}"


def _dithered(name: str, strength: float = 1):
    def run(spark, sf_dir):
        return dither.dither(images.events_image(spark, sf_dir), INKS, name, strength).select("x", "y", "idx")

    return run


for _name in ("bayer2", "bayer4", "bayer8", "bayer16", "cluster4", "cluster6", "cluster8", "cluster45", "lineh", "linev", "linediag"):
    add(f"dither_{_name}", _dithered(_name), _ordered_sql(_name))
add("dither_threshold", _dithered("threshold"), f"WITH {sql.PX}, {sql.pal(INKS)} SELECT x, y, idx::INT AS idx FROM {sql.nearest('px')}")
add("dither_bayer4_half", _dithered("bayer4", 0.5), _ordered_sql("bayer4", 0.5))
add("dither_whitenoise", _dithered("whitenoise"))
add("dither_bluenoise", _dithered("bluenoise"))
for _name in KERNELS:
    add(f"diffusion_{_name}", _dithered(_name))


@query(f"WITH {sql.PX}, {_mix_ctes()} SELECT x, y, a::INT AS a, j::INT AS j, round(t, 6) AS t FROM mix")
def best_mix(spark, sf_dir):
    rgb = tuple(map(F.col, "rgb"))
    px = images.events_image(spark, sf_dir).withColumn("a", palette.nearest(rgb, INKS))
    pair = None
    for i in range(len(INKS)):
        j, t = palette.best_mix(rgb, INKS, i)
        own = F.struct(j.alias("j"), t.alias("t"))
        pair = F.when(F.col("a") == i, own) if pair is None else pair.when(F.col("a") == i, own)
    return px.withColumn("m", pair).select("x", "y", "a", F.col("m.j").alias("j"), six(F.col("m.t")).alias("t"))


_UP = f"""WITH {sql.PX}, {sql.pal(INKS)}, n AS {sql.nearest("px")}, o AS (SELECT i % 70 AS x, i // 70 AS y FROM range(70 * 30) t(i)),
e AS (SELECT o.x, o.y, n.idx FROM o, dim JOIN n ON n.x = least(99, floor((o.x + 40) * 100 / 250e0)) AND n.y = least(dim.h - 1, floor((o.y + 5) * dim.h / 130e0)))"""


@query(f"{_UP} SELECT x, y, idx::INT AS idx FROM e")
def upscale_nearest(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return dither.expand(dither.dither(px, INKS, "threshold"), w, h, 250, 130, (40, 5, 70, 30)).select("x", "y", "idx")


@query(f"{_UP} SELECT x, y, p.r::BIGINT AS r, p.g::BIGINT AS g, p.b::BIGINT AS b, 255::BIGINT AS a FROM e JOIN pal p USING (idx)")
def index_to_pixels(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    index = dither.expand(dither.dither(px, INKS, "threshold"), w, h, 250, 130, (40, 5, 70, 30))
    return dither.colours(index, INKS).select("x", "y", "r", "g", "b", "a")


@query(f"WITH {sql.PX}, {sql.pal(INKS)}, n AS {sql.nearest('px')} SELECT k::INT AS plate, x, y, CASE WHEN idx = k THEN 255 ELSE 0 END::INT AS v FROM n, range(5) t(k)")
def index_masks(spark, sf_dir):
    px = images.events_image(spark, sf_dir)
    return dither.masks(dither.dither(px, INKS, "threshold"), len(INKS)).select("plate", "x", "y", "v")


# ---- dots ----

_DOTS = f"""{sql.grid(DENSITY)}, {sql.in_cells()}, {sql.CELLS}, {_TONE},
dots AS (SELECT row, col, row * cols + col AS ord, (col + 0.5e0) * cell + gl + w / 2e0 AS cx, (row + 0.5e0) * cell + gt + h / 2e0 AS cy, radius + cell * 0.1e0 AS radius, cell, w, h FROM rad WHERE radius > 0.008e0)"""
OPTIONS = dict(curve=0.25, gain=10, bias=0.2)
JITTER = dict(position=40, size=30, angle=90, seed=7)


def dotted(spark, sf_dir, **more):
    px, w, h = pixels(spark, sf_dir)
    grid = cells.Grid.make(w, h, DENSITY)
    return raster.dots(cells.aggregate(px, grid), grid, tone.tone_lut(**LUT), **{**OPTIONS, **more}), grid, w, h


@query(f"WITH {sql.PX}, {_DOTS} SELECT row, col, ord, round(cx, 6) AS cx, round(cy, 6) AS cy, round(radius, 6) AS radius FROM dots")
def dots_am(spark, sf_dir):
    d, *_ = dotted(spark, sf_dir)
    return d.select("row", "col", "ord", six(F.col("cx")).alias("cx"), six(F.col("cy")).alias("cy"), six(F.col("radius")).alias("radius"))


def _s(salt: int) -> str:
    return f"({sql.hash01('col', 'row', 7, salt)} * 2 - 1)"


@query(f"""WITH {sql.PX}, {_DOTS}, j AS (SELECT row, col, cx + {_s(1)} * (0.4e0 * cell * 0.5e0) AS cx, cy + {_s(2)} * (0.4e0 * cell * 0.5e0) AS cy, radius * greatest(0.05e0, 1 + {_s(3)} * 0.3e0) AS radius, {_s(4)} * radians(90) AS rot FROM dots)
SELECT row, col, round(cx, 6) AS cx, round(cy, 6) AS cy, round(radius, 6) AS radius, round(rot, 6) AS rot FROM j WHERE radius > 0.008e0""")
def dots_jitter(spark, sf_dir):
    d, *_ = dotted(spark, sf_dir, jitter=JITTER)
    return d.select("row", "col", *(six(F.col(c)).alias(c) for c in ("cx", "cy", "radius", "rot")))


@query(f"""WITH {sql.PX}, {_DOTS} SELECT row, col, round(cx - 20, 6) AS cx, round(cy - 10, 6) AS cy FROM dots
WHERE cx - 20 BETWEEN -(cell + 2) AND 30 + cell + 2 AND cy - 10 BETWEEN -(cell + 2) AND 40 + cell + 2""")
def view_cull(spark, sf_dir):
    d, *_ = dotted(spark, sf_dir, view=(20, 10, 30, 40))
    return d.select("row", "col", six(F.col("cx")).alias("cx"), six(F.col("cy")).alias("cy"))


def _stamp_sql(sdf: str, ext: str, source: str = "dots") -> str:
    """Pixels of dots of half a pixel or more, and the four of smaller ones."""
    return f"""big AS (SELECT d.*, px_.x, py_.y, {sdf.format(dx="(px_.x + 0.5e0 - cx)", dy="(py_.y + 0.5e0 - cy)")} AS sd FROM {source} d, range(0, 100) px_(x), range(0, 100000) py_(y)
 WHERE radius >= 0.5e0 AND py_.y < h AND px_.x >= floor(cx - ({ext})) AND px_.x < ceil(cx + ({ext})) AND py_.y >= floor(cy - ({ext})) AND py_.y < ceil(cy + ({ext}))),
tiny AS (SELECT d.*, fx, fy, cx - 0.5e0 - fx AS tx, cy - 0.5e0 - fy AS ty, least(1e0, pi() * radius * radius) AS ar FROM (SELECT *, floor(cx - 0.5e0) AS fx, floor(cy - 0.5e0) AS fy FROM {source} WHERE radius < 0.5e0) d),
stamps AS (SELECT ord, x, y, CASE WHEN sd <= -0.5e0 THEN 1e0 ELSE 0.5e0 - sd END AS cov FROM big WHERE sd < 0.5e0
 UNION ALL SELECT ord, (fx + i)::BIGINT AS x, (fy + j)::BIGINT AS y, ar * (CASE i WHEN 1 THEN tx ELSE 1 - tx END) * (CASE j WHEN 1 THEN ty ELSE 1 - ty END) AS cov FROM tiny, range(2) a(i), range(2) b(j)
 WHERE ar > 0.0005e0 AND fx + i BETWEEN 0 AND 99 AND fy + j BETWEEN 0 AND h - 1 AND (CASE i WHEN 1 THEN tx ELSE 1 - tx END) * (CASE j WHEN 1 THEN ty ELSE 1 - ty END) > 0)"""


_CIRCLE = _stamp_sql("sqrt({dx} * {dx} + {dy} * {dy}) - radius", "radius + 1")
_SQUARE = _stamp_sql("greatest(abs({dx}), abs({dy})) - radius * 0.886226925452758e0", "radius * 0.886226925452758e0 * sqrt(2e0) + 2")
_DIAMOND = _stamp_sql("(abs({dx}) + abs({dy}) - radius * 1.2533141373155003e0) / sqrt(2e0)", "radius * 1.2533141373155003e0 + 2")
_COVER = "SELECT ord, x, y, round(cov, 6) AS cov FROM stamps"


def _stamped(shape: str):
    def run(spark, sf_dir):
        d, grid, w, h = dotted(spark, sf_dir)
        return raster.stamp(d, shape, grid.cell, w, h).select("ord", "x", "y", six(F.col("a")).alias("cov"))

    return run


for _name, _sql in (("circle", _CIRCLE), ("square", _SQUARE), ("diamond", _DIAMOND), ("ellipse", None), ("cross", None), ("line", None)):
    add(f"coverage_{_name}", _stamped(_name), f"WITH {sql.PX}, {_DOTS}, {_sql} {_COVER}" if _sql else None)


def coloured(spark, sf_dir):
    """Dots with their cell's nearest entry and its colour."""
    d, grid, w, h = dotted(spark, sf_dir)
    mean = tuple(F.floor(F.col(f"{c}_sum") / F.col("n")) for c in "rgb")
    d = d.withColumn("idx", palette.nearest(mean, INKS))
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in INKS)), F.col("idx") + 1)
    return d.withColumns({c: pick(k) for k, c in enumerate("rgb")}), grid, w, h


_INKED = f"""{sql.pal(INKS)}, mean AS (SELECT row, col, r_sum // n AS r, g_sum // n AS g, b_sum // n AS b FROM cells), own AS {sql.nearest("mean", keys="row, col")},
inked AS (SELECT dots.*, own.idx, p.r, p.g, p.b FROM dots JOIN own USING (row, col) JOIN pal p ON p.idx = own.idx)"""


def _fold(start: str, step: str) -> str:
    return f"SELECT x, y, list_reduce(list(struct_pack(a := cov, r := r::DOUBLE, g := g::DOUBLE, b := b::DOUBLE, idx := idx) ORDER BY ord), lambda o, d: {step}, {start}) AS f FROM stamps JOIN inked USING (ord) GROUP BY x, y"


def _rgb_step(one: str) -> str:
    return "struct_pack(a := 0e0, " + ", ".join(f"{c} := {one.format(c=c)}" for c in "rgb") + ", idx := 0)"


_START = "struct_pack(a := 0e0, " + ", ".join(f"{c} := {float(v)}e0" for c, v in zip("rgb", PAPER, strict=True)) + ", idx := 0)"
_OVER = _fold(_START, _rgb_step("CASE WHEN d.a >= 0.999e0 THEN d.{c} ELSE round_even(d.{c} * d.a + o.{c} * (1 - d.a), 0) END"))
_MULTIPLY = _fold(_START, _rgb_step("round_even(o.{c} * (1 - d.a + d.a * d.{c} / 255e0), 0)"))
_AS_BYTES = "SELECT x, y, f.r::BIGINT AS r, f.g::BIGINT AS g, f.b::BIGINT AS b FROM"


@query(f"WITH {sql.PX}, {_DOTS}, {_INKED}, {_CIRCLE} {_AS_BYTES} ({_OVER})")
def composite_over(spark, sf_dir):
    d, grid, w, h = coloured(spark, sf_dir)
    s = raster.stamp(d, "circle", grid.cell, w, h, ("image_id", "ord", "r", "g", "b"))
    return raster.over(s, PAPER).select("x", "y", "r", "g", "b")


@query(f"WITH {sql.PX}, {_DOTS}, {_INKED}, {_CIRCLE} {_AS_BYTES} ({_MULTIPLY})")
def composite_multiply(spark, sf_dir):
    d, grid, w, h = coloured(spark, sf_dir)
    s = raster.stamp(d, "circle", grid.cell, w, h, ("image_id", "ord", "r", "g", "b"))
    return raster.multiply(s, PAPER).select("x", "y", "r", "g", "b")


_SCREEN = "SELECT x, y, list_reduce(list(cov ORDER BY ord), lambda o, d: round_even((o / 255e0 + d * (1 - o / 255e0)) * 255e0, 0), 0e0)::BIGINT AS v FROM stamps GROUP BY x, y"


@query(f"WITH {sql.PX}, {_DOTS}, {_CIRCLE} {_SCREEN}")
def screen_mask(spark, sf_dir):
    d, grid, w, h = dotted(spark, sf_dir)
    return raster.ink_masks(raster.stamp(d, "circle", grid.cell, w, h), ("image_id", "x", "y")).select("x", "y", "v")


_PLATES = f"""WITH {sql.PX}, {_DOTS}, {_INKED}, {_CIRCLE}, l AS (SELECT x, y, list(struct_pack(a := cov, idx := idx) ORDER BY ord) AS l FROM stamps JOIN inked USING (ord) GROUP BY x, y)
SELECT x, y, k::INT AS plate, list_reduce(list_transform(l, lambda s: struct_pack(a := s.a, idx := s.idx, v := 0e0)), lambda o, d: struct_pack(a := 0e0, idx := 0, v := round_even(o.v * (1 - d.a) + CASE WHEN d.idx = k THEN 255e0 * d.a ELSE 0e0 END, 0)),
 struct_pack(a := 0e0, idx := 0, v := CASE WHEN k = 4 THEN 255e0 ELSE 0e0 END)).v::BIGINT AS v FROM l, range(5) t(k)"""


@query(_PLATES)
def masks_exclusive(spark, sf_dir):
    d, grid, w, h = coloured(spark, sf_dir)
    s = raster.stamp(d, "circle", grid.cell, w, h, ("image_id", "ord", "idx"))
    return raster.exclusive_masks(s, len(INKS), len(INKS) - 1).select("x", "y", F.col("plate").cast("int"), "v")


@query(f"WITH {sql.PX}, {_DOTS}, {_INKED}, {_CIRCLE}, o AS ({_AS_BYTES} ({_OVER})) SELECT px.x, px.y, coalesce(o.r, {PAPER[0]})::BIGINT AS r, coalesce(o.g, {PAPER[1]})::BIGINT AS g, coalesce(o.b, {PAPER[2]})::BIGINT AS b, 255::BIGINT AS a FROM px LEFT JOIN o USING (x, y)")
def render_single(spark, sf_dir):
    """A whole single-screen rendering on its paper."""
    d, grid, w, h = coloured(spark, sf_dir)
    painted = raster.over(raster.stamp(d, "circle", grid.cell, w, h, ("image_id", "ord", "r", "g", "b")), PAPER)
    return raster.filled(painted, images.blank(spark, w, h), "events", PAPER).select("x", "y", "r", "g", "b", "a")


def _num(v: str) -> str:
    return f"(CASE WHEN abs({v}) < 0.005e0 THEN '0' ELSE regexp_replace(printf('%.2f', {v}), '\\.?0+$', '') END)"


@query(f"""WITH {sql.PX}, {_DOTS}, {_INKED} SELECT row, col, '<circle cx="' || {_num("cx")} || '" cy="' || {_num("cy")} || '" r="' || {_num("radius")} || '"/>' AS m FROM inked""")
def svg_markup(spark, sf_dir):
    d, grid, *_ = coloured(spark, sf_dir)
    return d.select("row", "col", svg.markup("circle", grid.cell).alias("m"))


@query(f"""WITH {sql.PX}, {_DOTS}, {_INKED}, m AS (SELECT ord, printf('#%02X%02X%02X', r, g, b) AS hex, '<circle cx="' || {_num("cx")} || '" cy="' || {_num("cy")} || '" r="' || {_num("radius")} || '"/>' AS m, w, h FROM inked),
gr AS (SELECT min(ord) AS f, count(*) AS n, any_value(w) AS w, any_value(h) AS h, '<g id="ink-' || substr(hex, 2) || '" fill="' || hex || '">' || chr(10) || string_agg(m, chr(10) ORDER BY ord) || chr(10) || '</g>' AS g FROM m GROUP BY hex)
SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="' || any_value(w) || '" height="' || any_value(h) || '" viewBox="0 0 ' || any_value(w) || ' ' || any_value(h) || '">' || chr(10) || string_agg(g, chr(10) ORDER BY f) || chr(10) || '</svg>' AS svg, sum(n)::BIGINT AS shapes, sum(n) > 200000 AS busy FROM gr""")
def svg_document(spark, sf_dir):
    d, grid, w, h = coloured(spark, sf_dir)
    d = d.withColumn("hex", color.to_hex(tuple(map(F.col, "rgb"))))
    return svg.document(d, "circle", grid.cell, w, h).select("svg", "shapes", "busy")


# ---- no SQL form ----


@query()
def dots_fm(spark, sf_dir):
    d, *_ = dotted(spark, sf_dir, fm=True)
    return d.select("row", "col", "cx", "cy", "radius")


@query()
def unmix(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return separation.coverages(separation.means(cells.aggregate(px, cells.Grid.make(w, h, DENSITY))), INKS[:4], (255, 255, 255)).select("row", "col", "n", "cov")


@query()
def per_ink_screens(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    return separation.screens(px, w, h, INKS[:4], (255, 255, 255), DENSITY).drop("image_id")


@query()
def render_per_ink(spark, sf_dir):
    """Multiplied screens, each slipped and at its own angle."""
    px, w, h = pixels(spark, sf_dir)
    p = {**sanitized({"density": DENSITY, "screenMode": "perInk", "misregistration": 10, "background": "auto"})}
    made, cell = render.screen_dots(px, w, h, p, render.Colours(list(INKS), list(INKS), len(INKS) - 1), w, h, 72)
    return raster.multiply(raster.stamp(made, "circle", cell, w, h, ("image_id", "ord", "r", "g", "b")), PAPER).select("x", "y", "r", "g", "b")


# ---- one ink on white: the lasso has a closed form ----

_INK = (200, 40, 60)
_SHEET = (255, 255, 255)
#: Levels, gamma, contrast, exposure and bias, an upright screen (its own angle is 45), edges kept as they are.
_PRESS = dict(density=DENSITY, screenMode="perInk", blackPoint=10, whitePoint=240, gamma=1.2, contrast=1.1, exposure=4, gradeBias=0.2, dotGain=10, radiusCurve=0.25, invert=True)


def _tone_at(i: str) -> str:
    return sql.clamp01(f"(pow({sql.clamp01(f'({i} - 10e0) / 230e0')}, 1 / 1.2e0) - 0.5e0) * 1.1e0 + 0.54e0")


def _density_of(v: str) -> str:
    return f"-log10(greatest(0.004e0, {sql.lin(v)}))"


_FLAT = ", ".join(f"{_density_of(f'{v}e0')} AS i{c}" for c, v in zip("rgb", _INK, strict=True))
_GRADED = ", ".join(f"floor(255e0 - 255e0 * ({_tone_at(f'floor({c})')} + ({_tone_at(f'least(255, floor({c}) + 1)')} - {_tone_at(f'floor({c})')}) * ({c} - floor({c}))) + 0.5e0) AS {c}" for c in "rgb")
_ONE_INK = f"""{sql.grid(DENSITY)}, {sql.in_cells()}, {sql.CELLS}, flat AS (SELECT {_FLAT}), mean AS (SELECT * EXCLUDE (n), n, r_sum / n AS r, g_sum / n AS g, b_sum / n AS b FROM cells),
graded AS (SELECT * REPLACE ({_GRADED}) FROM mean), part AS (SELECT graded.*, {sql.clamp01(f"({_density_of('r')} * ir + {_density_of('g')} * ig + {_density_of('b')} * ib) / (ir * ir + ig * ig + ib * ib) - 0.015e0")} AS c0 FROM graded, flat),
cov AS (SELECT *, CASE WHEN c0 <= 0 THEN 0e0 WHEN c0 >= 1 THEN 1e0 ELSE c0 / ((1 / 0.6e0 - 2) * (1 - c0) + 1) END AS cov FROM part)"""
_INK_DOTS = f"""{_ONE_INK}, dots AS (SELECT row, col, row * cols + col AS ord, (col + 0.5e0) * cell + gl + w / 2e0 AS cx, (row + 0.5e0) * cell + gt + h / 2e0 AS cy,
 (sqrt(cov) * 0.75e0 + cov * 0.25e0) * cell * 0.5e0 + cell * 0.1e0 AS radius, cell, w, h FROM cov WHERE (sqrt(cov) * 0.75e0 + cov * 0.25e0) * cell * 0.5e0 > 0.008e0)"""


def _one_ink():
    return {**sanitized(_PRESS), "angle": -45.0}, render.Colours([_INK, _SHEET], [_INK, _SHEET], 1)


@query(f"WITH {sql.PX}, {_ONE_INK} SELECT row, col, n, round(cov, 6) AS cov FROM cov")
def ink_screen(spark, sf_dir):
    """Coverage of one ink, from graded cells."""
    px, w, h = pixels(spark, sf_dir)
    p, _ = _one_ink()
    found = separation.screens(px, w, h, [_INK], _SHEET, DENSITY, p["angle"], 1, p["gradeBias"], lut=render.lut(p), invert=True)
    return found.select("row", "col", "n", six(F.col("cov")).alias("cov"))


@query(f"WITH {sql.PX}, {_INK_DOTS}, {_CIRCLE}, k AS ({_SCREEN}) SELECT 1 AS plate, x, y, 255::BIGINT AS v FROM px UNION ALL SELECT 0 AS plate, x, y, v FROM k")
def ink_plates(spark, sf_dir):
    """The paper's mask and an ink's."""
    px, w, h = pixels(spark, sf_dir)
    p, c = _one_ink()
    return render.screen_plates(px, w, h, p, c, w, h, 72, "events").select("plate", "x", "y", "v")


@query(f"""WITH {sql.PX}, {_INK_DOTS}, m AS (SELECT ord, w, h, '<circle cx="' || {_num("cx")} || '" cy="' || {_num("cy")} || '" r="' || {_num("radius")} || '"/>' AS m FROM dots)
SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<svg xmlns="http://www.w3.org/2000/svg" width="' || any_value(w) || '" height="' || any_value(h) || '" viewBox="0 0 ' || any_value(w) || ' ' || any_value(h) || '" style="isolation: isolate">' || chr(10) || '<rect width="' || any_value(w) || '" height="' || any_value(h) || '" fill="#FFFFFF"/>' || chr(10)
 || '<g id="screen-0-C8283C" data-angle="0" fill="#C8283C" style="mix-blend-mode: multiply">' || chr(10) || string_agg(m, chr(10) ORDER BY ord) || chr(10) || '</g>' || chr(10) || '</svg>' || chr(10) AS svg, count(*) AS shapes, count(*) > 200000 AS busy FROM m""")
def ink_svg(spark, sf_dir):
    px, w, h = pixels(spark, sf_dir)
    p, c = _one_ink()
    made, cell = render.screen_dots(px, w, h, p, c, w, h, 72)
    made = made.withColumn("hex", color.to_hex(tuple(map(F.col, "rgb"))))
    return svg.document(made, "circle", cell, w, h, screens=True, paper="#FFFFFF").select("svg", "shapes", "busy")


for _name in palette.QUANTISERS:

    def _extracted(spark, sf_dir, method=_name):
        px, w, h = pixels(spark, sf_dir)
        return palette.extract(cells.opaque(px), w, h, 5, method)

    add(f"extract_{_name}", _extracted)


@query()
def png_round_trip(spark, sf_dir):
    """Pixels that differ after encoding and decoding: none."""
    px = images.events_image(spark, sf_dir)
    back = codecs.png_to_images(codecs.images_to_png(px))
    return px.exceptAll(back.select(*px.columns)).agg(F.count(F.lit(1)).alias("lost"))


# ---- records ----

_REC = "rec AS (SELECT 'HT-' || printf('%08X', user_id) AS render_id, event_id AS seq, ts AS updated_at, props AS payload FROM events)"


def _records(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.lit("HT-"), F.lpad(F.hex("user_id"), 8, "0"))
    return e.select(name.alias("render_id"), F.col("event_id").alias("seq"), F.col("ts").alias("updated_at"), F.col("props").alias("payload"))


@query(f"WITH {_REC}, l AS (SELECT *, row_number() OVER (PARTITION BY render_id ORDER BY updated_at DESC, seq DESC) AS k FROM rec) SELECT render_id, seq, payload FROM l WHERE k = 1 ORDER BY updated_at DESC, render_id LIMIT 400")
def record_upsert(spark, sf_dir):
    return records.upsert(_records(spark, sf_dir)).select("render_id", "seq", "payload")


@query(f"""WITH {_REC}, e AS (SELECT render_id, arg_min(payload, seq) AS p FROM rec WHERE seq % 7 = 0 GROUP BY 1), s AS (SELECT render_id, arg_max(payload, seq) AS p FROM rec WHERE seq % 5 = 0 GROUP BY 1), i AS (SELECT DISTINCT render_id FROM rec)
SELECT render_id, coalesce(e.p, s.p) AS payload, CASE WHEN e.p IS NOT NULL THEN 'embedded' WHEN s.p IS NOT NULL THEN 'sidecar' END AS origin FROM i LEFT JOIN e USING (render_id) LEFT JOIN s USING (render_id)""")
def record_load(spark, sf_dir):
    r = _records(spark, sf_dir)
    embedded = r.where("seq % 7 = 0").select("render_id", "payload", F.col("seq").alias("ord"))
    sidecar = r.where("seq % 5 = 0").groupBy("render_id").agg(F.max_by("payload", "seq").alias("payload"))
    return records.load(r.select("render_id").distinct(), embedded, sidecar)


_LAYERS = """layers AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 4 THEN NULL ELSE p_partkey // 4 END AS parent_id, p_partkey % 4 AS ord,
 CASE WHEN p_partkey < 500 THEN 'group' ELSE ['pixel', 'text', 'fill', 'gradient', 'adjustment'][p_size % 5 + 1] END AS kind, CASE WHEN p_size % 17 = 0 THEN 'HT-0000' || p_size ELSE p_name END AS name FROM part)"""
_WALK = f"""WITH RECURSIVE {_LAYERS}, walk AS (SELECT id, parent_id, kind, name, 0 AS depth, lpad(ord::VARCHAR, 8, '0') AS path, false AS inside FROM layers WHERE parent_id IS NULL
 UNION ALL SELECT c.id, c.parent_id, c.kind, c.name, w.depth + 1, w.path || '/' || lpad(c.ord::VARCHAR, 8, '0'), w.inside OR (w.kind = 'group' AND w.name LIKE 'HT-%') FROM layers c JOIN walk w ON c.parent_id = w.id)"""


def _layers(spark, sf_dir):
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("pixel", "text", "fill", "gradient", "adjustment")))
    kind = F.when(k < 500, "group").otherwise(F.element_at(kinds, F.col("p_size") % 5 + 1))
    name = F.when(F.col("p_size") % 17 == 0, F.concat(F.lit("HT-0000"), F.col("p_size"))).otherwise(F.col("p_name"))
    return p.select(k.alias("id"), F.when(k >= 4, F.floor(k / 4)).alias("parent_id"), (k % 4).alias("ord"), kind.alias("kind"), name.alias("name"))


@query(f"{_WALK} SELECT id, depth, path, inside FROM walk")
def layer_tree(spark, sf_dir):
    return records.tree(_layers(spark, sf_dir)).select("id", "depth", "path", "inside")


@query(f"{_WALK} SELECT id, name FROM walk WHERE kind <> 'group' AND NOT inside")
def layer_leaves(spark, sf_dir):
    return records.leaves(records.tree(_layers(spark, sf_dir))).select("id", "name")


@query(f"{_WALK} SELECT id, name FROM walk WHERE kind IN ('pixel', 'text') AND NOT inside AND name NOT LIKE 'HT-%'")
def batch_targets(spark, sf_dir):
    return records.batch_targets(records.tree(_layers(spark, sf_dir))).select("id", "name")


@query("""SELECT p_partkey AS id, greatest(8e0, least(400e0, p_retailprice - 900e0 + p_size * 9)) AS density, CASE WHEN p_type IN ('circle') THEN p_type ELSE 'circle' END AS shape,
 least(254, p_size * 6)::DOUBLE AS "blackPoint", CASE WHEN greatest(1e0, p_size * 4) <= least(254, p_size * 6) THEN least(254, p_size * 6) + 1 ELSE p_size * 4 END::DOUBLE AS "whitePoint" FROM part""")
def sanitize_params(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = lambda c: c.cast("string")
    raw = p.select(F.col("p_partkey").alias("id"), text(F.col("p_retailprice") - 900 + F.col("p_size") * 9).alias("density"), F.col("p_type").alias("shape"), text(F.col("p_size") * 6).alias("blackPoint"), text(F.col("p_size") * 4).alias("whitePoint"))
    return records.sanitize(raw)


@query("""SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
 CASE WHEN c_custkey % 10 = 0 THEN 'untitled' ELSE substr(trim(regexp_replace(c_name || '\\/:' || repeat(c_mktsegment, 9), '[\\\\/:*?"<>|]', '', 'g')), 1, 60) END AS file FROM customer""")
def names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.when(F.col("c_custkey") % 10 == 0, "???").otherwise(F.concat(F.col("c_name"), F.lit("\\/:"), F.repeat("c_mktsegment", F.lit(9))))
    return c.select(F.col("c_custkey").alias("id"), records.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"), records.safe_name(raw).alias("file"))


@query("SELECT event_id, base64(encode(props || 'é' || event_type)) AS code, props || 'é' || event_type AS text FROM events")
def text_codec(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = codecs.encode_text(F.concat(F.col("props"), F.lit("é"), F.col("event_type")))
    e = e.select("event_id", code.alias("code"))
    return e.withColumn("text", codecs.decode_text(F.concat(F.lit("!"), F.col("code"))))


@query("""WITH b AS (SELECT 'B' || i AS name, 'built-in' AS origin FROM range(1, 26) t(i)), u AS (SELECT DISTINCT replace(p_brand, 'Brand#', 'B') AS name, 'own' AS origin FROM part WHERE p_size > 40)
SELECT name, origin FROM b WHERE name NOT IN (SELECT name FROM u) UNION ALL SELECT * FROM u""")
def preset_list(spark, sf_dir):
    builtin = spark.range(1, 26).select(F.concat(F.lit("B"), F.col("id")).alias("name"), F.lit("built-in").alias("origin"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 40")
    return records.presets(builtin, p.select(F.replace("p_brand", F.lit("Brand#"), F.lit("B")).alias("name"), F.lit("own").alias("origin")).distinct())


# ---- bounds, previews, plates, windows ----


@query("""WITH b AS (SELECT p_partkey AS id, greatest(0, floor(p_size * 7.3e0 - 40e0)) AS l, greatest(0, floor(p_retailprice / 9e0 - 120e0)) AS t, least(200, ceil(p_size * 9.1e0 - 10e0)) AS r,
 least(150, ceil(p_retailprice / 7e0 - 110e0)) AS b, p_partkey % 11 = 0 AS bare FROM part), k AS (SELECT *, NOT bare AND r - l >= 1 AND b - t >= 1 AS ok FROM b)
SELECT id, CASE WHEN ok THEN l ELSE 0 END::BIGINT AS "left", CASE WHEN ok THEN t ELSE 0 END::BIGINT AS top, CASE WHEN ok THEN r ELSE 200 END::BIGINT AS "right", CASE WHEN ok THEN b ELSE 150 END::BIGINT AS bottom FROM k""")
def layer_bounds(spark, sf_dir):
    p, price = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_retailprice").cast("double")
    bare = lambda v: F.when(F.col("p_partkey") % 11 != 0, v)
    given = {"left": F.col("p_size") * 7.3 - 40, "top": price / 9 - 120, "right": F.col("p_size") * 9.1 - 10, "bottom": price / 7 - 110}
    return records.bounds(p.select(F.col("p_partkey").alias("id"), *(bare(v).alias(k) for k, v in given.items())), 200, 150)


@query(f"{_WALK} SELECT count(*) AS count, string_agg(name, ';' ORDER BY path) AS names FROM walk WHERE kind IN ('pixel', 'text') AND NOT inside AND name NOT LIKE 'HT-%'")
def scope_preview(spark, sf_dir):
    return records.preview(records.batch_targets(records.tree(_layers(spark, sf_dir)))).select("count", F.when(F.col("count") > 0, F.array_join("names", ";")).alias("names"))


_AT = "x >= 20 AND x < 50 AND y >= 10 AND y < 50"


@query(f"WITH {sql.PX} SELECT x - 20 AS x, y - 10 AS y, r, g, b, a FROM px WHERE {_AT}")
def source_crop(spark, sf_dir):
    px, *_ = pixels(spark, sf_dir)
    return images.crop(px, 20, 10, 30, 40).select("x", "y", *"rgba")


@query("SELECT p_partkey AS id, greatest(0.3e0, least(10e0, floor(floor(p_retailprice::DOUBLE / 100e0 / 0.25e0 + 0.5e0) * 0.25e0 * 1e6 + 0.5e0) / 1e6)) AS v FROM part")
def stepped_values(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), stepped(F.col("p_retailprice").cast("double") / 100, 0.25, 0.3, 10).alias("v"))


@query(f"WITH {sql.PX}, {_INK_DOTS}, {_CIRCLE}, k AS ({_SCREEN}) SELECT px.x, px.y, (255 - coalesce(k.v, 0))::BIGINT AS r, 255::BIGINT AS a, 1 AS place FROM px LEFT JOIN k USING (x, y)")
def plate_pictures(spark, sf_dir):
    """An ink's plate, black on white."""
    px, w, h = pixels(spark, sf_dir)
    p, c = _one_ink()
    masks = render.screen_plates(px, w, h, p, c, w, h, 72, "events")
    found = raster.plate_pictures(masks, images.blank(spark, w, h), 2, c.paper)
    return found.select("x", "y", "r", "a", raster.plate_order(F.col("plate"), c.paper).alias("place"))


@query(f"WITH {sql.PX} SELECT avg(CASE WHEN a > 0 THEN 1e0 ELSE 0e0 END) AS share FROM px")
def survivor_share(spark, sf_dir):
    px, *_ = pixels(spark, sf_dir)
    return raster.survivors(px).select("share")
