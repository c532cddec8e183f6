"""Fragments of DuckDB SQL for the oracle statements, written independently of the Column functions."""

from __future__ import annotations

PX = """px AS (SELECT event_id % 100 AS x, event_id // 100 AS y, floor(value * 7)::BIGINT % 256 AS r, user_id * 37 % 256 AS g,
  event_id * 11 % 256 AS b, CASE WHEN event_type = 'error' THEN 0 ELSE 255 END AS a FROM events),
dim AS (SELECT 100 AS w, max(y) + 1 AS h FROM px)"""


def lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"


def unlin(v: str) -> str:
    return f"(CASE WHEN {v} <= 0 THEN 0e0 WHEN {v} >= 1 THEN 1e0 WHEN {v} <= 0.0031308e0 THEN {v} * 12.92e0 ELSE 1.055e0 * pow({v}, 1e0 / 2.4e0) - 0.055e0 END)"


def luma709(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(({r} * 0.2126e0 + {g} * 0.7152e0 + {b} * 0.0722e0) / 255e0)"


def clamp01(v: str) -> str:
    return f"greatest(0e0, least(1e0, {v}))"


def byte(v: str) -> str:
    return f"round_even(greatest(0e0, least(255e0, {v})), 0)::BIGINT"


def lms(table: str) -> str:
    """Adds lr, lg, lb and then l_, m_, s_ to a table with r, g, b."""
    return f"""(SELECT *, cbrt(0.4122214708e0 * lr + 0.5363325363e0 * lg + 0.0514459929e0 * lb) AS l_,
      cbrt(0.2119034982e0 * lr + 0.6806995451e0 * lg + 0.1073969566e0 * lb) AS m_,
      cbrt(0.0883024619e0 * lr + 0.2817188376e0 * lg + 0.6299787005e0 * lb) AS s_
    FROM (SELECT *, {lin("r")} AS lr, {lin("g")} AS lg, {lin("b")} AS lb FROM {table}))"""


def with_lab(table: str) -> str:
    """Adds okl, oka, okb."""
    return f"""(SELECT * EXCLUDE (lr, lg, lb, l_, m_, s_), 0.2104542553e0 * l_ + 0.793617785e0 * m_ - 0.0040720468e0 * s_ AS okl,
      1.9779984951e0 * l_ - 2.428592205e0 * m_ + 0.4505937099e0 * s_ AS oka,
      0.0259040371e0 * l_ + 0.7827717662e0 * m_ - 0.808675766e0 * s_ AS okb FROM {lms(table)})"""


def from_lab(table: str) -> str:
    """From okl, oka, okb: adds nr, ng, nb (bytes)."""
    put = lambda e: f"floor({unlin(f'({e})')} * 255e0 + 0.5e0)::BIGINT"
    return f"""(SELECT *, {put("4.0767416621e0 * q1 - 3.3077115913e0 * q2 + 0.2309699292e0 * q3")} AS nr,
      {put("-1.2684380046e0 * q1 + 2.6097574011e0 * q2 - 0.3413193965e0 * q3")} AS ng,
      {put("-0.0041960863e0 * q1 - 0.7034186147e0 * q2 + 1.707614701e0 * q3")} AS nb
    FROM (SELECT *, pow(okl + 0.3963377774e0 * oka + 0.2158037573e0 * okb, 3) AS q1, pow(okl - 0.1055613458e0 * oka - 0.0638541728e0 * okb, 3) AS q2,
      pow(okl - 0.0894841775e0 * oka - 1.291485548e0 * okb, 3) AS q3 FROM {table}))"""


def pal(entries: list[tuple[int, int, int]], name: str = "pal") -> str:
    rows = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(entries))
    return f"{name}0(idx, r, g, b) AS (VALUES {rows}), {name} AS (SELECT * FROM {with_lab(f'{name}0')})"


def nearest(table: str, palette: str = "pal", keys: str = "x, y", where: str = "true") -> str:
    """One row for each key with the nearest entry's idx."""
    return f"""(SELECT {keys}, arg_min(idx, struct_pack(d := d, i := idx)) AS idx FROM (
      SELECT t.*, p.idx, (t.okl - p.okl) ** 2 + (t.oka - p.oka) ** 2 + (t.okb - p.okb) ** 2 AS d FROM {with_lab(table)} t, {palette} p WHERE {where})
    GROUP BY {keys})"""


def hash01(x: str, y: str, seed: int, salt: int) -> str:
    base = f"(({x})::HUGEINT * 374761393 + ({y})::HUGEINT * 668265263 + {seed * 2246822519 + salt * 3266489917}) % 4294967296"
    one = f"(xor(({base})::BIGINT, (({base})::BIGINT >> 13)))"
    two = f"((({one})::HUGEINT * 1274126177) % 4294967296)::BIGINT"
    return f"(xor({two}, {two} >> 16) / 4294967296e0)"


def grid(density: float, name: str = "grid") -> str:
    """An upright grid (no angle): cell, cols, rows, left, top."""
    return f"""{name} AS (SELECT *, -cols * cell / 2 AS gl, -nrows * cell / 2 AS gt FROM (
      SELECT *, greatest(1, ceil(w / cell - 1e-9))::BIGINT AS cols, greatest(1, ceil(h / cell - 1e-9))::BIGINT AS nrows FROM (
        SELECT w, h, greatest(1.2e0, greatest(w, h) / {float(density)}e0) AS cell FROM dim)))"""


def in_cells(extra: str = "") -> str:
    return f"""cp AS (SELECT px.*, greatest(0, least(cols - 1, trunc((x + 0.5e0 - w / 2e0 - gl) / cell)))::BIGINT AS col,
      greatest(0, least(nrows - 1, trunc((y + 0.5e0 - h / 2e0 - gt) / cell)))::BIGINT AS row, cell, cols, nrows, gl, gt, w, h{extra} FROM px, grid WHERE a >= 8)"""


CELLS = f"""cells AS (SELECT row, col, count(*) AS n, sum({luma709()}) AS lum_sum, sum(r)::BIGINT AS r_sum, sum(g)::BIGINT AS g_sum, sum(b)::BIGINT AS b_sum,
   any_value(cell) AS cell, any_value(cols) AS cols, any_value(gl) AS gl, any_value(gt) AS gt, any_value(w) AS w, any_value(h) AS h FROM cp GROUP BY row, col)"""


def lut(values: list[float], name: str = "lut") -> str:
    return f"{name}(i, v) AS (VALUES {', '.join(f'({i}, {v!r}e0)' if 'e' not in repr(v) else f'({i}, {v!r})' for i, v in enumerate(values))})"


def box(table: str, cols: list[str], axis: str, other: str, n: str, r: int) -> str:
    """One box pass as a subquery; n: SQL for the number of pixels along the axis."""
    one = lambda c: f"""(sum({c}::DOUBLE) OVER f + greatest(0, {r} - {axis}) * first_value({c}::DOUBLE) OVER u + greatest(0, {axis} - ({n} - 1 - {r})) * last_value({c}::DOUBLE) OVER u) / {2 * r + 1}e0"""
    return f"""(SELECT * REPLACE ({", ".join(f"{one(c)} AS {c}" for c in cols)}) FROM {table} WINDOW f AS (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING),
      u AS (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def gaussian(table: str, radii: list[int], cols: list[str]) -> str:
    """Three passes each way, in turn."""
    for r in radii:
        table = box(table, cols, "x", "y", "100", r)
        table = box(table, cols, "y", "x", "(SELECT h FROM dim)", r)
    return f"(SELECT * REPLACE ({', '.join(f'{byte(c)} AS {c}' for c in cols)}) FROM {table})"
