"""Positional hashes, jitter, screen angles, dot shapes and coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 1 << 32
# Fixed values of the positional hash, and the classic screen angles.
HASH_X, HASH_Y, HASH_SEED, HASH_SALT, HASH_MIX = 374761393, 668265263, 2246822519, 3266489917, 1274126177
ANGLES = (45, 15, 75, 0, 30, 60, 22.5, 67.5, 52.5)


def hash01(x: Column, y: Column, seed: int, salt: int) -> Column:
    """0 <= h < 1, in 64-bit integers."""
    h = F.pmod(x.cast("long") * HASH_X + y.cast("long") * HASH_Y + F.lit(seed * HASH_SEED + salt * HASH_SALT), F.lit(U32))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = F.pmod(h * HASH_MIX, F.lit(U32))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    return h.cast("double") / float(U32)


def hash01_py(x: int, y: int, seed: int, salt: int) -> float:
    h = (x * HASH_X + y * HASH_Y + seed * HASH_SEED + salt * HASH_SALT) % U32
    h = (h ^ h >> 13) * HASH_MIX % U32
    return (h ^ h >> 16) / U32


def signed(x: Column, y: Column, seed: int, salt: int) -> Column:
    return hash01(x, y, seed, salt) * 2 - 1


def dot_jitter(col: Column, row: Column, cell: float, position: float = 0, size: float = 0, angle: float = 0, seed: int = 1) -> tuple[Column, Column, Column, Column]:
    """dx, dy, factor of the radius, rotation in radians."""
    zero, amp = F.lit(0.0), position / 100 * cell * 0.5
    dx, dy = (signed(col, row, seed, k) * amp if position > 0 else zero for k in (1, 2))
    factor = F.greatest(F.lit(0.05), 1 + signed(col, row, seed, 3) * (size / 100)) if size > 0 else F.lit(1.0)
    return dx, dy, factor, signed(col, row, seed, 4) * (angle * math.pi / 180) if angle > 0 else zero


def ink_offset(rank: int, amount: float, cell: float, seed: int) -> tuple[float, float]:
    """How far a plate slips: a random direction and distance by the screen's rank."""
    if amount <= 0:
        return 0.0, 0.0
    turn = hash01_py(rank, 0, seed, 11) * math.pi * 2
    far = (0.35 + 0.65 * hash01_py(rank, 0, seed, 12)) * amount / 100 * cell
    return math.cos(turn) * far, math.sin(turn) * far


def screen_angles(count: int, base: float = 0, spread: float = 1) -> list[float]:
    s = min(1.0, max(0.0, spread))
    return [math.fmod(base + ANGLES[0] + (ANGLES[i % len(ANGLES)] - ANGLES[0]) * s, 180) for i in range(count)]


def _box(x: Column, y: Column, half_w: float | Column, half_h: float | Column) -> Column:
    dx, dy = F.abs(x) - half_w, F.abs(y) - half_h
    zero = F.lit(0.0)
    return F.hypot(F.greatest(dx, zero), F.greatest(dy, zero)) + F.least(F.greatest(dx, dy), zero)


def _ellipse(x: Column, y: Column, r: Column, cell: float) -> Column:
    a, b, k = r * math.sqrt(1.3), r / math.sqrt(1.3), math.sqrt(0.5)
    u, v = (x + y) * k, (y - x) * k
    near, slope = F.hypot(u / a, v / b), F.hypot(u / (a * a), v / (b * b))
    return F.when(near < 1e-6, -F.least(a, b)).otherwise(near * (near - 1) / F.when(slope == 0, 1.0).otherwise(slope))


def _line(x: Column, y: Column, r: Column, cell: float) -> Column:
    half = cell / 2 + 0.5
    return _box(x, y, F.lit(half), math.pi * r * r / (4 * half))


SQUARE, DIAMOND, ARM, THICK = 0.886226925452758, 1.2533141373155003, 1.35, 0.42
#: Signed distance of a point from a dot of radius r at the origin, by shape.
SHAPES = {
    "circle": lambda x, y, r, cell: F.hypot(x, y) - r,
    "ellipse": _ellipse,
    "square": lambda x, y, r, cell: F.greatest(F.abs(x), F.abs(y)) - r * SQUARE,
    "diamond": lambda x, y, r, cell: (F.abs(x) + F.abs(y) - r * DIAMOND) / math.sqrt(2),
    "cross": lambda x, y, r, cell: F.least(_box(x, y, r * ARM, r * THICK), _box(x, y, r * THICK, r * ARM)),
    "line": _line,
}


def shape(name: str):
    return SHAPES.get(name, SHAPES["circle"])


def area(name: str, r: Column) -> Column:
    if name == "cross":
        return r * r * (2 * (2 * ARM) * (2 * THICK) - (2 * THICK) ** 2)
    return r * r * math.pi


def extent(name: str, r: Column, cell: float) -> Column:
    """How far from its centre a dot can reach."""
    far = {"ellipse": r * math.sqrt(1.3) + 1, "square": r * SQUARE * math.sqrt(2) + 1, "diamond": r * DIAMOND + 1, "cross": r * math.hypot(ARM, THICK) + 1}
    if name == "line":
        half = cell / 2 + 0.5
        return F.hypot(F.lit(half), math.pi * r * r / (4 * half)) + 1
    return far.get(name, r)


def coverage(d: Column) -> Column:
    return F.when(d >= 0.5, 0.0).when(d <= -0.5, 1.0).otherwise(0.5 - d)
