"""Threshold matrices (values within 0..1), made at plan time: lists of rows."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from .kernels import KERNELS


def bayer(n: int) -> np.ndarray:
    """2**n a side; the order interleaves the bits of x ^ y and y."""
    size = 1 << n
    y, x = np.mgrid[0:size, 0:size]
    rank = np.zeros((size, size), int)
    for bit in range(n):
        rank += (((x ^ y) >> bit & 1) * 2 + (y >> bit & 1)) << 2 * (n - 1 - bit)
    return (rank + 0.5) / size**2


def clustered(size: int, angled: bool = False) -> np.ndarray:
    """Ranks by toroidal distance from the centre, ties by (7x + 13y) % n."""
    n, c = size * size, (size - 1) / 2
    y, x = np.mgrid[0:size, 0:size]
    dx, dy = (np.minimum(abs(v - c), size - abs(v - c)) for v in (x, y))
    d = dx + dy if angled else np.sqrt(dx * dx + dy * dy)
    order = np.lexsort((((x * 7 + y * 13) % n).ravel(), d.ravel()))
    out = np.empty(n)
    out[order] = (np.arange(n) + 0.5) / n
    return out.reshape(size, size)


def lines(size: int, direction: str) -> np.ndarray:
    y, x = np.mgrid[0:size, 0:size]
    t = y if direction == "horizontal" else x if direction == "vertical" else (x + y) % size
    return (t + 0.5) / size


#: Seed, multiplier, increment and divisor of the white noise (fixed values).
WHITE = (0x9E3779B9, 1664525, 1013904223, 0xFFFFFF)


@cache
def white_noise(size: int = 32) -> np.ndarray:
    """Thresholds from a linear congruential sequence modulo 2^32, in single precision."""
    state, factor, step, most = WHITE
    high = []
    for _ in range(size * size):
        state = (state * factor + step) % (1 << 32)
        high.append(state >> 8)
    return (np.array(high) / most).astype(np.float32).astype(np.float64).reshape(size, size)


#: Seed, multiplier, increment and greatest value of the scatter that blue noise starts from (fixed values).
BLUE = (0x2F6E2B1, 1103515245, 12345, 0x7FFFFFFF)


def _scatter(n: int, points: int) -> np.ndarray:
    """Which of n places the first `points` different ones of a congruential sequence are. Its products are rounded to
    doubles before the modulo, as the fixed values presume."""
    state, factor, step, most = BLUE
    on = np.zeros(n, bool)
    while points:
        state = int(float(state) * factor + step) & most
        at = math.floor(state / most * n)
        points -= not on[at]
        on[at] = True
    return on


@cache
def blue_noise(size: int = 64, sigma: float = 1.5, reach: int = 7) -> np.ndarray:
    """Void and cluster: ranks points so that each level is evenly spread. Energies are kept in single precision."""
    n = size * size
    reach = min(reach, size // 2)
    offsets = np.arange(-reach, reach + 1)
    weight = np.exp(-(offsets[:, None] ** 2 + offsets[None, :] ** 2) / (2 * sigma * sigma))

    def spread(field: np.ndarray, at: int, sign: float) -> None:
        y, x = divmod(at, size)
        field[np.ix_((y + offsets) % size, (x + offsets) % size)] += sign * weight

    def energy(points: np.ndarray) -> np.ndarray:
        field = np.zeros((size, size), np.float32)
        for at in np.flatnonzero(points):
            spread(field, int(at), 1)
        return field

    on = _scatter(n, max(1, math.floor(n * 0.1 + 0.5)))
    field = energy(on)
    tight = lambda: int(np.where(on, field.ravel(), -np.inf).argmax())
    void = lambda: int(np.where(on, np.inf, field.ravel()).argmin())
    for _ in range(4 * n):
        a = tight()
        on[a] = False
        spread(field, a, -1)
        b = void()
        on[b] = True
        spread(field, b, 1)
        if a == b:
            break
    rank, start = np.zeros(n, int), on.copy()
    for k in range(int(on.sum()) - 1, -1, -1):
        a = tight()
        rank[a], on[a] = k, False
        spread(field, a, -1)
    on, field = start.copy(), energy(start)
    for k in range(int(start.sum()), n):
        b = void()
        rank[b], on[b] = k, True
        spread(field, b, 1)
    return ((rank + 0.5) / n).reshape(size, size)


#: The algorithms: a threshold matrix (None: nearest colour only) or an error-diffusion kernel.
ORDERED = {
    "threshold": lambda: np.full((1, 1), 0.5),
    "bayer2": lambda: bayer(1), "bayer4": lambda: bayer(2), "bayer8": lambda: bayer(3), "bayer16": lambda: bayer(4),
    "cluster4": lambda: clustered(4), "cluster6": lambda: clustered(6), "cluster8": lambda: clustered(8), "cluster45": lambda: clustered(8, True),
    "lineh": lambda: lines(8, "horizontal"), "linev": lambda: lines(8, "vertical"), "linediag": lambda: lines(8, "diagonal"),
    "bluenoise": blue_noise, "whitenoise": white_noise,
}
ALGORITHMS = (*ORDERED, *KERNELS)


def algorithm(name: str) -> str:
    return name if name in ALGORITHMS else "floydsteinberg"
