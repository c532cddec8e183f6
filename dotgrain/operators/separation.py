"""Ink separation: coverages of a few inks whose densities add up to a colour's, by a non-negative lasso."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, tone
from .cells import Grid, aggregate, edge_aware
from .palette import Palette

LAMBDA, ROUNDS = 0.015, 60


def density(rgb: np.ndarray) -> np.ndarray:
    v = np.floor(np.clip(rgb, 0, 255) + 0.5) / 255
    linear = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    return -np.log10(np.maximum(0.004, linear))


def basis(inks: Palette, paper: tuple[int, int, int]) -> np.ndarray:
    """One column an ink: its density over the paper's."""
    return (density(np.array(inks, float)) - density(np.array(paper, float))).T


def unmix(rgb: np.ndarray, inks: Palette, paper: tuple[int, int, int]) -> np.ndarray:
    """Coverages from 0 to 1, a row a colour: FISTA on all colours at once; a row rests when it moves no more."""
    a = basis(inks, paper)
    b = density(rgb) - density(np.array(paper, float))
    step = float(np.linalg.eigvalsh(a.T @ a).max()) if len(inks) else 0.0
    x = np.zeros((len(rgb), len(inks)))
    if step <= 1e-9:
        return x
    y, t, going = x.copy(), 1.0, np.ones(len(rgb), bool)
    for k in range(ROUNDS):
        new = np.clip(y - (y @ a.T - b) @ a / step - LAMBDA, 0, 1)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        move = new - x
        x[going] = new[going]
        y[going] = (new + (t - 1) / after * move)[going]
        t = after
        if k > 8:
            going &= np.abs(move).max(1) >= 5e-5
            if not going.any():
                break
    return x


def means(cells: DataFrame, lut: list[float] | None = None, invert: bool = False) -> DataFrame:
    """cells (r_sum, g_sum, b_sum, n) with r, g, b: each channel's mean, unrounded; graded by a table, then inverted."""
    mean = {c: F.col(f"{c}_sum") / F.col("n") for c in "rgb"}
    if lut is not None:
        mean = {c: tone.sample_lut(lut, v / 255.0) * 255.0 for c, v in mean.items()}
    return cells.withColumns({c: (255.0 - v if invert else v).cast("double") for c, v in mean.items()})


def coverages(cells: DataFrame, inks: Palette, paper: tuple[int, int, int]) -> DataFrame:
    """cells (r, g, b) with cov, one coverage an ink."""

    def run(batches):
        for batch in batches:
            cov = unmix(np.column_stack([np.asarray(batch.column(c)) for c in "rgb"]), inks, paper)
            starts = np.arange(len(cov) + 1, dtype=np.int32) * len(inks)
            made = pa.ListArray.from_arrays(pa.array(starts), pa.array(cov.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "cov"])

    return cells.mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in cells.dtypes), "cov array<double>"]))


def each_screen(
    px: DataFrame, w: int, h: int, inks: Palette, paper: tuple[int, int, int], density_: float, base: float = 0, spread: float = 1, bias: float = 0,
    *, lut: list[float] | None = None, invert: bool = False, edge: bool = False, mode: str = "luma709",
) -> list[DataFrame]:
    """For each ink image_id, screen, row, col, cov, n over a grid at its own angle. Cells are graded, not pixels; equal
    angles share their cells."""
    angles = [round(a, 4) for a in geometry.screen_angles(len(inks), base, spread)]
    made = {}
    for angle in dict.fromkeys(angles):
        grid = Grid.make(w, h, density_, angle)
        found = edge_aware(px, grid, 1, mode) if edge else aggregate(px, grid, mode)
        made[angle] = coverages(means(found, lut, invert), inks, paper)
    out = []
    for rank, angle in enumerate(angles):
        cov = tone.bias(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cov")[rank])), bias)
        out.append(made[angle].select("image_id", F.lit(rank).alias("screen"), "row", "col", cov.alias("cov"), "n"))
    return out


def screens(px: DataFrame, w: int, h: int, inks: Palette, paper: tuple[int, int, int], density_: float, *args, **more) -> DataFrame:
    """All of each_screen in one frame."""
    return reduce(DataFrame.unionByName, each_screen(px, w, h, inks, paper, density_, *args, **more))
