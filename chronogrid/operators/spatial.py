"""Grid operators: convolution lag, quadtree lag and adaptive-grid lag."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import GRID_STRIDE, Grid, Panel
from . import lattice
from .weighted import onto, weighted_sum


def kernel(inner: int = 1, width: int = 1, power: float = 0.0, norm: bool = False) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of a square kernel that leaves out the cells nearer than `inner` on both axes.

    A weight is r ** -power (a country lag has + power).
    """
    inner, width = int(inner), int(width)
    if inner == 0 and power > 0:
        raise ValueError("the centre's weight is infinite for kernel_inner 0 and a positive power")
    reach = inner + width - 1
    cells = [(x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) if abs(x) >= inner or abs(y) >= inner]
    weights = [math.hypot(x, y) ** -power if power else 1.0 for x, y in cells]
    total = sum(weights) if norm else 1.0
    return [(x, y, w / total) for (x, y), w in zip(cells, weights, strict=True)]


def grid_convolution(panel: Panel, kernel_inner: int = 1, kernel_width: int = 1, kernel_power: float = 0.0, norm_kernel: bool = False) -> Panel:
    """Weighted sum of the cells around each cell; missing and absent cells are 0, and edges stay edges.

    Each row is expanded by the kernel on the map side; sums are partial before the one shuffle.
    """
    panel = panel.filled()
    unit = F.col(panel.unit)
    offsets = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(w).alias("weight")) for x, y, w in kernel(kernel_inner, kernel_width, kernel_power, norm_kernel)))
    spread = panel.df.select(panel.time, panel.unit, *panel.features, F.explode(offsets).alias("o"))
    x = unit % GRID_STRIDE + F.col("o.dx")
    spread = spread.where((x >= 0) & (x < GRID_STRIDE)).withColumn(panel.unit, (unit + F.col("o.dx") + F.col("o.dy") * GRID_STRIDE).cast(panel.df.schema[panel.unit].dataType))
    return onto(panel, weighted_sum(spread, [panel.time, panel.unit], panel.features, F.col("o.weight")))


DISTANCE_WEIGHTS: dict[int, Callable[[Column], Column]] = {
    0: lambda d: 1 / F.log(1 + d),
    1: lambda d: 1 / d,
    2: lambda d: 1 / d / d,
}


#: The same of arrays.
ARRAY_WEIGHTS: dict[int, Callable[[np.ndarray], np.ndarray]] = {
    0: lambda d: 1 / np.log(1 + d),
    1: DISTANCE_WEIGHTS[1],
    2: DISTANCE_WEIGHTS[2],
}

#: Cells that walk the tree at once.
WALKED = 1 << 16

#: Up to here a node that is split has only ancestors that are split: their sides double, their distances grow less.
STEADY = 1.4


def _walk(cx: np.ndarray, cy: np.ndarray, sums: list[tuple[int, int, np.ndarray]], here: list[tuple[int, int, np.ndarray]], thetacrit: float, weight: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Each cell's lag, level by level: open (cell, node) pairs are taken or replaced by the node's children."""
    power, lag = len(sums) - 1, np.zeros(len(cx))
    row, nx, ny = np.arange(len(cx)), np.zeros(len(cx), np.int64), np.zeros(len(cx), np.int64)
    for level in range(power + 1):
        h = 2.0 ** (power - level)
        d = np.sqrt((cx[row] + 0.5 - (nx + 0.5) * h + 0.01) ** 2 + (cy[row] + 0.5 - (ny + 0.5) * h + 0.01) ** 2)
        split = h / d > thetacrit
        taken = ~split
        if level == power:
            taken |= (cx[row] != nx) | (cy[row] != ny)
        x0, y0, m = sums[level]
        lag += np.bincount(row[taken], weight(d[taken]) * m[nx[taken] - x0, ny[taken] - y0], len(cx))
        if level < power:
            row, nx, ny = (np.repeat(v[split], 4) for v in (row, nx, ny))
            nx, ny = 2 * nx + np.tile([0, 0, 1, 1], len(nx) // 4), 2 * ny + np.tile([0, 1, 0, 1], len(ny) // 4)
            x0, y0, m = here[level + 1]
            i, j = nx - x0, ny - y0
            there = (i >= 0) & (i < m.shape[0]) & (j >= 0) & (j < m.shape[1])
            there[there] = m[i[there], j[there]] > 0
            row, nx, ny = row[there], nx[there], ny[there]
    return lag


def quadtree_lag(panel: Panel, thetacrit: float, dfunction_option: int) -> Panel:
    """Barnes-Hut sum over a quadtree: far nodes are taken whole. Missing is 0.

    Distance weights: 0 is 1 / ln(1 + d), 1 is 1 / d, 2 is 1 / d**2.

    A cell takes a node if its parent is split and it is not.  Which offsets of cell and node that holds for
    depends only on where the node stands in its parent, so a level's sum is four convolutions, whatever the
    number of nodes that a cell takes.  Beyond STEADY, where a cell takes few nodes, it walks the tree.  A task
    holds one time's map, inside the box of its cells.
    """
    if dfunction_option not in DISTANCE_WEIGHTS:
        raise ValueError(f"dfunction_option is 0, 1 or 2, not {dfunction_option}")
    panel = panel.filled()
    grid = Grid.of(panel)
    power, time_key, unit_key, features, weight = grid.power, panel.time, panel.unit, panel.features, ARRAY_WEIGHTS[dfunction_option]
    spectra = lattice.Cache()

    def kernel_spectrum(at: lattice.Lattice, level: int, odd: tuple[int, int]) -> np.ndarray | None:
        """Of the weights that cells take nodes with which stand so in their parents, None if none are taken."""
        h, (ox, oy) = at.h, at.offsets()
        d = at.distance(0.01)
        taken = h / d <= thetacrit
        if level == power:
            taken |= (ox != 0) | (oy != 0)
        if level:
            px, py = (o + i * h + 0.5 - h + 0.01 for o, i in zip((ox, oy), odd, strict=True))
            taken &= 2 * h / np.sqrt(px**2 + py**2) > thetacrit
        return at.spectrum(np.where(taken, weight(d), 0.0)) if taken.any() else None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        box = lattice.box_of(x, y)
        out = rows[[time_key, unit_key]].copy()
        for f in features:
            lag = np.zeros(len(rows))
            sums = lattice.pyramid(x, y, rows[f].to_numpy(float), power)
            if thetacrit > STEADY:
                here = lattice.pyramid(x, y, np.ones(len(x)), power)
                for lo in range(0, len(x), WALKED):
                    part = slice(lo, lo + WALKED)
                    lag[part] = _walk(x[part], y[part], sums, here, thetacrit, weight)
                out[f] = lag
                continue
            for level, (x0, y0, m) in enumerate(sums):
                at, total = lattice.Lattice(box, 2 ** (power - level)), None
                for odd in ((0, 0), (0, 1), (1, 0), (1, 1)) if level else ((0, 0),):
                    source = np.zeros_like(m)
                    own = (slice((odd[0] - x0) % 2, None, 2), slice((odd[1] - y0) % 2, None, 2)) if level else ...
                    source[own] = m[own]
                    if not source.any():
                        continue
                    spectrum = spectra.get((box, level, odd), lambda: kernel_spectrum(at, level, odd))  # noqa: B023
                    if spectrum is not None:
                        part = at.transformed(source) * spectrum
                        total = part if total is None else total + part
                if total is not None:
                    lag += at.at(total, x, y)
            out[f] = lag
        return out

    unit = F.col(unit_key)
    schema = ", ".join(f"`{c}` {panel.df.schema[c].dataType.simpleString()}" for c in (time_key, unit_key)) + "".join(f", `{f}` double" for f in features)
    cells = panel.df.select(time_key, unit, grid.x(unit).alias("x"), grid.y(unit).alias("y"), *features)
    return onto(panel, cells.groupBy(time_key).applyInPandas(solve, schema))


def adaptive_grids(panel: Panel, grid: Grid, threshold: float) -> DataFrame:
    """time, feature, level, nx, ny, value of each time's adaptive grid."""
    time_key, features, power = panel.time, panel.features, grid.power
    unit = F.col(panel.unit)

    def cover(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f in features:
            for level, nx, ny, value in lattice.adaptive_nodes(rows["x"].to_numpy(), rows["y"].to_numpy(), rows[f].to_numpy(float), power, threshold):
                out.append(pd.DataFrame({time_key: rows[time_key].iloc[0], "feature": f, "level": level, "nx": nx, "ny": ny, "value": value}))
        return pd.concat(out)

    kind = panel.df.schema[panel.time].dataType.simpleString()
    cells = panel.df.select(panel.time, grid.x(unit).alias("x"), grid.y(unit).alias("y"), *features)
    return cells.groupBy(panel.time).applyInPandas(cover, f"`{panel.time}` {kind}, feature string, level int, nx int, ny int, value double")


def _array_weight(panel: Panel, grid: Grid, weight: Callable[[Column], Column]) -> Callable[[np.ndarray], np.ndarray]:
    """The function on arrays of distances: itself if it is plain arithmetic, else looked up in a table by Spark.

    The table holds the distances of the levels' lattices, a few for each cell of the map, and goes to all tasks.
    """
    probe = np.array([1.0, 2.0])
    try:
        plain = np.shape(np.asarray(weight(probe), float)) in ((), probe.shape)
    except Exception:  # noqa: BLE001 (Spark's functions refuse arrays in several ways)
        plain = False
    if plain:
        return weight
    far = np.zeros(0)
    for level in range(grid.power + 1):
        d = lattice.Lattice(grid.box(panel), 2 ** (grid.power - level)).distance()
        far = np.union1d(far, d[d > 0])
    rows = panel.df.sparkSession.createDataFrame(pa.table({"d": far})).select("d", weight(F.col("d")).cast("double").alias("w")).toArrow()
    known, weights = (rows.column(c).to_numpy() for c in ("d", "w"))
    order = np.argsort(known)
    table = panel.df.sparkSession.sparkContext.broadcast((known[order], weights[order]))
    return lambda d: table.value[1][np.searchsorted(table.value[0], d)]


def adaptive_grid_lag(
    panel: Panel,
    threshold: float = 10000,
    dfunctions: dict[str, Callable[[Column], Column]] | None = None,
    split_criterion: str = "min",
    keep_grids: bool = False,
) -> Panel | tuple[Panel, DataFrame]:
    """Sum of value * weight(distance) over each time's adaptive grid, a cell's own leaf left out.

    Features must be present everywhere. `dfunctions` holds one Column to Column function of the distance.
    With keep_grids also (time, feature, level, nx, ny, value) of the grids.

    Nodes of one level stand on a regular lattice, so a level's sum is a convolution: a time's cost is that of a
    few transforms of its map for each level, whatever its number of nodes.  A task holds one time's map, inside
    the box of its cells and not the square around them; the driver holds none.  The plan shuffles the cells
    once, by time, and joins nothing but the result to its rows.
    """
    if split_criterion != "min":
        raise ValueError(f"split_criterion is 'min', not {split_criterion!r}")
    dfunctions = dfunctions or {"d_1": DISTANCE_WEIGHTS[1]}
    if len(dfunctions) != 1:
        raise ValueError("one distance function is needed")
    weight = next(iter(dfunctions.values()))
    grid = Grid.of(panel)
    power, time_key, unit_key, features = grid.power, panel.time, panel.unit, panel.features
    weight = _array_weight(panel, grid, weight)
    unit = F.col(panel.unit)
    spectra = lattice.Cache()

    def kernel_spectrum(at: lattice.Lattice) -> np.ndarray:
        d = at.distance()
        own = d == 0
        w = np.where(own, 0.0, weight(np.where(own, d.max() or 1.0, d)))
        return at.spectrum(w)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        box = lattice.box_of(x, y)
        out = rows[[time_key, unit_key]].copy()
        for f in features:
            lag = np.zeros(len(rows))
            for level, nx, ny, value in lattice.adaptive_nodes(x, y, rows[f].to_numpy(float), power, threshold):
                if not value.any():
                    continue
                at = lattice.Lattice(box, 2 ** (power - level))
                source = np.zeros((at.x.count, at.y.count))
                source[nx - at.x.first, ny - at.y.first] = value
                lag += at.at(at.transformed(source) * spectra.get((box, level), lambda: kernel_spectrum(at)), x, y)  # noqa: B023
            out[f] = lag
        return out

    schema = ", ".join(f"`{c}` {panel.df.schema[c].dataType.simpleString()}" for c in (panel.time, panel.unit)) + "".join(f", `{f}` double" for f in features)
    cells = panel.df.select(panel.time, unit, grid.x(unit).alias("x"), grid.y(unit).alias("y"), *features)
    out = onto(panel, cells.groupBy(panel.time).applyInPandas(solve, schema))
    return (out, adaptive_grids(panel, grid, threshold)) if keep_grids else out
