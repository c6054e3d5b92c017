"""Spacetime nearest events: each cell's distance to, or weight of, the nearest past events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..panel import GRID_STRIDE, Panel
from .weighted import onto

DEGREES, NONE = 0.5, 999.0
#: Rows of a tile, tiles of a group of targets, and event tiles that a group tries first.
TILE, GROUP, TRIED = 64, 64, 256


def nearest(targets: np.ndarray, events: np.ndarray, k: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Distances and row numbers of the k nearest events of each target; inf and -1 where there are fewer.

    Of equally near events the first comes first.
    """
    n, m = len(targets), len(events)
    far, which = np.full((n, k), np.inf), np.full((n, k), -1)
    for lo in range(0, n, step := max(1, block // max(1, m))):
        part = targets[lo : lo + step]
        square = sum((part[:, None, i] - events[None, :, i]) ** 2 for i in range(events.shape[1]))
        row = np.arange(len(part))
        for j in range(min(k, m)):
            at = square.argmin(1)
            far[lo : lo + step, j], which[lo : lo + step, j] = np.sqrt(square[row, at]), at
            square[row, at] = np.inf
    return far, which


def _curve(points: np.ndarray) -> np.ndarray:
    """The order of points along a Z-curve over their first two columns."""
    code = np.zeros(len(points), np.int64)
    cell = [np.floor(points[:, i] / DEGREES).astype(np.int64) for i in (0, 1)]
    for bit in range(31):
        for i in (0, 1):
            code |= ((cell[i] - cell[i].min()) >> bit & 1) << (2 * bit + i)
    return np.argsort(code, kind="stable")


def _apart(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """Squared distances of one box from others, a little less for rounding."""
    return (np.maximum(0, np.maximum(los - hi, lo - his)) ** 2).sum(1) * (1 - 1e-12)


def nearest_by_tiles(targets: np.ndarray, events: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What nearest() gives, but a tile of targets meets only the tiles of events that can hold one of its k nearest.

    Both are cut into tiles along a Z-curve.  A few near tiles of events bound the k-th distance of a tile of
    targets, and all tiles of events within that bound are compared, in the order of the events.
    """
    n, m = len(targets), len(events)
    if m <= max(8 * TILE, 2 * k):
        return nearest(targets, events, k)
    far, which = np.empty((n, k)), np.empty((n, k), np.int64)
    order, start = _curve(events), np.arange(0, m, TILE)
    los, his = np.minimum.reduceat(events[order], start), np.maximum.reduceat(events[order], start)
    members = lambda tiles: np.sort(np.concatenate([order[i * TILE : (i + 1) * TILE] for i in tiles]))
    line, enough = _curve(targets), 3 + k // TILE
    for first in range(0, n, TILE * GROUP):
        group = targets[line[first : first + TILE * GROUP]]
        apart = _apart(group.min(0), group.max(0), los, his)
        near = np.argsort(apart, kind="stable")
        for at in range(first, min(n, first + TILE * GROUP), TILE):
            rows = line[at : min(at + TILE, first + TILE * GROUP)]
            part, tried = targets[rows], max(TRIED, enough)
            while True:
                tiles = near[:tried]
                beyond = apart[near[tried]] if tried < len(near) else np.inf
                gap = _apart(part.min(0), part.max(0), los[tiles], his[tiles])
                found = members(tiles[np.argsort(gap, kind="stable")[:enough]])
                bound = nearest(part, events[found], k)[0].max() ** 2 * (1 + 1e-12)
                if bound < beyond:
                    break
                tried *= 4
            found = members(tiles[gap <= bound])
            far[rows], nth = nearest(part, events[found], k)
            which[rows] = found[nth]
    return far, which


def spacetime_distances(panel: Panel, return_values: str = "distances", k: int = 1, nu: float = 1.0, power: float = 0.0) -> Panel:
    """The mean distance to the k nearest events (values above 0) up to now, or the mean of size / distance**power.

    Cells are half a degree wide and a step of time counts as nu degrees.  Without an event the value is 999.
    With fewer than k events distances are infinite, and the missing events' weights 0.

    For any cell only a cell's k latest events can count.  An event takes its k - 1 predecessors along by
    lag(), and rows between events the last event's, so a row's state is k pairs of numbers and no window holds
    a list.  Then each time's map is one task, with memory for one map and its events whatever the number of
    times, and time that grows with the cells: nearest_by_tiles() has the search.
    """
    if return_values not in ("distances", "weights"):
        raise ValueError(f"return_values is 'distances' or 'weights', not {return_values!r}")
    placed = panel.with_positions("_t")
    time_key, unit_key, features = panel.time, panel.unit, panel.features  # the function must not carry the panel
    df = placed.df.select(time_key, unit_key, "_t", *features).repartition(unit_key)
    past = Window.partitionBy(unit_key).orderBy(time_key).rowsBetween(Window.unboundedPreceding, 0)
    for i, f in enumerate(features):
        # windows by unit and event, then by unit: both keep the partitioning by unit
        df = df.withColumn("_event", F.coalesce(F.col(f) > 0, F.lit(False)))
        events = Window.partitionBy(unit_key, "_event").orderBy(time_key)
        at = lambda c, j: F.when(F.col("_event"), F.lag(c, j).over(events) if j else F.col(c))  # noqa: B023, E731
        df = df.withColumns({f"_s{i}_{j}": F.when(F.col("_event"), F.struct(at("_t", j).alias("t"), at(f, j).alias("v"))) for j in range(k)})
        df = df.withColumns({f"_s{i}_{j}": F.last(f"_s{i}_{j}", True).over(past) for j in range(k)})
    flat = {f"_{c}{i}_{j}": F.col(f"_s{i}_{j}.{c}").cast("double") for i in range(len(features)) for j in range(k) for c in ("t", "v")}
    df = df.withColumns(flat).select(time_key, unit_key, "_t", *flat)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        unit = rows[unit_key].to_numpy()
        x, y, now = unit % GRID_STRIDE * DEGREES, unit // GRID_STRIDE * DEGREES, nu * rows["_t"].to_numpy(float)
        out = rows[[time_key, unit_key]].copy()
        for i, f in enumerate(features):
            t = np.concatenate([rows[f"_t{i}_{j}"].to_numpy(float) for j in range(k)])
            v = np.concatenate([rows[f"_v{i}_{j}"].to_numpy(float) for j in range(k)])
            own = np.tile(np.arange(len(unit)), k)
            there = ~np.isnan(t)
            if not there.any():
                out[f] = NONE
                continue
            t, v, own = t[there], v[there], own[there]
            order = np.lexsort((unit[own], -t))
            t, v, own = t[order], v[order], own[order]
            far, which = nearest_by_tiles(np.column_stack([x, y, now]), np.column_stack([x[own], y[own], nu * t]), k)
            if return_values == "distances":
                out[f] = far.mean(1)
            else:
                size = np.where(which >= 0, v[which], 0.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[f] = np.where(which < 0, 0.0, np.where(far == 0, size, size / far ** abs(power))).mean(1)
        return out

    schema = ", ".join(f"`{c}` {panel.df.schema[c].dataType.simpleString()}" for c in (panel.time, panel.unit)) + "".join(f", `{f}` double" for f in panel.features)
    return onto(panel, df.groupBy(panel.time).applyInPandas(solve, schema), NONE)
