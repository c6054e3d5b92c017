"""Maps far longer than wide: work and memory follow the cells, not the square around them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogrid import Panel
from chronogrid.operators import spatial

from .test_operators import placed, result

LONG = 60_000


def strip(seed=1, long=LONG):
    """Two times of a strip three cells wide, with cells at both ends only; for LONG its square has 65536 x 65536 cells."""
    rng = np.random.default_rng(seed)
    ends = [*range(9), *range(long - 8, long + 1)]
    return [(t, (y + 3) * 720 + x + 7, float(rng.integers(0, 50))) for t in (1, 2) for y in ends for x in range(3)]


def panel_of(spark, rows):
    return Panel.ingest(spark.createDataFrame(rows, "time int, unit long, v double"))


def cover(value, power, threshold, level=0, nx=0, ny=0):
    h = 2 ** (power - level)
    inside = {c: v for c, v in value.items() if c[0] // h == nx and c[1] // h == ny}
    if not inside:
        return []
    if sum(inside.values()) > threshold and level < power:
        return [n for i in (0, 1) for j in (0, 1) for n in cover(inside, power, threshold, level + 1, 2 * nx + i, 2 * ny + j)]
    return [(level, nx, ny, sum(inside.values()))]


def check_adaptive(rows, out, threshold, weight):
    _, power, at = placed(rows)
    for t in (1, 2):
        nodes = cover({at[u]: v for s, u, v in rows if s == t}, power, threshold)
        for s, u, _ in rows:
            if s == t:
                x, y = at[u]
                expected = 0.0
                for level, nx, ny, v in nodes:
                    h = 2 ** (power - level)
                    if not (level == power and (nx, ny) == (x, y)):
                        expected += v * weight(math.hypot(x + 0.5 - (nx + 0.5) * h, y + 0.5 - (ny + 0.5) * h))
                assert out[t, u] == pytest.approx(expected, rel=1e-9)


def test_adaptive_direct(spark):
    rows = strip()
    check_adaptive(rows, result(spatial.adaptive_grid_lag(panel_of(spark, rows), 0.0)), 0.0, lambda d: 1 / d)


def test_adaptive_lag_by_sparks_functions(spark):
    """A distance function of Spark's own is looked up, and large nodes are taken whole."""
    rows = strip(2, 2000)
    out = result(spatial.adaptive_grid_lag(panel_of(spark, rows), 90.0, {"log": lambda d: 1 / F.log(d + 2)}))
    check_adaptive(rows, out, 90.0, lambda d: 1 / math.log(d + 2))


def test_adaptive_nodes(spark):
    rows = strip(3)
    _, power, at = placed(rows)
    _, grids = spatial.adaptive_grid_lag(panel_of(spark, rows), 90.0, keep_grids=True)
    found = {(r.time, r.level, r.nx, r.ny, r.value) for r in grids.collect()}
    assert found == {(t, *n) for t in (1, 2) for n in cover({at[u]: v for s, u, v in rows if s == t}, power, 90.0)}


@pytest.mark.parametrize("theta", [0.001, 0.7, 1.6])
def test_quadtree(spark, theta):
    """At 0.001 cells at the other end are taken in nodes of up to 32 cells, near ones one by one."""
    rows = strip(4)
    _, power, at = placed(rows)
    out = result(spatial.quadtree_lag(panel_of(spark, rows), theta, 1))

    def lag(inside, x, y, level, nx, ny):
        h = 2 ** (power - level)
        inside = {c: v for c, v in inside.items() if c[0] // h == nx and c[1] // h == ny}
        if not inside:
            return 0.0
        d = math.hypot(x + 0.5 - (nx + 0.5) * h + 0.01, y + 0.5 - (ny + 0.5) * h + 0.01)
        if h / d > theta and level < power:
            return sum(lag(inside, x, y, level + 1, 2 * nx + i, 2 * ny + j) for i in (0, 1) for j in (0, 1))
        return 0.0 if h / d > theta and (x, y) == (nx, ny) else sum(inside.values()) / d

    for t in (1, 2):
        value = {at[u]: v for s, u, v in rows if s == t}
        for x, y in value:
            u = next(u for u, c in at.items() if c == (x, y))
            assert out[t, u] == pytest.approx(lag(value, x, y, 0, 0, 0), rel=1e-9)
