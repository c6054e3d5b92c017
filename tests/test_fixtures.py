"""The fixtures of FIXTURES.md."""

import math

import numpy as np
import pytest

from chronogrid import Panel
from chronogrid.operators import knn, missing, network, pointwise, runs, temporal

N = None


def series(spark, values, name="v"):
    rows = [(t, 1, None if v is None else float(v)) for t, v in enumerate(values)]
    return Panel.ingest(spark.createDataFrame(rows, f"time int, unit long, {name} double"))


def values(panel, name=None):
    name = name or panel.features[0]
    return [r[name] for r in panel.df.orderBy("unit", "time").collect()]


def test_identity(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")
    p = Panel(df, "a", "b", ())
    assert pointwise.identity(p).df.collect() == df.collect()


def test_replace_na_after_a_shift(spark):
    rows = [(r, 0, *([None if r < 5 else 1.0] * 10)) for r in range(10)]
    p = Panel.ingest(spark.createDataFrame(rows, "time int, unit int, " + ", ".join(f"c{i} double" for i in range(10))))
    out = missing.replace_na(p, 0).df.toPandas()[list(p.features)].to_numpy()
    assert not np.isnan(out).any() and out.sum() == 50


@pytest.mark.parametrize(
    ("size", "mode", "nu", "power", "expected"),
    [
        (1.0, "distances", 1, 0, {(100, 721): 999, (101, 721): 0, (101, 722): 0.5, (101, 2): 1 / math.sqrt(2), (102, 721): 1, (102, 720): math.sqrt(1.25)}),
        (1.0, "distances", 10, 0, {(100, 721): 999, (101, 721): 0, (101, 722): 0.5, (102, 721): 10}),
        (1.0, "weights", 1, 2, {(100, 721): 999, (101, 721): 1, (101, 722): 4}),
        (1.0, "weights", 10, 2, {(100, 721): 999, (102, 721): 0.01, (102, 722): 1 / 100.25}),
        (3.0, "weights", 10, 2, {(102, 722): 3 / 100.25}),
    ],
)
def test_spacetime_nearest(spark, size, mode, nu, power, expected):
    rows = [(m, y * 720 + x, size if (m, x, y) == (101, 1, 1) else 0.0) for m in (100, 101, 102) for y in range(3) for x in range(3)]
    p = Panel.ingest(spark.createDataFrame(rows, "month int, cell long, deaths double"), "month", "cell")
    out = {(r.month, r.cell): r.deaths for r in knn.spacetime_distances(p, mode, 1, nu, power).df.collect()}
    assert len(out) == 27
    for key, value in expected.items():
        assert out[key] == pytest.approx(value, rel=1e-3)


@pytest.mark.parametrize(("inner", "width", "expected"), [(0, 0, "zero"), (0, 1, "same"), (1, 1, "ring")])
def test_country_ring(spark, inner, width, expected):
    data = [(229, 57, 0.0), (229, 59, 281.0), (229, 120, 0.0), (229, 235, 18.0), (229, 237, 18.0), (229, 242, 0.0)]
    p = Panel.ingest(spark.createDataFrame(data, "month int, country int, deaths double"), "month", "country")
    pairs = [(237, 59), (237, 235), (57, 120), (120, 242)]
    edges = spark.createDataFrame([(229, a, b) for x, y in pairs for a, b in ((x, y), (y, x))], "month_id int, a_id int, b_id int")
    centroids = spark.createDataFrame([(c, float(i), float(i % 3)) for i, (_, c, _) in enumerate(data)], "id int, lat double, lon double")
    out = {r.country: r.deaths for r in network.country_lag(p, edges, centroids, inner, width).df.collect()}
    if expected == "ring":
        assert out[237] == 299
    else:
        assert out == {c: (v if expected == "same" else 0.0) for _, c, v in data}


def test_run_lengths(spark):
    p = series(spark, [0, 0, 1, 1, 0, 0])
    assert values(runs.cweq(p, 0)) == [1, 2, 0, 0, 1, 2]
    since = runs.time_since(p, 0)
    assert [(r.time, r.v) for r in since.df.orderBy("time").collect()] == [(1, 1), (2, 2), (3, 0), (4, 0), (5, 1)]


@pytest.mark.parametrize(
    ("direction", "area", "expected"),
    [
        ("forward", None, [N, N, 1, 2, 3, 4, 4, 4]),
        ("forward", "inside", [N, N, 1, 2, 3, 4, N, N]),
        ("forward", "outside", [N, N, 1, N, N, 4, 4, 4]),
        ("backward", None, [1, 1, 1, 2, 3, 4, N, N]),
        ("backward", "inside", [N, N, 1, 2, 3, 4, N, N]),
        ("backward", "outside", [1, 1, 1, N, N, 4, N, N]),
        ("both", None, [1, 1, 1, 2, 3, 4, 4, 4]),
        ("both", "inside", [N, N, 1, 2, 3, 4, N, N]),
        ("both", "outside", [1, 1, 1, N, N, 4, 4, 4]),
    ],
)
def test_extrapolate(spark, direction, area, expected):
    assert values(missing.extrapolate(series(spark, [N, N, 1, N, N, 4, N, N]), direction, area)) == expected


@pytest.mark.parametrize(
    ("direction", "area", "expected"),
    [
        ("forward", None, [N, 1, 1, 1, 4, 4]),
        ("backward", None, [1, 1, 4, 4, 4, N]),
        ("both", None, [1, 1, 1, 1, 4, 4]),
        ("forward", "inside", [N, 1, 1, 1, 4, N]),
        ("backward", "inside", [N, 1, 4, 4, 4, N]),
        ("forward", "outside", [1, 1, N, N, 4, 4]),
    ],
)
def test_fill(spark, direction, area, expected):
    assert values(missing.fill(series(spark, [N, 1, N, N, 4, N]), direction, area)) == expected


def test_rolling_with_missing(spark):
    p = series(spark, [N, N, 1, N, 3])
    assert values(temporal.moving_sum(p, 2)) == [0, 0, 1, 1, 3]
    assert values(temporal.moving_average(p, 2)) == [N, N, 1, 1, 3]
    assert values(temporal.rollmax(p, 2)) == [N, N, 1, 1, 3]


def test_missing_in_predicates(spark):
    p = series(spark, [N, 5, float("nan")])
    assert values(pointwise.greater_or_equal(p, 5)) == [0, 1, 0]
    assert values(pointwise.smaller_or_equal(p, 5)) == [0, 1, 0]
    assert values(pointwise.in_range(p, 1, 9)) == [-1, 1, -1]
    assert values(temporal.onset(p, 1)) == [1, 1, 0]


def test_version():
    import chronogrid

    assert chronogrid.__version__ == "0.1.0"
