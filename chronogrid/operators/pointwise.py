"""Row-wise operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalar
from ..panel import Panel


def identity(panel: Panel) -> Panel:
    return panel


def greater_or_equal(panel: Panel, value: float) -> Panel:
    return panel.map(lambda c: scalar.greater_or_equal(c, value))


def smaller_or_equal(panel: Panel, value: float) -> Panel:
    return panel.map(lambda c: scalar.smaller_or_equal(c, value))


def in_range(panel: Panel, low: float, high: float) -> Panel:
    return panel.map(lambda c: scalar.in_range(c, low, high))


def ln(panel: Panel) -> Panel:
    return panel.map(scalar.ln)


def decay(panel: Panel, halflife: float) -> Panel:
    return panel.map(lambda c: scalar.decay(c, halflife))


def left_right(panel: Panel) -> tuple[str, str]:
    """The two features of a two-column operator, by position."""
    if len(panel.features) != 2:
        raise ValueError(f"exactly two features are needed, not {len(panel.features)}")
    return panel.features[0], panel.features[1]


def _two(panel: Panel, fn: Callable[[Column, Column], Column]) -> Panel:
    left, right = left_right(panel)
    return panel.with_df(panel.df.withColumn(left, fn(F.col(left), F.col(right))).drop(right), [left])


def add_column(panel: Panel) -> Panel:
    return _two(panel, scalar.add)


def subtract_column(panel: Panel) -> Panel:
    return _two(panel, scalar.subtract)


def multiply_column(panel: Panel) -> Panel:
    return _two(panel, scalar.multiply)


def divide_column(panel: Panel) -> Panel:
    return _two(panel, scalar.divide)
