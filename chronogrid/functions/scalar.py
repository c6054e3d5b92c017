"""Pointwise transforms as Column to Column functions; missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def greater_or_equal(c: Column, value: float) -> Column:
    """1 where c >= value, else 0; 0 where c is missing."""
    return F.coalesce(c >= F.lit(value), F.lit(False)).cast("long")


def smaller_or_equal(c: Column, value: float) -> Column:
    """1 where c <= value, else 0; 0 where c is missing."""
    return F.coalesce(c <= F.lit(value), F.lit(False)).cast("long")


def in_range(c: Column, low: float, high: float) -> Column:
    """1 inside the closed range and 0 outside; -1 where c is missing, or between bounds given in reverse."""
    return greater_or_equal(c, low) + smaller_or_equal(c, high) - 1


def ln(c: Column) -> Column:
    """Natural logarithm of c + 1: -inf at -1, missing below."""
    return F.when(c > -1, F.log1p(c)).when(c == -1, F.lit(-_INF))


def decay(c: Column, halflife: float) -> Column:
    """2 ** (-c / halflife); a halflife of 0 is the limit, missing at c = 0."""
    if halflife == 0:
        return F.when(c > 0, F.lit(0.0)).when(c < 0, F.lit(_INF))
    return F.pow(F.lit(2.0), -c / F.lit(float(halflife)))


def add(left: Column, right: Column) -> Column:
    return left + right


def subtract(left: Column, right: Column) -> Column:
    return left - right


def multiply(left: Column, right: Column) -> Column:
    return left * right


def divide(left: Column, right: Column) -> Column:
    """left / right; by zero the infinity of left's sign, and missing for 0 / 0."""
    return F.when(right != 0, left / right).when((right == 0) & (left > 0), F.lit(_INF)).when((right == 0) & (left < 0), F.lit(-_INF))
