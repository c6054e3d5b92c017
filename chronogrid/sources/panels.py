"""Panels in files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..panel import Panel


def read_panel(spark: SparkSession, path: str, time: str = "time", unit: str = "unit", features: Sequence[str] | None = None, format: str = "parquet", **options) -> Panel:  # noqa: A002
    """Only the keys and the features named are read."""
    df = spark.read.format(format).options(**options).load(path)
    return Panel.ingest(df.select(time, unit, *features) if features is not None else df, time, unit, features)


def read_times(panel: Panel, first: int, last: int, halo: int = 0) -> Panel:
    """The times first..last and `halo` earlier rows for bounded windows; the filter reaches the scan.

    Apply a window of at most `halo` + 1 rows, then cut with between(). Not for unbounded windows.
    """
    return panel.with_df(panel.df.where((F.col(panel.time) >= first - halo) & (F.col(panel.time) <= last)))


def between(panel: Panel, first: int, last: int) -> Panel:
    return panel.with_df(panel.df.where(F.col(panel.time).between(first, last)))


def write_panel(panel: Panel, path: str, format: str = "parquet", by_time: bool = False, mode: str = "errorifexists") -> None:  # noqa: A002
    writer = panel.df.write.format(format).mode(mode)
    (writer.partitionBy(panel.time) if by_time else writer).save(path)


def save_bucketed(panel: Panel, table: str, buckets: int, mode: str = "errorifexists") -> None:
    """A table bucketed by unit and sorted by time: window operators on it need no shuffle."""
    panel.df.write.mode(mode).bucketBy(buckets, panel.unit).sortBy(panel.time).saveAsTable(table)
