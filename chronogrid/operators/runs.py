"""Run lengths by gaps and islands: one shuffle by unit for both windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..panel import Panel
from . import temporal


def cweq(panel: Panel, value: float, seed: float | None = None) -> Panel:
    """Rows so far in the current run of the feature being equal to `value`, 0 outside; missing rows go.

    A seed other than 0 replaces the 1 of a run that starts at the panel's first remaining time; totals are
    cut to whole numbers.
    """
    f = panel.only_feature()
    df = panel.df.where(F.col(f).isNotNull()).withColumn("_m", (F.col(f) == F.lit(float(value))).cast("long"))
    count = F.col("_m").cast("double")
    if seed:
        first = df.agg(F.min(panel.time)).first()[0]
        count = F.when((F.col("_m") == 1) & (F.col(panel.time) == F.lit(first)), F.lit(float(seed))).otherwise(count)
    w = Window.partitionBy(panel.unit).orderBy(panel.time).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_c": count, "_b": F.sum(1 - F.col("_m")).over(w)})
    run = Window.partitionBy(panel.unit, "_b").orderBy(panel.time).rowsBetween(Window.unboundedPreceding, 0)
    return panel.with_df(df.withColumn(f, F.sum("_c").over(run).cast("long")).drop("_m", "_c", "_b"))


def time_since(panel: Panel, value: float = 0, seed: float | None = None) -> Panel:
    """Rows since the feature last differed from `value`, not counting the current row; first rows go."""
    return cweq(temporal.tlag(panel, 1), value, seed)


def tick_time_since(panel: Panel, event: str, since: str) -> Panel:
    """One step of a time-since counter from exactly two times: 0 after an event, else the count before + 1.

    Rows of the later time are returned, with `since` replaced.
    """
    w = panel.by_unit()
    before = panel.df.withColumns({"_e": F.lag(event, 1).over(w), "_s": F.lag(since, 1).over(w), "_k": F.row_number().over(w)})
    return panel.with_df(before.where("_k = 2").withColumn(since, F.when(F.col("_e") != 0, F.lit(0.0)).otherwise(F.col("_s") + 1)).drop("_e", "_s", "_k"))
