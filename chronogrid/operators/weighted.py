"""The pattern behind the lags: a (target, source, weight) relation joined to the panel and summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import Panel


def weighted_sum(joined: DataFrame, keys: list[str], features: tuple[str, ...], weight: str | Column = "weight") -> DataFrame:
    """Sum of weight * feature by target, partially aggregated before the shuffle."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return joined.groupBy(*keys).agg(*(F.sum(w * F.col(f)).alias(f) for f in features))


def onto(panel: Panel, lagged: DataFrame, default: float = 0.0) -> Panel:
    """The panel's rows with features from `lagged` (time, unit, features), `default` where it has no row."""
    keys = [panel.time, panel.unit]
    rest = panel.df.drop(*panel.features)
    out = rest.join(lagged.withColumn("_hit", F.lit(True)), keys, "left")
    return panel.with_df(out.withColumns({f: F.when(F.col("_hit").isNull(), F.lit(default)).otherwise(F.col(f)) for f in panel.features}).drop("_hit"))
