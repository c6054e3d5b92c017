"""Missing data: constants, means, filling and interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..panel import Panel

DIRECTIONS, AREAS = ("forward", "backward", "both"), (None, "inside", "outside")


def _valid(direction: str, area: str | None) -> None:
    if direction not in DIRECTIONS or area not in AREAS:
        raise ValueError(f"limit_direction is one of {DIRECTIONS} and limit_area one of {AREAS}")


def replace_na(panel: Panel, replacement: float = 0) -> Panel:
    return panel.filled(float(replacement))


def list_totally_missing(panel: Panel) -> DataFrame:
    """name of each feature without a value, from one aggregate over all."""
    counts = panel.df.agg(*(F.count(f).alias(f"c{i}") for i, f in enumerate(panel.features)))
    rows = F.array(*(F.struct(F.lit(f).alias("name"), F.col(f"c{i}").alias("n")) for i, f in enumerate(panel.features)))
    return counts.select(F.explode(rows).alias("r")).where("r.n = 0").select("r.name")


def fill_groups_with_time_means(panel: Panel) -> Panel:
    """Units of which every feature is missing at all times take each time's mean.

    The means are one row per time, summed before their shuffle and broadcast: a panel has few steps.
    """
    unit = Window.partitionBy(panel.unit)
    seen = sum((F.count(f).over(unit) for f in panel.features), F.lit(0))
    means = panel.df.groupBy(panel.time).agg(*(F.avg(f).alias(f"_m_{f}") for f in panel.features))
    df = panel.df.withColumn("_seen", seen).join(F.broadcast(means), panel.time)
    df = df.withColumns({f: F.when(F.col("_seen") == 0, F.col(f"_m_{f}")).otherwise(F.col(f)) for f in panel.features})
    return panel.with_df(df.drop("_seen", *(f"_m_{f}" for f in panel.features)))


def fill_with_group_and_global_means(panel: Panel) -> Panel:
    """Missing values take the unit's mean, then the mean of all values so filled."""
    unit = Window.partitionBy(panel.unit)
    df = panel.df.withColumns({f: F.coalesce(f, F.avg(f).over(unit)) for f in panel.features})
    means = df.agg(*(F.avg(f).alias(f"_g_{f}") for f in panel.features))
    df = df.crossJoin(F.broadcast(means))  # one row
    return panel.with_df(df.withColumns({f: F.coalesce(f, f"_g_{f}") for f in panel.features}).drop(*(f"_g_{f}" for f in panel.features)))


def _around(panel: Panel):
    w = Window.partitionBy(panel.unit).orderBy(panel.time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return w, back, ahead


def extrapolate(panel: Panel, limit_direction: str = "both", limit_area: str | None = None) -> Panel:
    """Linear interpolation by row within a unit; outside its values the nearest one, in the direction given."""
    _valid(limit_direction, limit_area)
    w, back, ahead = _around(panel)
    df = panel.df.withColumn("_p", F.row_number().over(w).cast("double"))

    def interpolated(name: str):
        c = F.col(name)
        at = F.when(c.isNotNull(), F.col("_p"))
        before, after = F.last(c, True).over(back), F.first(c, True).over(ahead)
        p0, p1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
        inner = before + (after - before) * (F.col("_p") - p0) / (p1 - p0)
        out = F.when(c.isNotNull(), c)
        if limit_area != "outside":
            out = out.when(before.isNotNull() & after.isNotNull(), inner)
        if limit_area != "inside" and limit_direction in ("forward", "both"):
            out = out.when(after.isNull(), before)
        if limit_area != "inside" and limit_direction in ("backward", "both"):
            out = out.when(before.isNull(), after)
        return out

    return panel.with_df(df.withColumns({f: interpolated(f) for f in panel.features}).drop("_p"))


def fill(panel: Panel, limit_direction: str = "both", limit_area: str | None = None) -> Panel:
    """Filling by the last or next value of the unit.

    Without an area: forward, backward, or forward and then backward.  Inside: between the first and the last
    value only (forward unless backward is asked for).  Outside: both ends, whatever the direction.
    """
    _valid(limit_direction, limit_area)
    _, back, ahead = _around(panel)

    def filled(name: str):
        c = F.col(name)
        before, after = F.last(c, True).over(back), F.first(c, True).over(ahead)
        if limit_area == "inside":
            return F.when(before.isNotNull() & after.isNotNull(), after if limit_direction == "backward" else before).otherwise(c)
        if limit_area == "outside":
            return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(c)
        return {"forward": before, "backward": after, "both": F.coalesce(before, after)}[limit_direction]

    return panel.with_df(panel.df.withColumns({f: filled(f) for f in panel.features}))
