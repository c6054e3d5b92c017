"""Window operators within a unit's time series; a step is a row.

All features of a call, and chained calls, share the partitioning by unit: one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..panel import Panel


def _positive(n: int, hint: str) -> int:
    if int(n) < 1:
        raise RuntimeError(f"time must be 1 or more{hint}, not {n}")
    return int(n)


def tlag(panel: Panel, time: int) -> Panel:
    """The value `time` rows earlier."""
    n = _positive(time, " (use tlead for the other direction)")
    return panel.map(lambda c: F.lag(c, n).over(panel.by_unit()))


def tlead(panel: Panel, time: int) -> Panel:
    """The value `time` rows later."""
    n = _positive(time, " (use tlag for the other direction)")
    return panel.map(lambda c: F.lead(c, n).over(panel.by_unit()))


def delta(panel: Panel, time: int = 1) -> Panel:
    """The change over `time` rows."""
    n = _positive(time, "")
    return panel.map(lambda c: c - F.lag(c, n).over(panel.by_unit()))


def moving_average(panel: Panel, time: int) -> Panel:
    """Mean of the last `time` rows' present values; missing if none is."""
    n = _positive(time, "")
    return panel.map(lambda c: F.avg(c).over(panel.by_unit(-(n - 1), 0)))


def moving_sum(panel: Panel, time: int) -> Panel:
    """Sum of the last `time` rows' present values; 0 if none is."""
    n = _positive(time, "")
    return panel.map(lambda c: F.coalesce(F.sum(c).over(panel.by_unit(-(n - 1), 0)), F.lit(0.0)))


def rollmax(panel: Panel, window: int) -> Panel:
    """Maximum of the last `window` rows' present values; missing if none is."""
    n = _positive(window, "")
    return panel.map(lambda c: F.max(c).over(panel.by_unit(-(n - 1), 0)))


def mean(panel: Panel) -> Panel:
    """The unit's mean over all time, on every row."""
    return panel.map(lambda c: F.avg(c).over(Window.partitionBy(panel.unit)))


def demean(panel: Panel) -> Panel:
    """The deviation from the unit's mean."""
    return panel.map(lambda c: c - F.avg(c).over(Window.partitionBy(panel.unit)))


def tlags(panel: Panel, lags: Sequence[int] = (1,)) -> Panel:
    """Many lags of many features, named <feature>_tlag_<lag>, feature by feature; the first rows are missing."""
    w = panel.by_unit()
    new = {f"{f}_tlag_{k}": F.lag(f, _positive(k, "")).over(w) for f in panel.features for k in lags}
    return panel.with_df(panel.df.withColumns(new).drop(*panel.features), list(new))


def temporal_entropy(panel: Panel, window: int, offset: float = 0.0) -> Panel:
    """Shannon entropy (bits) of the shares of the last `window` rows' values, missing taken as 0.

    With p = x / X it is log2(X) - sum(x log2 x) / X; missing where a value in the window is 0 or signs differ.
    """
    panel = panel.map(lambda c: F.coalesce(c, F.lit(0.0)) + F.lit(float(offset)))
    w = panel.by_unit(-(int(window) - 1), 0)

    def entropy(c):
        size = F.abs(c)
        total = F.sum(size).over(w)
        logs = F.sum(F.when(size > 0, size * F.log2(size)).otherwise(F.lit(0.0))).over(w)
        whole = (F.min(c).over(w) > 0) | (F.max(c).over(w) < 0)
        return F.when(whole, F.log2(total) - logs / total)

    return panel.map(entropy)


def onset_possible(panel: Panel, window: int) -> Panel:
    """1 where the `window` rows before hold no value above 0 (missing counts as 0); 1 on a unit's first row."""
    n = _positive(window, "")
    lagged = panel.map(lambda c: F.coalesce(F.lag(c, 1).over(panel.by_unit()), F.lit(0.0)))
    return lagged.map(lambda c: (F.max(c).over(panel.by_unit(-(n - 1), 0)) == 0).cast("long"))


def onset(panel: Panel, window: int) -> Panel:
    """1 where an onset is possible and the value is not 0; a missing value counts as not 0."""
    now = {f"_{f}_now": F.col(f).isNull() | (F.col(f) != 0) for f in panel.features}
    possible = onset_possible(panel.with_df(panel.df.withColumns(now)), window)
    return panel.with_df(possible.df.withColumns({f: ((F.col(f) == 1) & F.col(f"_{f}_now")).cast("long") for f in panel.features}).drop(*now))
