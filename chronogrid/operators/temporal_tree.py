"""Temporal tree lag: the past in dyadic blocks that grow with age."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..panel import Panel
from .weighted import onto, weighted_sum


def _weight(function: str, start: float, end: float, now: float, sigma: float) -> float:
    mid = (start + end) / 2
    if function == "uniform":
        return 1.0
    if function == "oneovert":
        return 1 / (now - mid + 1.5)
    if function == "expon":
        old, middle, new = (math.exp(-(now - x) / sigma) for x in (start, mid, end))
        return (8 * old + 6 * middle - new) / 13
    if function == "ramp":
        return max(0.0, 1 - (now - mid + 0.5) / sigma)
    return 1 / (1 + math.exp(-(start - now + sigma) / (sigma / 5)))


BROADCAST_ROWS = 500_000
FUNCTIONS = ("uniform", "oneovert", "expon", "ramp", "sigmoid")


def cover(now: int, first: int) -> list[tuple[int, int]]:
    """(start, width), newest first, of the blocks that tile the past of step `now` back to `first`; steps count from a power of two below `first`.

    Widths double.  Blocks of width w reach back to the largest multiple of 2 w below the end of the narrower
    ones, so each width has one block or two (the first, of one step, one or none).
    """
    found, end, width = [], now, 1
    while end > first:
        to = end - end % 2 if width == 1 else 2 * width * ((end - 1) // (2 * width))
        found += [(start, width) for start in range(end - width, to - 1, -width)]
        end, width = to, 2 * width
    return found


def blocks(now: int, first: int, last: int, thetacrit: float) -> list[tuple[int, int]]:
    """(start, width) of the blocks that `now` takes its lag from, each past time in exactly one.

    A block of the cover is halved until width / age, age measured to its middle, is below thetacrit.
    """
    base = last - 2 ** (1 + int(math.log2(last - first)))  # blocks are aligned to it
    found, todo = [(now, 1)], cover(now - base, first - base)
    while todo:
        start, width = todo.pop()
        if width == 1 or width / (now - base - (start + width / 2)) < thetacrit:
            found.append((base + start, width))
        else:
            todo += [(start, width // 2), (start + width // 2, width // 2)]
    return found


def borders(first: int, last: int, thetacrit: float, function: str, sigma: float, fix_last_step: bool = False) -> list[tuple[int, int, float]]:
    """(now, time, coefficient): a lag is the sum of coefficient * (running sum up to and with time).

    A block from s to before e with weight w is w times the running sum at e - 1, less w times that at s - 1.
    The last time has none unless it is fixed.
    """
    if last <= first:
        raise ValueError("a temporal tree needs two times or more")
    end = last + 1 if fix_last_step else last
    out = []
    for now in range(first, end):
        at: dict[int, float] = {}
        for s, w in blocks(now, first, end, thetacrit):
            if s + w > first:
                weight = _weight(function, s, s + w, now, sigma)
                at[s + w - 1] = at.get(s + w - 1, 0.0) + weight
                at[s - 1] = at.get(s - 1, 0.0) - weight
        out += [(now, t, c) for t, c in at.items() if t >= first and c]
    return out


def temporal_tree_lag(panel: Panel, thetacrit: float, weight_functions: str, sigma: float = 1, fix_last_step: bool = False) -> Panel:
    """Weighted sum of a unit's past, the present included; steps are calendar integers and gaps are 0.

    Blocks are differences of running sums, so a step needs a few sums for each doubling of its age rather
    than all earlier steps.  Coefficients depend on the panel's first and last time only; up to BROADCAST_ROWS
    of them are broadcast, more are joined by a shuffle.  The last step is 0 unless `fix_last_step`.
    """
    if weight_functions not in FUNCTIONS:
        raise ValueError(f"weight_functions is one of {FUNCTIONS}, not {weight_functions!r}")
    panel = panel.filled()
    first, last = panel.df.agg(F.min(panel.time), F.max(panel.time)).first()
    table = borders(int(first), int(last), thetacrit, weight_functions, sigma, fix_last_step)
    kind = panel.df.schema[panel.time].dataType.simpleString()
    relation = panel.df.sparkSession.createDataFrame(table, f"_now {kind}, _at {kind}, weight double")
    running = panel.by_unit(Window.unboundedPreceding, 0)
    following = F.coalesce(F.lead(panel.time).over(panel.by_unit()), F.lit(last + 1))
    sums = panel.df.select(panel.time, panel.unit, *(F.sum(f).over(running).alias(f) for f in panel.features), following.alias("_next"))
    # the sum at a step without a row is that of the row before it
    sums = sums.withColumn("_at", F.explode(F.sequence(F.col(panel.time), F.col("_next") - 1))).drop(panel.time, "_next")
    joined = sums.join(F.broadcast(relation) if len(table) <= BROADCAST_ROWS else relation, "_at")
    lagged = weighted_sum(joined, ["_now", panel.unit], panel.features).withColumnRenamed("_now", panel.time)
    return onto(panel, lagged)
