"""Time since the last event, kept per unit as a stream of steps comes in."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_time_since(steps: DataFrame, time: str = "time", unit: str = "unit", event: str = "event", initial: float = 0.0) -> DataFrame:
    """(time, unit, since) for every step of a stream of (time, unit, event).

    A step gets 0 if the unit's step before had an event (not 0), else the count before + 1; a unit's first
    step starts from `initial`.  State is two numbers a unit.  Steps of a unit must come in order of time
    over the batches; within a batch they are sorted; a missing event counts as none.
    """
    kinds = {c: steps.schema[c].dataType.simpleString() for c in (time, unit)}

    def advance(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, before = state.get if state.exists else (initial, None)
        rows = pd.concat(list(batches)).sort_values(time)
        since = []
        for e in rows[event].fillna(0):
            if before is not None:
                count = 0.0 if before else count + 1
            since.append(count)
            before = bool(e)
        state.update((count, before))
        yield pd.DataFrame({time: rows[time].to_numpy(), unit: key[0], "since": since})

    out = f"{time} {kinds[time]}, {unit} {kinds[unit]}, since double"
    return steps.select(time, unit, event).groupBy(unit).applyInPandasWithState(advance, out, "count double, before boolean", "append", GroupStateTimeout.NoTimeout)
