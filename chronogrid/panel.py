"""The panel: a DataFrame keyed by (time, unit) with numeric feature columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

GRID_STRIDE = 720


@dataclass(frozen=True)
class Panel:
    """`features` are doubles and missing is NULL; other columns are carried along untouched."""

    df: DataFrame
    time: str
    unit: str
    features: tuple[str, ...]

    @classmethod
    def ingest(cls, df: DataFrame, time: str = "time", unit: str = "unit", features: Sequence[str] | None = None) -> Panel:
        """Cast the features to double and turn NaN into NULL."""
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        chosen = tuple(features) if features is not None else tuple(c for c, t in df.dtypes if c not in (time, unit) and t.startswith(numeric))
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return cls(df.withColumns({c: value(c) for c in chosen}) if chosen else df, time, unit, chosen)

    def with_df(self, df: DataFrame, features: Sequence[str] | None = None) -> Panel:
        return replace(self, df=df, features=self.features if features is None else tuple(features))

    def map(self, fn: Callable[[Column], Column]) -> Panel:
        """Replace every feature by fn of it, in one projection (windows of one kind share one shuffle)."""
        return self.with_df(self.df.withColumns({c: fn(F.col(c)) for c in self.features}))

    def only_feature(self) -> str:
        if len(self.features) != 1:
            raise ValueError(f"one feature is needed, not {len(self.features)}")
        return self.features[0]

    def by_unit(self, before: int | None = None, after: int | None = None) -> WindowSpec:
        """A unit's rows by time; with bounds, the rows from `before` to `after` around the current."""
        w = Window.partitionBy(self.unit).orderBy(self.time)
        return w if before is None else w.rowsBetween(before, after)

    def times(self) -> list[int]:
        """The sorted distinct times: as many as the panel has steps, so the driver can hold them."""
        return sorted(r[0] for r in self.df.select(self.time).distinct().collect())

    def units(self) -> DataFrame:
        """The distinct units."""
        return self.df.select(self.unit).distinct()

    def assert_balanced(self) -> None:
        """Raise unless each unit has a row at each time."""
        n, t, u = self.df.agg(F.count("*"), F.count_distinct(self.time), F.count_distinct(self.unit)).first()
        if n != t * u:
            raise ValueError(f"the panel is not balanced: {n} rows, {t} times, {u} units")

    def densify(self) -> Panel:
        """Every unit at every time, missing rows with NULL features; the times go as one array per unit."""
        times = F.array_sort(F.collect_set(self.time))
        steps = self.df.agg(times.alias("_times"))
        units = self.units().crossJoin(F.broadcast(steps))  # one row, of the panel's steps
        grid = units.select(self.unit, F.explode("_times").alias(self.time))
        return self.with_df(grid.join(self.df, [self.time, self.unit], "left"))

    def filled(self, value: float = 0.0) -> Panel:
        return self.map(lambda c: F.coalesce(c, F.lit(value)))

    def with_positions(self, name: str = "tindex") -> Panel:
        """Each row's place among the sorted distinct times, joined from their small table."""
        spark, times = self.df.sparkSession, self.times()
        kind = self.df.schema[self.time].dataType.simpleString()
        table = spark.createDataFrame(list(zip(times, range(len(times)), strict=True)), f"{self.time} {kind}, {name} int")
        return self.with_df(self.df.join(F.broadcast(table), self.time))

    def to_datacube(self) -> tuple[np.ndarray, list[int], list[int]]:
        """An action: values as time x unit x feature, with the times and units, for plots of small panels."""
        self.assert_balanced()
        rows = self.df.select(self.time, self.unit, *self.features).toPandas().sort_values([self.time, self.unit])
        times, units = sorted(rows[self.time].unique()), sorted(rows[self.unit].unique())
        return rows[list(self.features)].to_numpy(float).reshape(len(times), len(units), len(self.features)), times, units


@dataclass(frozen=True)
class Grid:
    """Cells inside the smallest square whose side is a power of two, centred."""

    x0: int
    y0: int
    ncells: int
    power: int

    @classmethod
    def of(cls, panel: Panel) -> Grid:
        u = F.col(panel.unit)
        r = panel.df.agg(F.min(u % GRID_STRIDE).alias("xl"), F.max(u % GRID_STRIDE).alias("xh"), F.min(F.floor(u / GRID_STRIDE)).alias("yl"), F.max(F.floor(u / GRID_STRIDE)).alias("yh")).first()
        wide, high = int(r.xh - r.xl), int(r.yh - r.yl)
        if max(wide, high) < 1:
            raise ValueError("a grid needs more than one cell")
        power = 1 + int(np.log2(max(wide, high)))
        n = 2**power
        return cls(int(r.xl) - (n - wide) // 2, int(r.yl) - (n - high) // 2, n, power)

    def box(self, panel: Panel) -> tuple[int, int, int, int]:
        """The first and last x and y of the panel's cells in the square."""
        u = F.col(panel.unit)
        return tuple(int(v) for v in panel.df.agg(F.min(self.x(u)), F.max(self.x(u)), F.min(self.y(u)), F.max(self.y(u))).first())

    def x(self, unit: Column) -> Column:
        return (unit % GRID_STRIDE - self.x0).cast("int")

    def y(self, unit: Column) -> Column:
        return (F.floor(unit / GRID_STRIDE) - self.y0).cast("int")
