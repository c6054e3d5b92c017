"""Lags over a network of neighbouring countries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..panel import Panel
from ..plans.lineage import cut_lineage
from .weighted import onto

BROADCAST_ROWS = 500_000


def balls(edges: DataFrame, order: int) -> DataFrame:
    """(net, unit, member, hops): what each unit reaches in up to `order` hops, with the fewest, itself included.

    edges: (net, a_id, b_id).  A net is a few hundred countries, so each hop is one small join.
    """
    hops = edges.select("net", F.col("a_id").alias("member"), F.col("b_id").alias("next")).distinct()
    found = edges.select("net", F.col("b_id").alias("unit"), F.col("b_id").alias("member")).distinct().withColumn("hops", F.lit(0))
    for k in range(order):
        rim = found.where(F.col("hops") == k).join(hops, ["net", "member"]).select("net", "unit", F.col("next").alias("member"), F.lit(k + 1).alias("hops"))
        found = found.union(rim).groupBy("net", "unit", "member").agg(F.min("hops").alias("hops"))
    return found


def nets(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(month, net) and the edges (net, a_id, b_id) of each different network: few over all months."""
    edges = cut_lineage(edges.select("month_id", "a_id", "b_id"))
    months = edges.groupBy("month_id").agg(F.xxhash64(F.sort_array(F.collect_set(F.struct("a_id", "b_id")))).alias("net"))
    one = months.groupBy("net").agg(F.min("month_id").alias("month_id"))
    return months.withColumnRenamed("month_id", "month"), edges.join(F.broadcast(one), "month_id").select("net", "a_id", "b_id").distinct()


def country_distances(centroids: DataFrame) -> DataFrame:
    """(a_id, b_id, dist) of every ordered pair of (id, lat, lon), in degrees on a plane.

    As many rows as the square of the number of countries, a few hundred: one side is broadcast.
    """
    a = centroids.select(F.col("id").alias("a_id"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    b = centroids.select(F.col("id").alias("b_id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    return a.crossJoin(F.broadcast(b)).select("a_id", "b_id", _far().alias("dist"))


def _far():
    return F.sqrt(F.pow(F.col("lat0") - F.col("lat1"), F.lit(2.0)) + F.pow(F.col("lon0") - F.col("lon1"), F.lit(2.0)))


def country_lag(
    panel: Panel,
    edges: DataFrame,
    centroids: DataFrame,
    kernel_inner: int = 1,
    kernel_width: int = 1,
    kernel_power: float = 0.0,
    norm_kernel: bool = False,
) -> Panel:
    """Weighted sum over the countries in a ring of hops around each, month by month.

    `edges` is (month_id, a_id, b_id) and `centroids` (id, lat, lon).  The ring holds what kernel_inner - 1 +
    kernel_width hops reach and kernel_inner - 1 do not.  A weight is distance ** +power (a grid lag has -
    power), distances in degrees on a plane.  A country or month outside the network gets 0, as does an empty
    ring; a missing neighbour makes the sum missing; an infinite one counts as 0; absent rows add nothing.
    """
    inner = int(kernel_inner) - 1
    outer = inner + int(kernel_width)
    if inner < 0 and kernel_power < 0:
        raise ValueError("a country's distance to itself is 0: a negative power needs kernel_inner 1 or more")
    months, distinct_edges = nets(edges)
    ring = balls(distinct_edges, max(0, outer)).where((F.col("hops") > inner) & (F.col("hops") <= outer))
    at = lambda k, name: centroids.select(F.col("id").alias(name), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    weight = F.pow(_far(), F.lit(float(kernel_power))) if kernel_power else F.lit(1.0)
    weighted = cut_lineage(ring.join(at(0, "unit"), "unit").join(at(1, "member"), "member").select("net", "unit", "member", weight.alias("weight")))
    units = panel.df.select(F.col(panel.unit).alias("member")).distinct()
    weighted = weighted.join(units, "member", "left_semi")
    values = panel.df.select(F.col(panel.time).alias("month"), F.col(panel.unit).alias("member"), F.lit(True).alias("here"), *panel.features)
    targets = panel.df.select(F.col(panel.time).alias("month"), F.col(panel.unit).alias("unit")).join(F.broadcast(months), "month")
    small = weighted.count() <= BROADCAST_ROWS
    joined = targets.join(F.broadcast(weighted) if small else weighted, ["net", "unit"]).join(values, ["month", "member"], "left")

    def total(f: str):
        v = F.when(F.col("here").isNull() | (F.col(f) == float("inf")), F.lit(0.0)).otherwise(F.col(f))
        sums = F.when(F.count(v) == F.count("*"), F.sum(v * F.col("weight")))
        return F.when(F.sum("weight") != 0, sums / F.sum("weight")) if norm_kernel else sums

    lagged = joined.groupBy("month", "unit").agg(*(total(f).alias(f) for f in panel.features))
    return onto(panel, lagged.withColumnsRenamed({"month": panel.time, "unit": panel.unit}))
