"""Panels of the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..panel import GRID_STRIDE, Panel

GRID_WIDTH = 15


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str):
    """Sums of whole cents do not depend on their order."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / 100


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time (days since 2024-01-01), unit, v and n of the days that a user has events."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    events = _read(spark, sf_dir, "events").select(day.alias("time"), F.col("user_id").alias("unit"), "value")
    return events.groupBy("time", "unit").agg(_cents("value").alias("v"), F.count("*").cast("double").alias("n"))


def daily(spark: SparkSession, sf_dir: str, *features: str) -> Panel:
    """Users by day, dense: absent days are missing."""
    features = features or ("v",)
    return Panel.ingest(observed(spark, sf_dir).select("time", "unit", *features), features=features).densify()


def flagged(spark: SparkSession, sf_dir: str, above: float) -> Panel:
    """daily() with e: 1 where v is above the bound, 0 elsewhere, missing where v is."""
    p = daily(spark, sf_dir)
    return p.with_df(p.df.select("time", "unit", F.when(F.col("v") > above, 1.0).when(F.col("v").isNotNull(), 0.0).alias("e")), ["e"])


def gappy(spark: SparkSession, sf_dir: str) -> Panel:
    """daily() of v and n in which every 50th unit has nothing."""
    p = daily(spark, sf_dir, "v", "n")
    return p.map(lambda c: F.when(F.col("unit") % 50 != 7, c))


def cells(spark: SparkSession, sf_dir: str, above: float | None = None) -> Panel:
    """daily() on a grid, or only the values above a bound (others 0); v is present everywhere."""
    p = daily(spark, sf_dir).filled()
    cell = F.floor(F.col("unit") / GRID_WIDTH) * GRID_STRIDE + F.col("unit") % GRID_WIDTH
    v = F.col("v") if above is None else F.when(F.col("v") > above, F.col("v")).otherwise(F.lit(0.0))
    return p.with_df(p.df.select("time", cell.cast("long").alias("unit"), v.alias("v")))


def countries(spark: SparkSession, sf_dir: str) -> Panel:
    """Order value by nation and month."""
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    date = F.col("o_orderdate").cast("date")
    month = (F.year(date) - 1992) * 12 + F.month(date) - 1
    joined = orders.select("o_custkey", month.cast("int").alias("time"), "o_totalprice").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    df = joined.groupBy("time", F.col("c_nationkey").cast("long").alias("unit")).agg(_cents("o_totalprice").alias("v"))
    return Panel.ingest(df).densify().filled()


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month_id, a_id, b_id): nations of one region, in every month with orders."""
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a_id"), "n_regionkey")
    other = nation.select(F.col("a_id").alias("b_id"), "n_regionkey")
    months = countries(spark, sf_dir).df.select(F.col("time").alias("month_id")).distinct()
    pairs = nation.join(other, "n_regionkey").where("a_id <> b_id").select("a_id", "b_id")
    return months.crossJoin(F.broadcast(pairs)).select("month_id", "a_id", "b_id")  # 25 nations


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month_id, a_id, b_id): nations whose numbers differ by 1 or 7, in every month with orders."""
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a_id"))
    months = countries(spark, sf_dir).df.select(F.col("time").alias("month_id")).distinct()
    steps = nation.select("a_id", F.explode(F.array(*(F.col("a_id") + k for k in (-7, -1, 1, 7)))).alias("b_id"))
    pairs = steps.join(nation.select(F.col("a_id").alias("b_id")), "b_id", "left_semi").select("a_id", "b_id")
    return months.crossJoin(F.broadcast(pairs)).select("month_id", "a_id", "b_id")  # 25 nations


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return _read(spark, sf_dir, "nation").select(key.alias("id"), (key % 5).cast("double").alias("lat"), F.floor(key / 5).cast("double").alias("lon"))
