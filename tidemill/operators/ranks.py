"""Ranks and top values of groups of any size: values are counted before they meet, and only the top ones travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_ranks(df: DataFrame, keys: list[str], value: str, **places) -> DataFrame:
    """keys and a column for each place: the value at place(n) (from 0) of a group's n sorted values.

    Equal values are one row with a count, and a running count over the distinct values finds each place.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_v")
    ranked = counted.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    pick = lambda place: F.min(F.when(F.col("_upto") > place(F.col("_all")), F.col("_v")))
    return ranked.groupBy(*keys).agg(*[pick(p).alias(n) for n, p in places.items()])


def nearest(share: float):
    """round(share * (n - 1)), halves up."""
    return lambda n: F.floor((n - 1) * F.lit(share) + 0.5)


def floored(percent: float):
    """floor(percent / 100 * n), at most the last."""
    return lambda n: F.least(F.floor(n * F.lit(float(percent)) / 100), n - 1)


def top(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The k first rows of each group; a task keeps its own k first before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, sum, avg, min, max, stddev (of the population), p50, p95, p99 by nearest rank."""
    v = F.col(value).try_cast("double")
    plain = df.groupBy(*keys).agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stddev"))
    return plain.join(at_ranks(df, keys, value, p50=nearest(0.5), p95=nearest(0.95), p99=nearest(0.99)), keys, "left")


def value_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: how often each value occurs."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))
