"""Materialised views: versions on storage, refreshed in order of dependency, and incremental aggregates."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class View:
    """A view of one frame: filter, group, aggregate, order, limit."""

    def __init__(self, source: str) -> None:
        self.source, self.tests, self.keys, self.aggs, self.sort, self.most = source, [], [], {}, [], None

    def where(self, condition: Column | str) -> View:
        self.tests.append(condition)
        return self

    def group_by(self, *keys: str) -> View:
        self.keys += keys
        return self

    def aggregate(self, **aggs: Column) -> View:
        self.aggs |= aggs
        return self

    def order_by(self, *columns: Column | str) -> View:
        self.sort += columns
        return self

    def limit(self, n: int) -> View:
        self.most = n
        return self

    def build(self, frames: dict[str, DataFrame]) -> DataFrame:
        df = frames[self.source]
        for t in self.tests:
            df = df.where(t)
        if self.keys or self.aggs:
            aggs = [c.alias(n) for n, c in self.aggs.items()]
            df = df.groupBy(*self.keys).agg(*aggs) if aggs else df.select(*self.keys).distinct()
        df = df.orderBy(*self.sort) if self.sort else df
        return df if self.most is None else df.limit(self.most)


class Views:
    """Views over sources and each other, written below `root` as root/name/version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.sources, self.views, self.depends, self.versions = spark, root.rstrip("/"), {}, {}, {}, {}

    def source(self, name: str, df: DataFrame) -> None:
        self.sources[name] = df

    def define(self, name: str, build: View | Callable[[dict[str, DataFrame]], DataFrame], depends: list[str] | None = None) -> None:
        self.views[name] = build.build if isinstance(build, View) else build
        self.depends[name] = [build.source] if isinstance(build, View) else list(depends or [])

    def order(self) -> list[str]:
        """Views, each after those it reads; raises graphlib.CycleError on a cycle."""
        return [n for n in TopologicalSorter(self.depends).static_order() if n in self.views]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{version or self.versions[name]}")

    def refresh(self, *names: str) -> dict[str, int]:
        """Writes a new version of the views named (all if none) and of what they read; readers of older ones go on."""
        wanted, todo = set(), list(names or self.views)
        while todo:
            n = todo.pop()
            if n in self.views and n not in wanted:
                wanted.add(n)
                todo += self.depends[n]
        for n in self.order():
            if n in wanted:
                frames = {x: self.sources[x] if x in self.sources else self.read(x) for x in self.depends[n]}
                version = self.versions.get(n, 0) + 1
                self.views[n](frames).write.mode("overwrite").parquet(f"{self.root}/{n}/{version}")
                self.versions[n] = version
        return dict(self.versions)


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, total: state that apply_deltas() keeps up to date."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def apply_deltas(state: DataFrame, changes: DataFrame, keys: list[str], value: str, sign: str = "sign") -> DataFrame:
    """State after changes with sign 1 (insert) or -1 (delete); an update is one of each. Keys without rows go.

    Only the changes are aggregated, before they meet the state: work grows with the changes, not with the history.
    """
    delta = changes.groupBy(*keys).agg(F.sum(sign).alias("n"), F.sum(F.col(value) * F.col(sign)).alias("total"))
    both = state.select(*keys, "n", "total").unionByName(delta)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: how often each value occurs, from which every aggregate follows after deletes too."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def apply_value_deltas(state: DataFrame, changes: DataFrame, keys: list[str], value: str, sign: str = "sign") -> DataFrame:
    """counted_values() after changes with sign 1 or -1; values that no row has any more go."""
    delta = changes.groupBy(*keys, value).agg(F.sum(sign).alias("n"))
    return state.select(*keys, value, "n").unionByName(delta).groupBy(*keys, value).agg(F.sum("n").alias("n")).where("n > 0")


def summed(state: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, total, mean, least, most of a state of counted values."""
    n, x = F.col("n"), F.col(value)
    return state.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * x).alias("total"), (F.sum(n * x) / F.sum(n)).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"))


def change_feed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change, and the columns after it (before it for deletes): what a refresh of a view did to its rows."""
    rest = [c for c in after.columns if c not in keys]
    a, b = before.select(*keys, F.struct(*rest).alias("_a")), after.select(*keys, F.struct(*rest).alias("_b"))
    change = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return a.join(b, keys, "full").withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", F.coalesce("_b", "_a").alias("_r")).select(*keys, "change", "_r.*")
