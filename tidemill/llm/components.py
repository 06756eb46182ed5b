"""Connected components of an edge table by hooking to the least neighbour and contracting, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b); rounds grow with the logarithm of the
    longest path. Each round's tables are written, so a lost executor costs no earlier round."""
    labels = None
    edges = scratch(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        hook = scratch(hook, "hooks")
        for _ in range(2):
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(over, "up").select("node", F.col("top").alias("up"))
        hook = scratch(hook, "hooks")
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            up = hook.select(F.col("node").alias("component"), "up")
            labels = scratch(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        one, two = (hook.select(F.col("node").alias(c), F.col("up").alias("p" + c)) for c in "ab")
        edges = scratch(edges.join(one, "a").join(two, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
    return labels
