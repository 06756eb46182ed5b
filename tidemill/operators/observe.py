"""Traces, log queries, moving averages and least-squares fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Log levels by severity.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def traces(spans: DataFrame, trace: str, span: str, parent: str, start: str, end: str) -> DataFrame:
    """trace, spans, root_span, started, ended, duration_ms: the root is the first span without a parent, and its length
    the trace's (null without a root). Aggregates combine before the shuffle."""
    root = F.min(F.when(F.col(parent).isNull(), F.struct(F.col(start).alias("s"), F.col(span).alias("id"), F.col(end).alias("e"))))
    out = spans.groupBy(F.col(trace).alias("trace_id")).agg(F.count("*").alias("spans"), root.alias("r"), F.min(start).alias("started"), F.max(end).alias("ended"))
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    return out.select("trace_id", "spans", F.col("r.id").alias("root_span"), "started", "ended", (millis(F.col("r.e")) - millis(F.col("r.s"))).alias("duration_ms"))


def children(spans: DataFrame, parent: str, of) -> DataFrame:
    return spans.where(F.col(parent) == F.lit(of))


def severity(level: Column) -> Column:
    """Rank of a level's name; null for other names."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.upper(level))
    return F.when(rank > 0, rank)


def log_query(logs: DataFrame, least: str | None = None, start=None, end=None, contains: str | None = None, attributes: dict[str, str] | None = None, trace: str | None = None) -> DataFrame:
    """Rows of (ts, level, body, attributes, trace_id) that pass every condition given: start <= ts <= end, level at
    least as severe. Plain conditions, so they reach the scan."""
    tests = []
    if least:
        tests.append(severity(F.col("level")) >= LEVELS.index(least.upper()) + 1)
    if start is not None:
        tests.append(F.col("ts") >= F.lit(start))
    if end is not None:
        tests.append(F.col("ts") <= F.lit(end))
    if contains:
        tests.append(F.col("body").contains(contains))
    tests += [F.col("attributes")[k] == v for k, v in (attributes or {}).items()]
    if trace:
        tests.append(F.col("trace_id") == trace)
    for t in tests:
        logs = logs.where(t)
    return logs


def count_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count("*").alias("n"))


def recent(logs: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The n newest; a task sends n rows at most."""
    return logs.orderBy(F.desc(ts)).limit(n)


def counter(points: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """keys, increase: what a counter grew by; a value under the one before it is a restart from 0."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before = F.lag(value).over(w)
    grown = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    return points.withColumn("_g", grown).groupBy(*keys).agg(F.sum("_g").alias("increase"))


def gauge(points: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """keys, value: the latest."""
    return points.groupBy(*keys).agg(F.max_by(value, ts).alias("value"))


#: Rules on one metric's value: whether it is met.
RULES = {
    "above": lambda v, x: v > x, "below": lambda v, x: v < x, "changes": lambda v, x: F.abs(v) > x,
    "lag": lambda v, x: v > x, "size": lambda v, x: v > x, "errors": lambda v, x: v > x, "custom": lambda v, x: v > 0,
}


def rule_alerts(samples: DataFrame, rules: list[tuple[str, str, str, float]], ts: str, cooldown_seconds: float = 0) -> DataFrame:
    """rule, started, value: samples (metric, value) that meet a rule (name, kind, metric, limit) when the sample before
    didn't, or when the rule last fired `cooldown_seconds` or more ago; one alert a rule is active at a time."""
    met = F.array(*[F.when((F.col("metric") == m) & RULES[k](F.col("value"), x), F.lit(n)) for n, k, m, x in rules])
    all_ = F.array(*[F.when(F.col("metric") == m, F.lit(n)) for n, _, m, _ in rules])
    rows = samples.select(ts, "value", F.explode(F.array_compact(all_)).alias("rule"), met.alias("_met")).withColumn("_on", F.array_contains(F.array_compact("_met"), F.col("rule")))
    w = Window.partitionBy("rule").orderBy(ts)
    begun = rows.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False))).where("_on AND NOT _was")
    last = F.lag(ts).over(w)
    quiet = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(last.cast("timestamp")) >= cooldown_seconds
    return begun.withColumn("_quiet", F.coalesce(quiet, F.lit(True))).where("_quiet").select("rule", F.col(ts).alias("started"), "value")


def moving_average(df: DataFrame, key: str, order: list[str], value: str, window: int) -> DataFrame:
    """Adds `average` of a row's value and the window - 1 before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    return df.withColumn("average", F.avg(value).over(w))


def polynomial(df: DataFrame, x: Column, y: Column, degree: int = 1) -> list[float]:
    """Least-squares coefficients, constant first; null pairs don't count.

    One pass sums the powers, one row returns. x is centred and scaled by its mean and deviation first, so that high powers
    stay small.
    """
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).dropna()
    mean, scale = rows.agg(F.avg("x"), F.stddev_pop("x")).first()
    if mean is None:
        raise ValueError("no rows to fit")
    scale = scale or 1.0
    z = (F.col("x") - mean) / scale
    sums = rows.agg(*[F.sum(F.pow(z, F.lit(float(i)))).alias(f"p{i}") for i in range(2 * degree + 1)], *[F.sum(F.pow(z, F.lit(float(i))) * F.col("y")).alias(f"q{i}") for i in range(degree + 1)]).first()
    a = np.array([[sums[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    fitted = np.linalg.lstsq(a, np.array([sums[f"q{i}"] for i in range(degree + 1)]), rcond=None)[0]
    line = np.polynomial.Polynomial(fitted)(np.polynomial.Polynomial([-mean / scale, 1 / scale]))
    return [float(c) for c in line.coef] + [0.0] * (degree + 1 - len(line.coef))
