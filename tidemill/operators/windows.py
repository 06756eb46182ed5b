"""Event-time windows over batch or streaming frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bounds(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "_w"]
    return df.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *rest)


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], **aggs: Column) -> DataFrame:
    return _bounds(df.groupBy(F.window(ts, size).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]))


def hopping(df: DataFrame, ts: str, size: str, hop: str, keys: list[str], **aggs: Column) -> DataFrame:
    return _bounds(df.groupBy(F.window(ts, size, hop).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]))


def session(df: DataFrame, ts: str, gap: str, keys: list[str], **aggs: Column) -> DataFrame:
    return _bounds(df.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]))


def feature_session(df: DataFrame, ts: str, gap_seconds: float, keys: list[str], **aggs: Column) -> DataFrame:
    """A new session only if the distance is above the gap; a window ends at its last event."""
    w = Window.partitionBy(*keys).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(t - F.lag(t).over(w) > int(gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = df.withColumn("_n", new).withColumn("_s", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_s").agg(F.min(ts).alias("window_start"), F.max(ts).alias("window_end"), *[a.alias(n) for n, a in aggs.items()]).drop("_s")


def count_window(df: DataFrame, order: list[str], size: int, keys: list[str], **aggs: Column) -> DataFrame:
    """Every `size` rows of a key in order; the last window may hold fewer."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("window_no", F.floor((n - 1) / size).cast("long")).groupBy(*keys, "window_no").agg(*[a.alias(n) for n, a in aggs.items()])


def trailing(df: DataFrame, ts: str, seconds: int, keys: list[str], **aggs: Column) -> DataFrame:
    """Sliding per event: each row with aggregates over [t - seconds, t]."""
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumns({n: a.over(w) for n, a in aggs.items()}).drop("_t")


def sliding_exact(df: DataFrame, ts: str, keys: list[str], **aggs: Column) -> DataFrame:
    """One window per distinct event time."""
    return df.groupBy(ts, *keys).agg(*[a.alias(n) for n, a in aggs.items()])


def groups_frame(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, **aggs: Column) -> DataFrame:
    """GROUPS BETWEEN before PRECEDING AND after FOLLOWING: frames of whole peer groups, as ranges of the dense rank."""
    ranked = df.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy("_rank").rangeBetween(-before, after)
    return ranked.withColumns({n: a.over(w) for n, a in aggs.items()}).drop("_rank")


def whole(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """The global window: one for each key, over all its rows."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def capped_session(df: DataFrame, ts: str, gap_seconds: float, longest_seconds: float, key: str) -> DataFrame:
    """Sessions that also close when they would last longer than `longest_seconds`: key, session, start, end, events.

    A gap ends a session whatever came before it, so window functions cut a key's rows at its gaps. Where a session is cut
    for its length depends on where it began; only the rows between two gaps are read in order for that.
    """
    w = Window.partitionBy(key).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(t - F.lag(t).over(w) > int(gap_seconds * 1_000_000), 1).otherwise(0)
    parts = df.select(key, ts, new.alias("_new")).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        t = rows[ts].sort_values().to_numpy()
        out, begin, last, n = [], t[0], t[0], 0
        for x in t:
            if (x - begin) / pd.Timedelta(seconds=1) > longest_seconds:
                out.append((begin, last, n))
                begin, n = x, 0
            last, n = x, n + 1
        out.append((begin, last, n))
        return pd.DataFrame({key: rows[key].iloc[0], "window_start": [o[0] for o in out], "window_end": [o[1] for o in out], "events": [o[2] for o in out]})

    kind = dict(df.dtypes)
    spans = parts.groupBy(key, "_part").agg(F.min(ts).alias("window_start"), F.max(ts).alias("window_end"), F.count("*").alias("events"))
    long = F.unix_micros(F.col("window_end").cast("timestamp")) - F.unix_micros(F.col("window_start").cast("timestamp")) > int(longest_seconds * 1_000_000)
    over = parts.join(spans.where(long).select(key, "_part"), [key, "_part"], "left_semi")
    got = over.groupBy(key, "_part").applyInPandas(cut, f"{key} {kind[key]}, window_start {kind[ts]}, window_end {kind[ts]}, events long")
    got = got.unionByName(spans.where(~long).drop("_part"))
    number = (F.row_number().over(Window.partitionBy(key).orderBy("window_start")) - 1).cast("long")
    return got.select(key, number.alias("session"), "window_start", "window_end", "events")
