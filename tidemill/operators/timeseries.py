"""Series: filters, downsampling, rollups, time travel and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import NAMED, first_by, floor_rank, last_by


def metric_matches(metric: Column, wanted: str) -> Column:
    """A part of the name is enough; * is all."""
    return F.lit(True) if wanted == "*" else metric.contains(wanted)


def in_range(ts: Column, start, end) -> Column:
    """[start, end)"""
    return (ts >= F.lit(start)) & (ts < F.lit(end))


def bucket(ts: Column, seconds: int) -> Column:
    t = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(t / seconds) * seconds).cast("timestamp_ntz")


def aggregate(name: str, x: Column, order: Column) -> Column:
    if name in ("first", "last"):
        return (first_by if name == "first" else last_by)(x, order)
    if name.startswith("fp"):
        return floor_rank(x, int(name[2:]))
    return NAMED[name](x)


def downsample(df: DataFrame, ts: str, value: str, seconds: int, keys: list[str], *how: str) -> DataFrame:
    return df.groupBy(*keys, bucket(F.col(ts), seconds).alias("bucket")).agg(*[aggregate(h, F.col(value), F.col(ts)).alias(f"{value}_{h}") for h in how or ("avg",)])


def downsample_fields(df: DataFrame, ts: str, values: str, seconds: int, *how: str, order: str | None = None) -> DataFrame:
    """bucket, field, and a column for each aggregate: every field of a map column of values in each bucket."""
    rows = df.select(F.col(ts).alias("_ts"), F.col(order or ts).alias("_o"), F.explode(values).alias("field", "_v"))
    return rows.groupBy(bucket(F.col("_ts"), seconds).alias("bucket"), "field").agg(*[aggregate(h, F.col("_v"), F.col("_o")).alias(h) for h in how or ("avg",)])


def fields_map(df: DataFrame, *how: str) -> DataFrame:
    """bucket, values: what downsample_fields gives as one map a bucket, named field_aggregate."""
    pairs = F.array(*[F.struct(F.lower(F.concat("field", F.lit(f"_{h}"))).alias("k"), F.col(h).cast("double").alias("v")) for h in how])
    return df.groupBy("bucket").agg(F.map_from_entries(F.sort_array(F.flatten(F.collect_list(pairs)))).alias("values"))


def tag_filter(spec: tuple) -> Column:
    """A condition on (metric, tags, value): ("tag", k, v), ("tag_like", k, regex), ("has", k), ("metric", m),
    ("metric_like", regex), ("above", x), ("below", x), ("between", a, b), ("and", ...), ("or", ...), ("not", c)."""
    kind, *args = spec
    tags, value = F.col("tags"), F.col("value")
    if kind in ("and", "or"):
        out = tag_filter(args[0])
        for a in args[1:]:
            out = out & tag_filter(a) if kind == "and" else out | tag_filter(a)
        return out
    plain = {
        "not": lambda: ~F.coalesce(tag_filter(args[0]), F.lit(False)),
        "tag": lambda: F.coalesce(tags[args[0]] == args[1], F.lit(False)),
        "tag_like": lambda: F.coalesce(tags[args[0]].rlike(args[1]), F.lit(False)),
        "has": lambda: F.map_contains_key(tags, args[0]),
        "metric": lambda: F.col("metric") == args[0],
        "metric_like": lambda: F.col("metric").rlike(args[0]),
        "above": lambda: value > args[0],
        "below": lambda: value < args[0],
        "between": lambda: value.between(*args),
    }
    return plain[kind]()


def metrics(df: DataFrame) -> DataFrame:
    return df.select("metric").distinct()


def rollup(df: DataFrame, ts: str, value: str, levels: list[int], keys: list[str]) -> dict[int, DataFrame]:
    """Each level from the one below it, by sums and counts, so raw points are read once."""
    part = df.groupBy(*keys, bucket(F.col(ts), levels[0]).alias("bucket")).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"))
    out = {levels[0]: part}
    for level in levels[1:]:
        part = part.groupBy(*keys, bucket(F.col("bucket"), level).alias("bucket")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.min_by("first", "bucket").alias("first"), F.max_by("last", "bucket").alias("last"))
        out[level] = part
    return out


def latest(df: DataFrame, key: str, ts: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_r")).select(key, "_r.*")


def query_at(df: DataFrame, ts: str, at) -> DataFrame:
    return df.where(F.col(ts) <= F.lit(at))


def snapshot(df: DataFrame, keys: list[str], ts: str, at) -> DataFrame:
    """Latest row of each key at a time."""
    rest = [c for c in df.columns if c not in keys]
    return query_at(df, ts, at).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("_r")).select(*keys, "_r.*")


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and change: added, removed, modified or unchanged."""
    a = before.select(*keys, F.struct(*values).alias("_a"))
    b = after.select(*keys, F.struct(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))
