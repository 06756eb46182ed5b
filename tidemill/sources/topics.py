"""Reading logs: by offset, time, committed mark, pattern or JSON path."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def records(df: DataFrame, offset: str, ts: str, key: str, value: Column, partitions: int = 4) -> DataFrame:
    """A table as a log: offset, timestamp, key, value, partition."""
    return df.select(F.col(offset).alias("offset"), F.col(ts).alias("timestamp"), F.col(key).cast("string").alias("key"), value.alias("value"), F.pmod(F.col(key), F.lit(partitions)).cast("int").alias("partition"))


def by_offset(df: DataFrame, start: int, most: int | None = None) -> DataFrame:
    out = df.where(F.col("offset") >= start)
    return out.orderBy("offset").limit(most) if most is not None else out


def committed(df: DataFrame, stable: int) -> DataFrame:
    return df.where(F.col("offset") < stable)


def alive(df: DataFrame, ttl_seconds: int, now) -> DataFrame:
    return df.where(F.col("timestamp") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > F.lit(now))


def bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("partition").agg(F.min("offset").alias("earliest"), F.max("offset").alias("latest"))


def offset_at(df: DataFrame, ts) -> DataFrame:
    return df.where(F.col("timestamp") >= F.lit(ts)).groupBy("partition").agg(F.min("offset").alias("offset"))


def grep(df: DataFrame, pattern: str, invert: bool = False, ignore_case: bool = False, column: str = "value") -> DataFrame:
    hit = F.col(column).rlike(("(?i)" if ignore_case else "") + pattern)
    return df.where(~hit if invert else hit)


def pick(df: DataFrame, path: str) -> DataFrame:
    return df.withColumn("value", F.get_json_object("value", path))


def search(df: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """Case-insensitive part of the value; limits outside 1 to 1000 are moved there."""
    return df.where(F.contains(F.lower("value"), F.lit(text.lower()))).orderBy("offset").limit(min(max(limit, 1), 1000))


def sample(df: DataFrame, percent: float, seed: int = 0, by: str = "offset") -> DataFrame:
    """Each record with a chance of `percent` in a hundred, by a hash of a column and the seed: the same ones whatever the
    partitions are."""
    return df.where(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string"))), 1, 8), 16, 10).cast("long") % 10_000 < percent * 100)


def first(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("partition", "offset").limit(n)


#: Named projections of a log, after which only these columns are read.
PROJECTIONS = {"all": ("offset", "timestamp", "key", "value", "headers"), "metadata_only": ("offset", "timestamp"), "minimal": ("offset", "timestamp", "value")}


def project(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in PROJECTIONS[name] if c in df.columns])


def stats(df: DataFrame, start, end, seconds: float) -> DataFrame:
    n = df.where((F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(end))).agg(F.count("*").alias("messages"))
    return n.withColumn("rate", F.col("messages") / seconds)


def columnar(spark: SparkSession, path: str, start, end, columns: list[str], ts: str = "timestamp", limit: int | None = None) -> DataFrame:
    """Projection and an inclusive time range, both of which reach the Parquet scan."""
    rows = spark.read.parquet(path).where(F.col(ts).between(F.lit(start), F.lit(end))).select(*columns)
    return rows if limit is None else rows.orderBy(columns[0]).limit(limit)


#: Seconds of the units in relative times.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def time_point(text: str, now: dt.datetime) -> dt.datetime:
    """now, today, yesterday, 5m or -5m (ago), epoch seconds or milliseconds, or an ISO date or time."""
    text = text.strip()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if text in (named := {"now": now, "latest": now, "today": midnight, "yesterday": midnight - dt.timedelta(days=1), "earliest": dt.datetime(1970, 1, 1)}):
        return named[text]
    if m := re.fullmatch(r"-?(\d+)([smhdw])", text):
        return now - dt.timedelta(seconds=int(m[1]) * SECONDS[m[2]])
    if text.isdigit():
        n = int(text)
        return dt.datetime(1970, 1, 1) + (dt.timedelta(milliseconds=n) if n >= 10**11 else dt.timedelta(seconds=n))
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
