"""Scalar functions whose semantics differ from Spark's function of that name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(s: Column) -> Column:
    """Bytes, of strings and binaries alike."""
    return F.octet_length(s).cast("long")


def trim(s: Column) -> Column:
    """Any white space, not only spaces."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def concat(*parts: Column) -> Column:
    """Nulls are skipped, other types become strings."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def substring(s: Column, start, size) -> Column:
    """1-based; a start below 1 counts as 1, a negative size as 0."""
    start, size = (x if isinstance(x, Column) else F.lit(x) for x in (start, size))
    return F.substring(s, F.greatest(start, F.lit(1)), F.greatest(size, F.lit(0)))


def substring0(s: Column, start: int, size: int) -> Column:
    """0-based, as the builder's expressions count."""
    return substring(s, start + 1, size)


#: Parts of EXTRACT(part, timestamp), with Sunday as day 0.
EXTRACT = {
    "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
    "DOW": lambda c: F.dayofweek(c) - 1, "DOY": F.dayofyear, "WEEK": F.weekofyear, "QUARTER": F.quarter,
    "EPOCH": lambda c: F.unix_seconds(c.cast("timestamp")),
}


def extract(part: str, ts: Column) -> Column:
    return EXTRACT[part.upper()](ts).cast("long")


def divide(a: Column, b: Column) -> Column:
    """Whole numbers divide to a whole number; by zero gives null."""
    return F.try_divide(a, b).cast("long")


def round_binary(x: Column, digits: int) -> Column:
    """The double times 10^digits to the nearest whole number, halves away from 0, and back, as DuckDB rounds. Spark's round
    goes by the shortest decimal, so 9.768975, a little less in binary, becomes 9.76898 there and 9.76897 here."""
    scale = F.lit(10.0**digits)
    big = F.abs(x * scale) == F.lit(float("inf"))
    return F.when(big, x).otherwise(F.round(x * scale) / scale)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("long")


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts).cast("long")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def is_business_hours(ts: Column) -> Column:
    return (F.hour(ts) >= 9) & (F.hour(ts) < 17)


def normalise(x: Column, mean: float, deviation: float) -> Column:
    return (x - mean) / deviation if deviation else F.lit(0.0)


def min_max(x: Column, low: float, high: float) -> Column:
    return (x - low) / (high - low) if high != low else F.lit(0.0)


def time_partition(ts: Column, kind: str) -> Column:
    """Partition keys: hourly, daily, weekly (ISO), monthly, yearly."""
    if kind == "weekly":
        thursday = F.date_add(F.to_date(ts), 3 - F.weekday(ts))
        return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"hourly": "yyyy-MM-dd-HH", "daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "yearly": "yyyy"}[kind])


def mask_partial(s: Column) -> Column:
    """Addresses keep their first letter and domain, other texts their last four characters."""
    mail = F.concat(F.substring(s, 1, 1), F.lit("***"), F.regexp_extract(s, r"(@.*)$", 1))
    tail = F.when(F.length(s) > 4, F.concat(F.repeat(F.lit("*"), F.length(s) - 4), F.substring(s, -4, 4))).otherwise(F.repeat(F.lit("*"), F.length(s)))
    return F.when(s.contains("@"), mail).otherwise(tail)


def folded(s: Column) -> Column:
    """masked_ and 16 hex digits: the UTF-8 bytes folded by times 31 plus byte, modulo 2^64 (in two halves, as whole
    numbers here may not overflow)."""
    digits, n = F.hex(F.encode(s, "utf-8")), F.octet_length(s)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).when(n == 0, F.array().cast("array<int>"))
    half = F.lit(0xFFFFFFFF)

    def step(h: Column, i: Column) -> Column:
        low = h["low"] * 31 + F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        return F.struct((h["high"] * 31 + F.shiftright(low, 32)).bitwiseAND(half).alias("high"), low.bitwiseAND(half).alias("low"))

    zero = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    return F.aggregate(places, zero, step, lambda h: F.concat(F.lit("masked_"), text(h["high"]), text(h["low"])))


def hash31(s: Column) -> Column:
    """A text's UTF-8 bytes folded by times 31 plus byte, modulo 2^64, as a signed number."""
    return F.conv(F.substring(folded(s), 8, 16), 16, -10).cast("long")


def word_count(s: Column) -> Column:
    """Runs of other than white space."""
    return F.regexp_count(s, F.lit(r"\S+")).cast("long")
