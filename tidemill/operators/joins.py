"""Joins that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def interval(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], lt: str, rt: str, lower_s: float, upper_s: float) -> DataFrame:
    """Pairs with equal keys and lower <= left time - right time <= upper.

    The time axis is cut into slots as wide as the bounds' distance; a right row is sent to the one or two slots that
    can match, so the join has an equal key and a hot key is spread along time.
    """
    low, high = int(lower_s * 1e6), int(upper_s * 1e6)
    wide = max(high - low, 1)
    a = left.withColumn("_slot", F.floor(micros(lt) / wide))
    b = right.withColumn("_slot", F.explode(F.sequence(F.floor((micros(rt) + low) / wide), F.floor((micros(rt) + high) / wide))))
    on = [a[l] == b[r] for l, r in keys] + [a["_slot"] == b["_slot"]]
    joined = a.join(b, on).drop(a["_slot"]).drop(b["_slot"])
    return joined.where((micros(lt) - micros(rt)).between(low, high))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, sequence: str | None = None, how: str = "left", prefix: str = "table_") -> DataFrame:
    """Each left row with the latest right row of its key at or before its time; of equal times the later in sequence.

    Both sides are united and carried forward in one sorted pass: one shuffle on the keys, and no pairs are made. Null keys
    and null times match nothing.
    """
    right = right.dropna(subset=[*keys, rt])
    values = [c for c in right.columns if c not in keys]
    order = [F.col("_t"), F.col("_side")] + ([F.col("_q")] if sequence else [])
    a = left.select(*keys, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values).alias("x")).schema["x"].dataType).alias("_val"), F.col(lt).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_q"))
    b = right.select(*keys, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_val"), F.col(rt).alias("_t"), F.lit(0).alias("_side"), (F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")).alias("_q"))
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b).withColumn("_val", F.last("_val", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    if how == "inner":
        got = got.where(F.col("_val").isNotNull())
    return got.select("_row.*", *[F.col(f"_val.{c}").alias(prefix + c) for c in values])


def point_in_time(probes: DataFrame, feature_tables: dict[str, DataFrame], entity: str, at: str, time: str = "ts") -> DataFrame:
    """Probes with the latest features at or before each time, from several tables; missing ones are null."""
    out = probes
    for name, table in feature_tables.items():
        kept = out.columns
        got = as_of(out, table, [entity], at, time, prefix=f"{name}_")
        out = got.select(*kept, *[c for c in got.columns if c not in kept and c != f"{name}_{time}"])
    return out


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


class Join:
    """Builder: Join(left).with_(right).on("k").within(60).type("left").build()."""

    def __init__(self, left: DataFrame) -> None:
        self.left, self.right, self.keys, self.how, self.window, self.rename = left, None, [], "inner", None, False

    def with_(self, right: DataFrame) -> Join:
        self.right = right
        return self

    def on(self, *keys) -> Join:
        self.keys += [k if isinstance(k, tuple) else (k, k) for k in keys]
        return self

    def type(self, how: str) -> Join:
        self.how = how
        return self

    def within(self, lt: str, rt: str, seconds: float) -> Join:
        self.window = (lt, rt, seconds)
        return self

    def prefixed(self) -> Join:
        self.rename = True
        return self

    def build(self) -> DataFrame:
        a, b = (prefixed(self.left, "left_"), prefixed(self.right, "right_")) if self.rename else (self.left, self.right)
        pre = ("left_", "right_") if self.rename else ("", "")
        keys = [(pre[0] + l, pre[1] + r) for l, r in self.keys]
        if self.window:
            lt, rt, s = self.window
            return interval(a, b, keys, pre[0] + lt, pre[1] + rt, -s, s)
        cond = None
        for l, r in keys:
            cond = (a[l] == b[r]) if cond is None else cond & (a[l] == b[r])
        return a.join(b, cond, self.how)
