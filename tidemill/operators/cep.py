"""Event patterns: begin, followed by, not followed by, within a time, strict or relaxed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Pattern:
    """Steps are (name, condition, negated). Relaxed: events that match nothing are passed over; strict: they end a match."""

    steps: list[tuple[str, Column, bool]] = field(default_factory=list)
    seconds: float | None = None
    strict: bool = False

    def begin(self, name: str, condition: Column) -> Pattern:
        self.steps = [(name, condition, False)]
        return self

    def followed_by(self, name: str, condition: Column) -> Pattern:
        self.steps.append((name, condition, False))
        return self

    def not_followed_by(self, name: str, condition: Column) -> Pattern:
        self.steps.append((name, condition, True))
        return self

    def within(self, seconds: float) -> Pattern:
        self.seconds = seconds
        return self

    def strictly(self) -> Pattern:
        self.strict = True
        return self


def match(df: DataFrame, pattern: Pattern, key: str, ts: str, ident: str) -> DataFrame:
    """key, match_start, match_end, ids (of the matched events in order).

    Every event that meets the first step begins a match, which goes on with the next event that meets its next step; an
    event that meets a negation before or at that one ends it. So the steps chain from the last to the first: each event
    of a step takes the match that begins at the nearest later event of the next step. That is one sort and a window
    function a step. With a time limit the time axis is cut into slots of eight limits, and the events that begin a slot
    are read with the slot before it too, so a busy key is spread over many tasks.
    """
    if not pattern.steps or pattern.steps[0][2] or pattern.steps[-1][2]:
        raise ValueError("a pattern begins and ends with a step that isn't negated")
    met = [F.coalesce(c, F.lit(False)) for _, c, _ in pattern.steps]
    rows = df.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(ident).alias("_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), *[m.alias(f"_f{k}") for k, m in enumerate(met)])
    if not pattern.strict:
        rows = rows.where(F.expr(" OR ".join(f"_f{k}" for k in range(len(met)))))
    if pattern.seconds is None:
        rows = rows.withColumn("_slot", F.lit(0)).withColumn("_own", F.lit(True))
    else:
        limit = max(int(pattern.seconds * 1e6), 1)
        own = F.floor(F.col("_us") / (8 * limit))
        slots = F.when(F.col("_us") - own * (8 * limit) <= limit, F.array(own, own - 1)).otherwise(F.array(own))
        rows = rows.withColumn("_slot", F.explode(slots)).withColumn("_own", F.col("_slot") == own)
    back = Window.partitionBy("_key", "_slot").orderBy(F.desc("_us"), F.desc("_id"))
    later = back.rowsBetween(Window.unboundedPreceding, -1)

    def nearest(c: Column) -> Column:
        return F.lag(c, 1).over(back) if pattern.strict else F.last(c, ignorenulls=True).over(later)

    place = lambda: (F.col("_us").alias("us"), F.col("_id").alias("id"), F.col("_ts").alias("end"))
    banned: list[int] = []
    rows = rows.withColumn("_m", F.when(F.col(f"_f{len(met) - 1}"), F.struct(*place(), F.array("_id").alias("ids"))))
    for k in range(len(met) - 2, -1, -1):
        if pattern.steps[k][2]:
            banned.append(k)
            continue
        ban = F.expr(" OR ".join(f"_f{b}" for b in banned)) if banned else F.lit(False)
        rows = rows.withColumn("_n", nearest(F.col("_m"))).withColumn("_b", nearest(F.when(ban, F.struct(F.col("_us").alias("us"), F.col("_id").alias("id")))))
        cut = F.coalesce(F.col("_b") <= F.struct(F.col("_n.us"), F.col("_n.id")), F.lit(False))
        ids = F.when(F.col("_n.ids").isNotNull() & ~cut, F.concat(F.array("_id"), F.col("_n.ids")))
        rows = rows.withColumn("_m", F.when(F.col(f"_f{k}"), F.struct(F.col("_us").alias("us"), F.col("_id").alias("id"), F.col("_n.end").alias("end"), ids.alias("ids"))))
        banned = []
    found = rows.where(F.col("_own") & F.col("_m.ids").isNotNull())
    found = found.select(F.col("_key").alias(key), F.col("_ts").alias("match_start"), (F.col("_m.end") if len(met) > 1 else F.col("_ts")).alias("match_end"), F.col("_m.ids").alias("ids"))
    if pattern.seconds is None:
        return found
    took = F.unix_micros(F.col("match_end").cast("timestamp")) - F.unix_micros(F.col("match_start").cast("timestamp"))
    return found.where(took <= int(pattern.seconds * 1e6))
