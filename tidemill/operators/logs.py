"""Operations on topic logs: compaction, retention, lag, skew, dead letters, duplicates, conflicts, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def compact(df: DataFrame, key: str, offset: str, tombstone: Column | None = None) -> DataFrame:
    """Last record of each key (keyless records stay); tombstones go if a condition names them.

    max_by aggregates before the shuffle, so a hot key sends one row a task.
    """
    rest = [c for c in df.columns if c != key]
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(offset)).alias("_r")).select(key, "_r.*").select(*df.columns)
    out = last.unionByName(df.where(F.col(key).isNull()))
    return out.where(~tombstone) if tombstone is not None else out


def retain_time(df: DataFrame, ts: str, oldest) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(oldest))


def retain_bytes(df: DataFrame, partition: str, offset: str, size: Column, limit: int) -> DataFrame:
    """Newest records of each partition whose running size stays within the limit."""
    w = Window.partitionBy(partition).orderBy(F.desc(offset)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= limit).drop("_sum")


def lag(latest: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    return latest.join(committed, keys, "left").withColumn("lag", F.greatest(F.col("latest") - F.coalesce("committed", F.lit(0)), F.lit(0)))


def skew(df: DataFrame, partition: str) -> DataFrame:
    """One row: partitions, mean, cv, severity by the coefficient of variation."""
    sizes = df.groupBy(partition).agg(F.count("*").alias("n"))
    cv = F.coalesce(F.stddev_pop("n") / F.avg("n"), F.lit(0.0))
    severity = F.when(F.col("cv") < 0.2, "none").when(F.col("cv") < 0.5, "low").when(F.col("cv") < 1.0, "moderate").when(F.col("cv") < 1.5, "high").otherwise("critical")
    return sizes.agg(F.count("*").alias("partitions"), F.avg("n").alias("mean"), cv.alias("cv")).withColumn("severity", severity)


def dead_letters(df: DataFrame, ok: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """What passes, and the rest with the reason; a null condition fails."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good).withColumn("dlq_reason", F.lit(reason))


def first_of_sequence(df: DataFrame, producer: str, sequence: str, offset: str) -> DataFrame:
    """Idempotent producers: of equal (producer, sequence) the first in the log."""
    rest = [c for c in df.columns if c not in (producer, sequence)]
    return df.groupBy(producer, sequence).agg(F.min_by(F.struct(*rest), F.col(offset)).alias("_r")).select(producer, sequence, "_r.*")


def resolve(a: DataFrame, b: DataFrame, key: str, by: str) -> DataFrame:
    """Conflicts between two sites: the greater `by` wins (time or offset), the first site on ties."""
    both = a.withColumn("_site", F.lit(1)).unionByName(b.withColumn("_site", F.lit(0)))
    rest = [c for c in a.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(by), F.col("_site"))).alias("_r")).select(key, "_r.*")


def forget(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Deletes all records of the given keys."""
    return df.join(keys, key, "left_anti")


def contract(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, violations: counts of rows for which a condition is false or null, in one pass."""
    one = df.agg(*[F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).cast("long").alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("x")).select("x.*")


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(spark: SparkSession, edges: DataFrame, start: str, upstream: bool = False, few: int = 100_000) -> DataFrame:
    """Nodes reachable from start along (src, dst), or against them (upstream), with their least distance.

    Each round joins the edges with the nodes found last and leaves out what is known, so cycles end and each node is
    looked at once; rounds are as many as the longest least distance. Up to `few` edges (counted first) are walked in the
    driver, with the same result.
    """
    one, two = ("dst", "src") if upstream else ("src", "dst")
    links = edges.select(F.col(one).alias("node"), F.col(two).alias("next")).dropna()
    schema = f"node {dict(links.dtypes)['node']}, depth int"
    if len(held := links.limit(few + 1).collect()) <= few:
        ahead, depths, last = {}, {start: 0}, [start]
        for r in held:
            ahead.setdefault(r["node"], []).append(r["next"])
        while last:
            found = dict.fromkeys(n for x in last for n in ahead.get(x, ()) if n not in depths)
            depths |= {n: depths[last[0]] + 1 for n in found}
            last = list(found)
        return spark.createDataFrame(list(depths.items()), schema)
    known = spark.createDataFrame([(start, 0)], schema)
    last, depth = known, 0
    while not last.isEmpty():
        depth += 1
        found = links.join(last.select("node"), "node").select(F.col("next").alias("node")).distinct()
        last = written(found.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)), "closure")
        known = written(known.unionByName(last), "closure")
    return known


def paths(edges: DataFrame, start: str, end: str, longest: int = 16) -> DataFrame:
    """path: the ways from start to end that meet no node twice, of at most `longest` edges."""
    links = edges.select("src", "dst").dropna().distinct()
    ways = links.where(F.col("src") == F.lit(start)).select(F.array("src", "dst").alias("path"))
    out = ways.where(F.element_at("path", -1) == F.lit(end))
    for _ in range(longest - 1):
        open_ = ways.where(F.element_at("path", -1) != F.lit(end))
        ways = written(open_.join(links, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")), "paths")
        if ways.isEmpty():
            break
        out = out.unionByName(ways.where(F.element_at("path", -1) == F.lit(end)))
    return out


#: The least number of affected nodes of each level.
IMPACT = ((10, "critical"), (5, "high"), (2, "medium"), (1, "low"))


def impact(spark: SparkSession, edges: DataFrame, start: str) -> DataFrame:
    """One row: direct and transitive consumers of a node, and the level that their number has."""
    found = closure(spark, edges, start).where("depth > 0").agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count(F.when(F.col("depth") > 1, 1)).alias("transitive"))
    level = F.lit("none")
    for least, name in reversed(IMPACT):
        level = F.when(F.col("direct") + F.col("transitive") >= least, name).otherwise(level)
    return found.withColumn("level", level)


def search_catalog(entries: DataFrame, text: str, *columns: str) -> DataFrame:
    """Entries with the text in any of the columns, in any case; array columns count by their elements."""
    kinds, wanted = dict(entries.dtypes), F.lit(text.lower())
    hit = F.lit(False)
    for c in columns:
        value = F.concat_ws("\n", c) if kinds[c].startswith("array") else F.col(c).cast("string")
        hit = hit | F.coalesce(F.contains(F.lower(value), wanted), F.lit(False))
    return entries.where(hit)


def pn_counter(df: DataFrame, item: str, node: str, added: str, taken: str) -> DataFrame:
    """Merged counters that go both ways: the greatest sum of each node and direction, added less taken."""
    each = df.groupBy(item, node).agg(F.max(added).alias("a"), F.max(taken).alias("t"))
    return each.groupBy(item).agg((F.sum("a") - F.sum("t")).alias("value"))


def sequence(elements: DataFrame, document: str, ident: str, after: str, value: str, deleted: str) -> DataFrame:
    """document, value, place of a merged sequence: an element stands after the one it was put behind, the later put (the
    greater id) nearer; deleted anywhere is deleted, but holds its place for others.

    Each round hangs on the elements whose predecessor is placed; a place is the path of negated ids from the start.
    """
    merged = written(elements.groupBy(document, ident).agg(F.first(after).alias("_after"), F.first(value).alias(value), F.max(deleted).alias("_gone")), "sequence")
    placed = written(merged.where("_after IS NULL").select(document, ident, value, "_gone", F.array(-F.col(ident)).alias("_path")), "sequence")
    every, last = placed, placed
    while not last.isEmpty():
        ahead = last.select(document, F.col(ident).alias("_after"), F.col("_path").alias("_way"))
        last = written(merged.join(ahead, [document, "_after"]).select(document, ident, value, "_gone", F.concat("_way", F.array(-F.col(ident))).alias("_path")), "sequence")
        every = every.unionByName(last)
    w = Window.partitionBy(document).orderBy("_path")
    return every.where(~F.col("_gone")).withColumn("place", F.row_number().over(w)).select(document, value, "place")


def lag_stats(lags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, partitions, lagging, total_lag, max_lag, min_lag, avg_lag."""
    x = F.col("lag")
    return lags.groupBy(*keys).agg(F.count("*").alias("partitions"), F.count(F.when(x > 0, 1)).alias("lagging"), F.sum(x).alias("total_lag"), F.max(x).alias("max_lag"), F.min(x).alias("min_lag"), F.avg(x).alias("avg_lag"))


def retry_at(letters: DataFrame, failed_at: str, attempts: str, first_seconds: float = 1.0, factor: float = 2.0, most_seconds: float = 3600.0) -> DataFrame:
    """Adds retry_at: the wait grows by the factor with each attempt, up to a limit."""
    wait = F.least(F.lit(first_seconds) * F.pow(F.lit(factor), F.col(attempts)), F.lit(most_seconds))
    return letters.withColumn("retry_at", F.col(failed_at) + F.make_dt_interval(secs=wait))


def replay(letters: DataFrame, reason: str | None = None, most_attempts: int | None = None, attempts: str = "attempts") -> DataFrame:
    """Dead letters to send again, without what the queue added: those of a reason, tried fewer than most_attempts times."""
    out = letters if reason is None else letters.where(F.col("dlq_reason") == reason)
    out = out if most_attempts is None else out.where(F.col(attempts) < most_attempts)
    return out.drop(*[c for c in out.columns if c.startswith("dlq_")], attempts)


def letter_stats(letters: DataFrame, ts: str) -> DataFrame:
    return letters.groupBy("dlq_reason").agg(F.count("*").alias("letters"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def out_of_order(df: DataFrame, field: str, key: str | None, order: str) -> Column:
    """Whether a row's field is under that of the row before it in the log; false where either is null."""
    w = Window.partitionBy(*([key] if key else [])).orderBy(order)
    return F.coalesce(F.col(field) < F.lag(field).over(w), F.lit(False))


def ordering_violations(df: DataFrame, field: str, key: str, order: str) -> DataFrame:
    return df.withColumn("_bad", out_of_order(df, field, key, order)).agg(F.count(F.when(F.col("_bad"), 1)).alias("violations"))


def uniqueness_violations(df: DataFrame, *fields: str) -> DataFrame:
    """Rows beyond the first of each value."""
    return df.dropna(subset=list(fields)).groupBy(*fields).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def resolve_by(a: DataFrame, b: DataFrame, key: str, rule) -> DataFrame:
    """Conflicts between two sites by a rule of one's own: rule(left struct, right struct) is whether the left one wins."""
    rest = [c for c in a.columns if c != key]
    both = a.select(key, F.struct(*rest).alias("_a")).join(b.select(key, F.struct(*rest).alias("_b")), key, "full")
    win = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(rule(F.col("_a"), F.col("_b")), F.col("_a")).otherwise(F.col("_b"))
    return both.select(key, win.alias("_r")).select(key, "_r.*")


def features_as_of(timeline: DataFrame, entity: str, feature: str, value: str, ts: str, at=None, ttl_seconds: float | None = None) -> DataFrame:
    """entity, feature, value: the latest value of each feature, at a time if one is given; values older than the time
    limit before it count no more."""
    rows = timeline if at is None else timeline.where(F.col(ts) <= F.lit(at))
    if ttl_seconds is not None:
        rows = rows.where(F.col(ts) >= F.lit(at) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return rows.groupBy(entity, feature).agg(F.max_by(value, ts).alias(value))


def g_counter(df: DataFrame, item: str, node: str, value: str) -> DataFrame:
    """Merged grow-only counters: greatest value of each node, summed."""
    return df.groupBy(item, node).agg(F.max(value).alias("v")).groupBy(item).agg(F.sum("v").alias("value"))


def lww(df: DataFrame, item: str, value: str, ts: str, tie: str) -> DataFrame:
    return df.groupBy(item).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def or_set(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Elements with a tag that wasn't removed: (element, tag) minus tombstones."""
    return adds.join(removes, ["element", "tag"], "left_anti").select("element").distinct()
