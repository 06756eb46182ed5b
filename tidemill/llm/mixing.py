"""Mixes sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """src, source, source_size, target of a table with one row a source (src orders them).

    Targets share the whole size by weight. No target passes `cap` times its source's size; what is over goes to the
    others by weight. Sources are sorted by the level at which they fill, so the level that holds for the rest is the
    first one below its own source's: one pass, no rounds.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(Window.orderBy("src")))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size").cast("double") * cap)
        .withColumn("fills", F.col("most") / F.col("weight"))
    )
    every, before = Window.partitionBy(), Window.orderBy("fills", "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "src", "level"))).over(every)["level"])
    return found.select("src", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def copies(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, seed: str = "mix", block: int = 4_000) -> DataFrame:
    """doc_id, size, source_size, target, copies: a row for each document.

    Documents of a source all expect target / source_size copies, so the prefix sum after the k-th of them is k times
    that, exactly. They stand in the order of size (then doc_id), which holds the words taken near the target. A hashed
    offset of the source shifts the sums; a document is emitted once for each whole number that its interval crosses.

    The order of (source, size, doc_id) is cut into ranges of about `block` rows, within one size too; the ranges' counts
    give each range's first place, so a hot source is spread over many tasks and every place is that of the whole order.

    Null or blank text: size 0. Null source: a source of its own, last. Null doc_id: last of its size. Repeated rows: a
    place each. No rows: no rows.
    """
    thin = docs.select(
        F.col("doc_id").alias("id"),
        F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name")).alias("src"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    thin = scratch(thin.withColumn("row", F.monotonically_increasing_id()), "mix")
    order = ["size", F.asc_nulls_last("id"), "row"]  # row: so that a range can end among repeated rows
    ranges = max(partitions(docs.sparkSession), 1 + thin.count() // block)
    thin = scratch(thin.repartitionByRange(ranges, "src", *order).withColumn("block", F.spark_partition_id()), "mix-ranges")
    blocks = thin.groupBy("src", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("src").agg(F.sum("words").alias("source_size")), weights, cap)
    before = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("src", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")).join(goal, "src")
    placed = thin.withColumn("n", F.row_number().over(Window.partitionBy("src", "block").orderBy(*order))).join(first, ["src", "block"])
    name = F.when(F.col("src.none"), F.lit(f"{seed}|null")).otherwise(F.concat(F.lit(f"{seed}:"), F.col("src.name")))
    offset = (F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("double") + 0.5) / 65536
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = (F.col("first") + F.col("n")).cast("double")
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as `copies` says, with its columns."""
    held = scratch(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")), "mix-docs")
    rows = held.select(F.struct(F.col("doc.doc_id").isNull().alias("none"), "doc.doc_id", "_row").alias("doc_id"), "doc.source", "doc.text")
    times = copies(rows, **options).where("copies > 0").select(F.col("doc_id._row").alias("_row"), F.col("copies").cast("int").alias("_copies"))
    return held.join(times, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc.*")


def taken(docs: DataFrame, **options) -> DataFrame:
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size::DOUBLE * 3 AS most FROM s),
f AS (SELECT *, most / weight AS fills FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM f WINDOW b AS (ORDER BY fills, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, (SELECT first(level ORDER BY fills, place) FROM l WHERE level <= fills) * weight) AS target,
      (('0x' || substr(md5(coalesce('mix:' || source, 'mix|null')), 1, 4))::BIGINT::DOUBLE + 0.5) / 65536 AS shift FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id)::DOUBLE AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(k * rate + shift) - floor((k - 1) * rate + shift) AS BIGINT) AS taken FROM p
"""
