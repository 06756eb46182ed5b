"""Writing: partitioned Parquet, exports, compaction, and foreachBatch sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avro

#: Partition names and how they cut time.
PERIODS = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}


def partitioned(df: DataFrame, path: str, ts: str, period: str, mode: str = "append") -> None:
    """Rows are gathered by period before the write, so a task doesn't open a file of every period; AQE splits a period
    that holds much of the rows over tasks."""
    key = F.date_format(ts, PERIODS[period])
    df.withColumn("period", key).hint("rebalance", "period").write.mode(mode).option("compression", "zstd").partitionBy("period").parquet(path)


def segments(df: DataFrame, path: str, row_group_bytes: int = 64 << 20, codec: str = "zstd", dictionary: bool = True, bloom: tuple[str, ...] = (), mode: str = "append") -> None:
    """Parquet with its row-group size, codec, dictionaries, and bloom filters of the columns named; statistics are
    always there."""
    out = df.write.mode(mode).option("compression", codec).option("parquet.block.size", row_group_bytes).option("parquet.enable.dictionary", str(dictionary).lower())
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def topic_store(df: DataFrame, path: str, codec: str = "snappy", mode: str = "append") -> None:
    """Records in a folder for each topic and partition."""
    df.hint("rebalance", "topic", "partition").write.mode(mode).option("compression", codec).partitionBy("topic", "partition").parquet(path)


def otlp_points(df: DataFrame, name: str, value: str, labels: list[str], ts: str) -> DataFrame:
    """One gauge point a row, as an OTLP JSON metric."""
    attributes = F.array(*[F.struct(F.lit(x).alias("key"), F.struct(F.col(x).cast("string").alias("stringValue")).alias("value")) for x in labels])
    nanos = (F.unix_micros(F.col(ts).cast("timestamp")) * 1000).cast("string")
    point = F.struct(nanos.alias("timeUnixNano"), F.col(value).cast("double").alias("asDouble"), attributes.alias("attributes"))
    return df.select(F.to_json(F.struct(F.lit(name).alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))).alias("line"))


def json_points(df: DataFrame, name: str, value: str, labels: list[str], ts: str) -> DataFrame:
    held = F.struct(F.lit(name).alias("name"), F.col(value).alias("value"), F.struct(*labels).alias("labels"), F.unix_millis(F.col(ts).cast("timestamp")).alias("timestamp"))
    return df.select(F.to_json(held).alias("line"))


def export(df: DataFrame, path: str, form: str, mode: str = "overwrite") -> None:
    if form == "avro":
        return avro.write(df, path, mode=mode)
    if form not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"no format {form}")
    (df.write.mode(mode).option("header", "true") if form == "csv" else df.write.mode(mode)).format(form).save(path)


def rewrite(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Compaction of small files into a new folder, which the caller then points readers to."""
    spark.read.parquet(source).coalesce(files).write.parquet(target)


def merge(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Target with updated and new rows: MERGE as an anti-join and a union."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def for_each(df: DataFrame, send: Callable[[list[dict]], None], batch: int = 500) -> None:
    """Sends rows from the executors in batches; at least once, as a task may run again."""

    def run(rows) -> None:
        held = []
        for r in rows:
            held.append(r.asDict(recursive=True))
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(run)


def prometheus(df: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def line_protocol(df: DataFrame, name: str, value: str, labels: list[str], ts: str) -> DataFrame:
    tags = F.concat_ws(",", F.lit(name), *[F.concat(F.lit(f"{x}="), F.col(x).cast("string")) for x in labels])
    nanos = F.unix_micros(F.col(ts).cast("timestamp")) * 1000
    return df.select(F.concat(tags, F.lit(" value="), F.col(value).cast("string"), F.lit(" "), nanos.cast("string")).alias("line"))
