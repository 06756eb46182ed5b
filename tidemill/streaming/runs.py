"""Structured Streaming: file sources, watermarks, late rows, joins, stateful keys and a registry of running queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import windows


def source(spark: SparkSession, folder: str, name: str, ts: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder's table as a stream. Zone-less times become timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(stream: DataFrame, ts: str, delay: str, size: str, keys: list[str], **aggs: Column) -> DataFrame:
    return windows.tumbling(stream.withWatermark(ts, delay), ts, size, keys, **aggs)


def sessions(stream: DataFrame, ts: str, delay: str, gap: str, keys: list[str], **aggs: Column) -> DataFrame:
    return windows.session(stream.withWatermark(ts, delay), ts, gap, keys, **aggs)


def distinct(stream: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: tuple[str, str], lt: str, rt: str, delay: str, seconds: float, how: str = "inner") -> DataFrame:
    """Both sides watermarked and bound in time, so that state ends."""
    a, b = left.withWatermark(lt, delay), right.withWatermark(rt, delay)
    span = F.expr(f"INTERVAL '{seconds}' SECOND")  # a literal, so that the planner finds when state may go
    return a.join(b, (a[key[0]] == b[key[1]]) & (F.col(lt) >= F.col(rt) - span) & (F.col(lt) <= F.col(rt) + span), how)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, into Parquet, and reads it back. Aggregates that the last watermark
    leaves open come out when later rows move it."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """As drain(), for whole results of an aggregate: each batch replaces the last one's."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def split_late(stream: DataFrame, ts: str, delay_seconds: float, on_time: str, late: str, checkpoint: str, policy: str = "redirect") -> StreamingQuery:
    """Rows behind the mark (greatest time of earlier batches less the delay) go to their own folder, the rest on.

    Every batch has folders of its own (_batch=number) and leaves its mark in a row; a batch that runs again replaces what
    it wrote, and a restarted query goes on from the last mark. policy "include" keeps late rows with the others, "drop"
    leaves them out, "redirect" sends them aside.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [r for r in spark.read.schema("batch long, mark timestamp").parquet(f"{on_time}-marks").where(F.col("batch") < number).orderBy(F.desc("batch")).limit(1).collect()] if number else []
        seen = before[0]["mark"] if before else None
        behind = F.lit(False) if seen is None else F.col(ts) < F.lit(seen) - F.make_dt_interval(secs=F.lit(delay_seconds))
        split = {late: batch.where(behind), on_time: batch.where(~behind)} if policy != "include" else {on_time: batch}
        for path, rows in split.items():
            if path != late or policy == "redirect":
                rows.write.mode("overwrite").parquet(f"{path}/_batch={number}")
        mark = batch.agg(F.greatest(F.max(ts), F.lit(seen).cast("timestamp")).alias("mark")).select(F.lit(number).cast("long").alias("batch"), "mark")
        mark.write.mode("overwrite").parquet(f"{on_time}-marks/part={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Keyed state: key, total, n after each batch (applyInPandasWithState)."""
    kind = dict(stream.dtypes)[key]

    def step(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        for p in parts:
            total, n = total + float(p[value].sum()), n + len(p)
        state.update((total, n))
        yield pd.DataFrame({key: [k[0]], "total": [total], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, total double, n long", "total double, n long", "update", GroupStateTimeout.NoTimeout)


def features(stream: DataFrame, entity: str, value: str, ts: str) -> DataFrame:
    """entity and n, total, mean, least, most, first, last, distinct of its values so far; partial sums combine before the
    shuffle, and the state is one row an entity."""
    v = F.col(value)
    return stream.groupBy(entity).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.min_by(v, ts).alias("first"), F.max_by(v, ts).alias("last"), F.size(F.collect_set(v)).alias("distinct"),
    )


#: Triggers by name, as options of DataStreamWriter.trigger: what is there now, at a pace, or rows as they come.
TRIGGERS = {"now": lambda _: {"availableNow": True}, "processing_time": lambda s: {"processingTime": f"{s} seconds"}, "continuous": lambda s: {"continuous": f"{s} seconds"}}


def started(stream: DataFrame, put, checkpoint: str, trigger: str = "now", seconds: float = 1, mode: str = "append") -> StreamingQuery:
    """Runs a stream into put(batch, number). Modes: append emits final results only, update early ones too."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**TRIGGERS[trigger](seconds)).foreachBatch(put).start()


def timed(stream: DataFrame, sense: str, ts: str | None = None) -> DataFrame:
    """Adds `at`: the event's own time, the time it is processed, or the time its log took it in."""
    at = {"event": lambda: F.col(ts), "processing": F.current_timestamp, "ingestion": lambda: F.col(ts or "timestamp")}[sense]()
    return stream.withColumn("at", at.cast("timestamp"))


def watermarked(stream: DataFrame, ts: str, strategy: str = "bounded", delay: str = "5 seconds", mark: Column | None = None) -> DataFrame:
    """none, periodic (no delay), bounded (a delay), or punctuated: only rows that meet `mark` move the watermark, as the
    others' times count as the earliest. Several inputs go on by the least of their marks."""
    if strategy == "none":
        return stream
    if strategy == "punctuated":
        return stream.withColumn("mark_time", F.when(mark, F.col(ts)).otherwise(F.timestamp_seconds(F.lit(0)))).withWatermark("mark_time", delay)
    return stream.withWatermark(ts, "0 seconds" if strategy == "periodic" else delay)


class KeyState:
    """Values by namespace and key on shared storage: put, get, delete, scan; checkpoint gives a number to restore."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        from ..sources.lake import Lake

        self.spark, self.lake = spark, Lake(spark, root)
        if not self.lake.versions():
            self.lake.overwrite(spark.createDataFrame([], "namespace string, key string, value string"))

    def put(self, rows: DataFrame) -> int:
        """rows: namespace, key, value; each takes the place of the one before it."""
        return self.lake.merge(rows.select("namespace", "key", "value"), ["namespace", "key"])

    def delete(self, rows: DataFrame) -> int:
        return self.lake.overwrite(self.lake.read().join(rows.select("namespace", "key"), ["namespace", "key"], "left_anti"))

    def scan(self, namespace: str, prefix: str = "") -> DataFrame:
        return self.lake.read().where((F.col("namespace") == namespace) & F.startswith("key", F.lit(prefix)))

    def get(self, namespace: str, key: str) -> str | None:
        row = self.scan(namespace).where(F.col("key") == key).first()
        return row["value"] if row else None

    def checkpoint(self) -> int:
        return self.lake.versions()[-1]["version"]

    def restore(self, version: int) -> int:
        return self.lake.overwrite(self.lake.read(version=version))


class Continuous:
    """Running queries by name: submit, list, stats, cancel."""

    def __init__(self, spark: SparkSession, checkpoints: str) -> None:
        self.spark, self.checkpoints = spark, checkpoints

    def submit(self, name: str, stream: DataFrame, path: str, seconds: float = 10) -> StreamingQuery:
        if name in self.list():
            raise ValueError(f"{name} runs already")
        return stream.writeStream.queryName(name).option("checkpointLocation", f"{self.checkpoints}/{name}").trigger(processingTime=f"{seconds} seconds").format("parquet").start(path)

    def list(self) -> list[str]:
        return sorted(q.name for q in self.spark.streams.active if q.name)

    def stats(self, name: str) -> dict | None:
        return next((q.lastProgress for q in self.spark.streams.active if q.name == name), None)

    def cancel(self, name: str) -> None:
        for q in self.spark.streams.active:
            if q.name == name:
                q.stop()


def alerts(df: DataFrame, value: str, above: float, key: str, ts: str, for_seconds: float) -> DataFrame:
    """key, started, fired, ended: runs of rows over a limit that last at least for_seconds (gaps and islands)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(ts)
    run = F.sum(F.when(F.col(value) > above, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hot = df.withColumn("_run", run).where(F.col(value) > above)
    spans = hot.groupBy(key, "_run").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"))
    span = F.make_dt_interval(secs=F.lit(for_seconds))
    return spans.where(F.col("ended") - F.col("started") >= span).select(key, "started", (F.col("started") + span).alias("fired"), "ended")
