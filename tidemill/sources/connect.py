"""Sources and sinks over Spark's Python data sources and plain HTTP, federated views, and payloads of common receivers."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class HttpLines(DataSource):
    """JSON lines from addresses (option urls, separated by spaces), one partition each; rows are value and url."""

    @classmethod
    def name(cls) -> str:
        return "http_lines"

    def schema(self) -> str:
        return "value string, url string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options["urls"].split())


class HttpReader(DataSourceReader):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        with urllib.request.urlopen(partition.value, timeout=30) as lines:
            for line in lines:
                if line.strip():
                    yield (line.decode().rstrip("\n"), partition.value)


def http(spark: SparkSession, *urls: str) -> DataFrame:
    spark.dataSource.register(HttpLines)
    return spark.read.format("http_lines").option("urls", " ".join(urls)).load()


def attach(spark: SparkSession, name: str, kind: str, **options: str) -> DataFrame:
    """A table elsewhere as a view: parquet, json, csv, orc or text files (path), http (urls), or jdbc (url, dbtable)."""
    if kind == "http":
        df = http(spark, *options["urls"].split())
    elif kind == "jdbc":
        df = spark.read.format("jdbc").options(**options).load()
    else:
        path = options.pop("path")
        df = spark.read.format(kind).options(**({"header": "true", "inferSchema": "true"} if kind == "csv" else {}) | options).load(path)
    df.createOrReplaceTempView(name)
    return df


#: What receivers take for a row: columns are topic, key, value (JSON text) and timestamp.
PAYLOADS = {
    "webhook": lambda: F.to_json(F.struct("topic", "key", "value", F.unix_millis(F.col("timestamp").cast("timestamp")).alias("timestamp"))),
    "elasticsearch": lambda: F.concat(F.to_json(F.struct(F.struct(F.col("topic").alias("_index"), F.col("key").alias("_id")).alias("index"))), F.lit("\n"), F.col("value"), F.lit("\n")),
    "redis": lambda: F.concat_ws(" ", F.lit("SET"), F.concat_ws(":", "topic", "key"), F.to_json(F.struct(F.col("value").alias("v")))),
    "slack": lambda: F.to_json(F.struct(F.concat(F.lit("["), F.col("topic"), F.lit("] "), F.col("value")).alias("text"))),
    "datadog": lambda: F.to_json(F.struct(F.lit("events").alias("ddsource"), F.col("topic").alias("service"), F.col("value").alias("message"))),
    "pagerduty": lambda: F.to_json(F.struct(F.lit("trigger").alias("event_action"), F.col("key").alias("dedup_key"), F.struct(F.col("value").alias("summary"), F.col("topic").alias("source"), F.lit("error").alias("severity")).alias("payload"))),
    "console": lambda: F.concat_ws("\t", "topic", "key", "value"),
}


def payloads(df: DataFrame, kind: str) -> DataFrame:
    return df.select(PAYLOADS[kind]().alias("payload"))


def batched(df: DataFrame, size: int, order: str = "key") -> DataFrame:
    """One row a call of a function elsewhere: {"records": [...]} of up to `size` payloads, within a partition."""
    import pyarrow as pa

    def run(batches):
        held: list[str] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= size:
                yield pa.RecordBatch.from_arrays([pa.array(['{"records":[' + ",".join(held[:size]) + "]}"])], ["payload"])
                held = held[size:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(['{"records":[' + ",".join(held) + "]}"])], ["payload"])

    return df.select("payload").mapInArrow(run, "payload string")


def post(url: str, attempts: int = 5, wait: float = 0.5) -> Callable[[list[dict]], None]:
    """A sender for sinks.for_each: a batch's payloads in one request, again after growing waits while it fails."""

    def send(rows: list[dict]) -> None:
        body = "\n".join(r["payload"] for r in rows).encode()
        for i in range(attempts):
            try:
                urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=30).close()
                return
            except OSError:
                if i + 1 == attempts:
                    raise
                time.sleep(wait * 2**i)

    return send


class Sinks:
    """Sinks by name: create, run (once over what is there), status, list, drop."""

    def __init__(self) -> None:
        self.held: dict[str, dict] = {}

    def create(self, name: str, write: Callable[[DataFrame], None]) -> None:
        if name in self.held:
            raise ValueError(f"{name} is taken")
        self.held[name] = {"write": write, "runs": 0, "failures": 0, "rows": 0, "error": None}

    def run(self, name: str, df: DataFrame) -> bool:
        sink = self.held[name]
        sink["runs"] += 1
        try:
            sink["write"](df)
        except Exception as e:  # a sink's failure is its status
            sink["failures"] += 1
            sink["error"] = str(e)[:500]
            return False
        sink["rows"] += df.count()
        sink["error"] = None
        return True

    def status(self, name: str) -> dict:
        return {k: v for k, v in self.held[name].items() if k != "write"}

    def list(self) -> list[str]:
        return sorted(self.held)

    def drop(self, name: str) -> None:
        del self.held[name]


def otlp(name: str, points: list[tuple[int, float, dict[str, str]]]) -> str:
    """One metric's points (nanoseconds, value, attributes) as an OTLP JSON request."""
    rows = [{"timeUnixNano": str(t), "asDouble": v, "attributes": [{"key": k, "value": {"stringValue": x}} for k, x in sorted(a.items())]} for t, v, a in points]
    return json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": name, "gauge": {"dataPoints": rows}}]}]}]}, separators=(",", ":"))
