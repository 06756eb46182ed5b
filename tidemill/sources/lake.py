"""A table of Parquet folders with versions: append, overwrite, merge, time travel, compaction and clean-up."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lake:
    """root/data/<id> holds rows, root/log/<version>.json the folders of a version, its time, and what made it.

    A version's file is renamed into place and never changes, so readers see whole versions; a commit that loses the race
    for a number raises. A change keeps the folders that it doesn't touch.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.root}/log"))

    def versions(self) -> list[dict]:
        found = self.fs.listStatus(self.path(f"{self.root}/log"))
        names = sorted(s.getPath().getName() for s in found if s.getPath().getName().endswith(".json"))
        return [json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/log/{n}").collect())) for n in names]

    def commit(self, folders: list[str], operation: str, **facts) -> int:
        held = self.versions()
        entry = {"version": len(held), "time": time.time(), "operation": operation, "folders": folders} | facts
        draft, final = (self.path(f"{self.root}/log/{n}") for n in (f".{uuid.uuid4().hex}", f"{len(held):09d}.json"))
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"version {len(held)} was committed by another writer")
        return len(held)

    def put(self, df: DataFrame, partition_by: list[str] = ()) -> str:
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(f"{self.root}/data/{name}")
        return name

    def now(self) -> list[str]:
        held = self.versions()
        return held[-1]["folders"] if held else []

    def append(self, df: DataFrame, batch: str | None = None, **options) -> int:
        """A batch with a name is appended once, however often it runs."""
        if batch is not None and any(v.get("batch") == batch for v in self.versions()):
            return len(self.versions()) - 1
        return self.commit([*self.now(), self.put(df, **options)], "append", batch=batch)

    def overwrite(self, df: DataFrame, **options) -> int:
        return self.commit([self.put(df, **options)], "overwrite")

    def merge(self, updates: DataFrame, keys: list[str]) -> int:
        """Rows of the updates take the place of those with their keys; others are added."""
        kept = self.read().join(updates.select(*keys), keys, "left_anti")
        return self.commit([self.put(kept.unionByName(updates))], "merge")

    def read(self, version: int | None = None, at: float | None = None) -> DataFrame:
        """The newest version, a numbered one, or the newest of a time in epoch seconds."""
        held = [v for v in self.versions() if (version is None or v["version"] == version) and (at is None or v["time"] <= at)]
        if not held:
            raise ValueError("no such version")
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/data/{f}" for f in held[-1]["folders"]])

    def optimize(self, files: int = 1) -> int:
        return self.commit([self.put(self.read().coalesce(files))], "optimize")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last `keep` versions names; gives their number."""
        held = self.versions()
        live = {f for v in held[-keep:] for f in v["folders"]}
        gone = {f for v in held for f in v["folders"]} - live
        return sum(bool(self.fs.delete(self.path(f"{self.root}/data/{f}"), True)) for f in gone)


def bind(stream: DataFrame, lake: Lake, checkpoint: str):
    """A stream into a table, each batch committed once under its number; runs over all that is there now."""

    def put(batch: DataFrame, number: int) -> None:
        lake.append(batch, batch=f"{checkpoint}:{number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def records(df: DataFrame, partition: str = "none", path: str | None = None, pattern: str = "yyyy-MM-dd-HH") -> DataFrame:
    """Log records as table rows: offset, timestamp, key, value, headers_json, and _partition_value by none, hour, day,
    month or a field of the JSON value."""
    forms = {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
    if partition == "field":
        part = F.coalesce(F.get_json_object("value", f"$.{path}"), F.lit("null"))
    else:
        part = F.date_format("timestamp", forms[partition]) if partition in forms else F.lit("all")
    headers = F.to_json("headers") if "headers" in df.columns else F.lit("{}")
    return df.select("offset", "timestamp", "key", "value", headers.alias("headers_json"), part.alias("_partition_value"))
