"""Change logs of databases in their published JSON or table forms, as one form of change event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that every source gives.
EVENT = ("source", "table", "op", "before", "after", "at_ms", "position")


def event(df: DataFrame, source: str, table: Column, op: Column, before: Column, after: Column, at_ms: Column, position: Column) -> DataFrame:
    values = (F.lit(source), table, op, before, after, at_ms.try_cast("long"), position.cast("string"))
    return df.select(*[v.alias(n) for v, n in zip(values, EVENT)]).where("op IS NOT NULL")


def chosen(by: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(by == k, v).otherwise(out)
    return out


def columns_to_object(pairs: Column) -> Column:
    """An array of {"name", "value"} objects as one JSON object."""
    kind = "array<struct<name: string, value: string>>"
    return F.to_json(F.map_from_entries(F.transform(F.from_json(pairs, kind), lambda x: F.struct(x["name"], x["value"]))))


def postgres(df: DataFrame, value: str = "value") -> DataFrame:
    """Write-ahead log decoded as JSON, one change a line: action I, U, D or T, columns and identity."""
    get = lambda p: F.get_json_object(value, f"$.{p}")
    op = chosen(get("action"), {"I": "c", "U": "u", "D": "d", "T": "t"})
    at = F.unix_millis(get("timestamp").try_cast("timestamp"))
    return event(df, "postgres", F.concat_ws(".", get("schema"), get("table")), op, columns_to_object(get("identity")), columns_to_object(get("columns")), at, get("lsn"))


def mysql(df: DataFrame, value: str = "value") -> DataFrame:
    """Binary log as JSON: database, table, type, ts (seconds), data and old (the changed columns' former values)."""
    get = lambda p: F.get_json_object(value, f"$.{p}")
    op = chosen(get("type"), {"insert": "c", "bootstrap-insert": "r", "update": "u", "delete": "d"})
    gone = op == "d"
    return event(df, "mysql", F.concat_ws(".", get("database"), get("table")), op, F.when(gone, get("data")).otherwise(get("old")), F.when(~gone, get("data")), get("ts").try_cast("long") * 1000, get("position"))


def mongodb(df: DataFrame, value: str = "value") -> DataFrame:
    """Change stream documents: operationType, ns, documentKey, fullDocument and its former image."""
    get = lambda p: F.get_json_object(value, f"$.{p}")
    op = chosen(get("operationType"), {"insert": "c", "update": "u", "replace": "u", "delete": "d", "drop": "t"})
    return event(df, "mongodb", F.concat_ws(".", get("ns.db"), get("ns.coll")), op, F.coalesce(get("fullDocumentBeforeChange"), F.when(op == "d", get("documentKey"))), get("fullDocument"), get("wallTime"), get("_id._data"))


def sqlserver(df: DataFrame, table: str, columns: list[str], lsn: str = "__$start_lsn", operation: str = "__$operation", at: str | None = None) -> DataFrame:
    """Rows of a change table: operation 1 delete, 2 insert, 3 and 4 an update's two images, which become one event."""
    image = F.to_json(F.struct(*columns))
    o = F.col(f"`{operation}`")
    rows = df.select(F.col(f"`{lsn}`").alias("_lsn"), columns[0], o.alias("_o"), image.alias("_i"), (F.unix_millis(F.col(at).cast("timestamp")) if at else F.lit(None).cast("long")).alias("_at"))
    both = rows.groupBy("_lsn", columns[0]).agg(*[F.max(F.when(F.col("_o") == k, F.col("_i"))).alias(f"_i{k}") for k in (1, 2, 3, 4)], F.max("_at").alias("_at"))
    op = F.when(F.col("_i4").isNotNull(), "u").when(F.col("_i2").isNotNull(), "c").when(F.col("_i1").isNotNull(), "d")
    return event(both, "sqlserver", F.lit(table), op, F.coalesce("_i3", "_i1"), F.coalesce("_i4", "_i2"), F.col("_at"), F.col("_lsn"))


def snapshot(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 8, **options: str) -> DataFrame:
    """A table as it is now, read over JDBC in ranges of a key (the driver's jar is the cluster's)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
    return reader.option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load()
