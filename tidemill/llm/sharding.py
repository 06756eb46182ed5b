"""Shards by jump consistent hashing: no ring table, and appended shards take only their share of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Fixed values of the jump hash's generator and of the 64-bit finaliser that spreads consecutive ids.
STEP = 2862933555777941757
SPREAD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def spread(keys: np.ndarray) -> np.ndarray:
    z = keys.astype(np.uint64) + np.uint64(SPREAD[0])
    z = (z ^ (z >> np.uint64(30))) * np.uint64(SPREAD[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SPREAD[2])
    return z ^ (z >> np.uint64(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; all keys jump together until every one is past the last shard."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = spread(keys)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(STEP) + np.uint64(1)
        ahead[live] = np.floor((at[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_column(key, shards: int):
    """Shard number of a long column; a null key counts as 0."""

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series(jump(ids.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key, F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int = 8, block: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Null text: size 1 and the checksum of no bytes. Null doc_id: placed as key 0. Repeated rows: one slot each, all in
    one shard. No rows: no rows. Other columns are ignored. Slots count up inside hashed blocks of about `block` rows,
    so no task holds a shard.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.col("doc_id").cast("long")
    thin = scratch(
        docs.select(key.alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
        .withColumn("shard", shard_column(F.col("doc_id"), shards))
        .withColumn("grown_shard", shard_column(F.col("doc_id"), shards + 1)),
        "shards",
    )
    blocks = 1 + thin.count() // (shards * block)
    thin = thin.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)))
    sizes = thin.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        thin.withColumn("n", F.row_number().over(inside))
        .join(starts, ["shard", "block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")
    )
