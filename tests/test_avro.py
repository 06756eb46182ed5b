"""Avro files by the specification's own examples, and round trips of awkward rows."""

import datetime as dt
import decimal
import io

import pytest
from pyspark.sql import functions as F

from tidemill.sources import avro, sinks


def test_examples_of_the_specification():
    assert [avro.long(n) for n in (0, -1, 1, -2, 2, -64, 64)] == [b"\x00", b"\x01", b"\x02", b"\x03", b"\x04", b"\x7f", b"\x80\x01"]
    assert avro.put("string")("foo") == b"\x06foo"
    assert avro.put(["null", "string"])("a") == b"\x02\x02a" and avro.put(["null", "string"])(None) == b"\x00"
    assert avro.put({"type": "array", "items": "long"})([3, 27]) == b"\x04\x06\x36\x00"
    record = {"type": "record", "name": "test", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]}
    assert avro.put(record)((27, "foo")) == b"\x36\x06foo"
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 1 << 40):
        assert avro.read_long(io.BytesIO(avro.long(n))) == n


ROWS = [
    (1, "", b"", 1.5, True, decimal.Decimal("-12.34"), dt.date(1960, 2, 29), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), [1, None], {"k": None, "é": 2}, (7, "x")),
    (-(2**63), "日本\n" * 30_000, b"\x00\xff", float("inf"), False, decimal.Decimal("99999999.99"), dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), [], {}, (None, None)),
    (None,) * 11,
]
KINDS = "i long, s string, b binary, d double, t boolean, m decimal(10,2), day date, at timestamp_ntz, a array<int>, o map<string,int>, r struct<x: int, y: string>"


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_awkward_rows_come_back(spark, tmp_path, codec):
    df = spark.createDataFrame(ROWS * 2, KINDS)
    avro.write(df, str(tmp_path / "x"), codec)
    for split in (64 << 20, 5_000):  # whole files, and ranges that cut blocks
        got = avro.read(spark, str(tmp_path / "x"), split)
        assert got.dtypes == df.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))


def test_many_blocks_in_ranges(spark, tmp_path):
    df = spark.range(60_000).select("id", F.concat(F.lit("row "), F.col("id")).alias("s"), F.timestamp_seconds("id").alias("at")).coalesce(2)
    sinks.export(df, str(tmp_path / "y"), "avro")
    for split in (64 << 20, 10_000):
        got = avro.read(spark, str(tmp_path / "y"), split)
        assert got.count() == 60_000 and got.exceptAll(df).isEmpty()


def test_modes_empty_tables_and_what_has_no_form(spark, tmp_path):
    path, df = str(tmp_path / "z"), spark.range(3)
    avro.write(df, path)
    avro.write(df, path, mode="append")
    assert avro.read(spark, path).count() == 6
    avro.write(df, path)
    assert avro.read(spark, path).count() == 3
    avro.write(df.where("id < 0"), path)
    assert avro.read(spark, path).count() == 0
    for bad in (df.withColumnRenamed("id", "a b"), df.select(F.array(F.current_date()).alias("x")), df.select(F.expr("interval 1 day").alias("x"))):
        with pytest.raises(ValueError):
            avro.write(bad, path)
    with pytest.raises(ValueError):
        avro.read(spark, str(tmp_path / "nothing"))
