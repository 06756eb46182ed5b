"""Exponential means and variances of keys that span ranges, against a plain loop."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalar
from tidemill.operators import anomaly
from tidemill.queries import ORACLE, QUERIES


def plain(values, alpha):
    out, mean, var = [], None, 0.0
    for v in values:
        mean = v if mean is None else mean
        d = v - mean
        out.append((mean, var, mean + alpha * d))
        mean, var = mean + alpha * d, (1 - alpha) * (var + alpha * d * d)
    return out


@pytest.mark.parametrize("alpha, base", [(0.3, 0.0), (2 / 21, 1e6)])
def test_a_hot_key_over_many_ranges_equals_the_loop(spark, alpha, base):
    dice = random.Random(5)
    keys = {"a": 40, "hot": 5_000, "one": 1, "z": 700, None: 30}
    rows = [(k, i, base + dice.gauss(0, 3) + (80 if dice.random() < 0.01 else 0)) for k, n in keys.items() for i in range(n)]
    df = spark.createDataFrame(dice.sample(rows, len(rows)), "k string, i int, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # the hot key lies in most of them
    got = {(r.k, r.i): r for r in anomaly.smoothed(df, "k", ["i"], "v", alpha).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for k in keys:
        mine = sorted((i, v) for key, i, v in rows if key == k)
        for (i, _), want in zip(mine, plain([v for _, v in mine], alpha)):
            r = got[k, i]
            assert r["_i"] == i
            assert (r["_before"], r["_var"], r["_mean"]) == pytest.approx(want, rel=1e-6, abs=1e-7)


def test_null_values_empty_tables_and_kept_columns(spark):
    df = spark.createDataFrame([("k", i, None if i == 20 else float(i % 3), "x") for i in range(40)], "k string, i int, v double, other string")
    got = {r.i: r for r in anomaly.ema(df, "k", ["i"], "v").collect()}
    assert len(got) == 40 and got[0].other == "x" and not math.isnan(got[19].ema)
    assert all(math.isnan(got[i].ema) and not got[i].is_anomaly for i in range(20, 40))
    ew = {r.i: r for r in anomaly.ewma(df, "k", ["i"], "v").collect()}
    assert ew[9].deviation is None and ew[15].deviation is not None and ew[30].deviation is None and not ew[30].is_anomaly
    assert anomaly.ema(df.where("i < 0"), "k", ["i"], "v").count() == 0


def test_forecasts_are_rounded_as_their_sql_does(spark, tmp_path):
    rows = [(u * 100 + i, dt.datetime(2024, 1, 1, 0, i), u, None if (u, i) == (7, 5) else round((u * 37 + i * i * 11) % 401 / 4 + u / 100, 2)) for u in range(60) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.forecast for r in QUERIES["holt_forecast"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(ORACLE["holt_forecast"]).fetchall())
    assert got == want and len(got) == 720 and sum(v is None for v in got.values()) == 7


def test_halves_are_judged_in_binary(spark):
    rows = [9.768975, -9.768975, 0.5e-5, 2.5e-5, 1e300, 1e304, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in rows], "v double").select(scalar.round_binary(F.col("v"), 5)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in rows]
