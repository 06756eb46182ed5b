"""Operators on small inputs with known results."""

import datetime as dt

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import aggregates, scalar
from tidemill.operators import anomaly, cep, joins, logs, timeseries, transforms, vector, windows
from tidemill.plans import dialect
from tidemill.plans.builder import flow
from tidemill.plans.catalog import Catalog
from tidemill.queries import ORACLE, QUERIES
from tidemill.sources import sinks, topics
from tidemill.streaming import runs

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- dialect
def test_window_clause_becomes_a_group():
    got = dialect.translate("SELECT k, COUNT(*) AS n FROM topic('e') WHERE v > 1 WINDOW TUMBLING(INTERVAL '30') GROUP BY k", {"e": "topic_e"}, "ts")
    assert got == "SELECT window.start AS window_start , window.end AS window_end , k , COUNT ( * ) AS n FROM topic_e WHERE v > 1 GROUP BY window(ts, '30 seconds') , k"


def test_text_in_strings_and_comments_stays():
    got = dialect.translate("SELECT 'topic(''x'') WINDOW TUMBLING(1)' AS s -- WINDOW HOPPING(1, 2)\nFROM t")
    assert got == "SELECT 'topic(''x'') WINDOW TUMBLING(1)' AS s FROM t"


@pytest.mark.parametrize("bad", ["", "SELECT 1 FROM topic('nope')", "SELECT 1 FROM t WINDOW SPIRAL(INTERVAL '1 h')", "SELECT (1 FROM t WINDOW TUMBLING(INTERVAL '1'", "SELECT 1 FROM t WINDOW TUMBLING(INTERVAL 'soon')"])
def test_bad_statements_raise(bad):
    with pytest.raises(dialect.DialectError):
        dialect.translate(bad)


@pytest.mark.parametrize(("text", "spark_text"), [("INTERVAL '5 minutes'", "5 minutes"), ("'1h'", "1 hours"), ("INTERVAL 90", "90 seconds"), ("'250ms'", "250 milliseconds")])
def test_durations(text, spark_text):
    assert dialect.duration(dialect.lex(text)) == spark_text


def test_catalog_statements_and_pages(spark):
    c = Catalog(spark)
    c.topic("my-topic", frame(spark, [(i, f"k{i}") for i in range(10)], "offset long, key string"))
    assert [r.name for r in c.sql("SHOW TOPICS").collect()] == ["my-topic"]
    c.sql("CREATE VIEW evens AS SELECT * FROM topic('my-topic') WHERE offset % 2 = 0")
    assert c.sql("SELECT COUNT(*) AS n FROM evens").first().n == 5
    first, cursor = c.page("SELECT offset FROM topic('my-topic') ORDER BY offset", 6)
    rest, end = c.page("SELECT offset FROM topic('my-topic') ORDER BY offset", 6, cursor)
    assert [r["offset"] for r in first + rest] == list(range(10)) and end is None
    assert c.sql("EXPLAIN SELECT * FROM evens").count() > 0
    c.sql("DROP VIEW evens")
    with pytest.raises(dialect.DialectError):
        c.sql("DROP VIEW evens")


# --- windows
def test_feature_windows(spark):
    df = frame(spark, [("a", at(t / 1000), v) for t, v in [(100, 1.0), (200, 2.0), (300, 3.0), (1000, 10.0), (1100, 20.0)]], "k string, ts timestamp, v double")
    got = windows.feature_session(df, "ts", 0.5, ["k"], total=F.sum("v"), n=F.count("*")).orderBy("window_start").collect()
    assert [(r.total, r.n) for r in got] == [(6.0, 3), (30.0, 2)]


def test_tumbling_and_hopping(spark):
    df = frame(spark, [(at(0.5),), (at(0.8),), (at(1.2),)], "ts timestamp")
    assert sorted(r.n for r in windows.tumbling(df, "ts", "1 second", [], n=F.count("*")).collect()) == [1, 2]
    assert windows.hopping(df.limit(1), "ts", "1 second", "500 milliseconds", [], n=F.count("*")).count() == 2


def test_count_window_keeps_the_rest(spark):
    df = frame(spark, [(i, "a") for i in range(7)], "i long, k string")
    assert sorted((r.window_no, r.n) for r in windows.count_window(df, ["i"], 3, ["k"], n=F.count("*")).collect()) == [(0, 3), (1, 3), (2, 1)]


def test_capped_session(spark):
    df = frame(spark, [("a", at(t)) for t in range(0, 100, 10)], "k string, ts timestamp")
    assert [r.events for r in windows.capped_session(df, "ts", 15, 35, "k").orderBy("session").collect()] == [4, 4, 2]


# --- joins
def test_point_in_time(spark):
    purchases = frame(spark, [("u1", 1000, 100.0), ("u1", 2000, 250.0), ("u2", 1500, 75.0)], "entity string, ts long, amount double")
    probes = frame(spark, [("u1", 1500), ("u1", 3000), ("u2", 1000), ("u2", 2000)], "entity string, at long")
    got = joins.point_in_time(probes, {"p": purchases}, "entity", "at")
    assert {(r.entity, r["at"]): r.p_amount for r in got.collect()} == {("u1", 1500): 100.0, ("u1", 3000): 250.0, ("u2", 1000): None, ("u2", 2000): 75.0}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=12))
def test_as_of_by_brute_force(spark, left, right):
    a = frame(spark, [(i, k, t) for i, (k, t) in enumerate(left)], "i long, k long, t long")
    b = frame(spark, [(i, k, t) for i, (k, t) in enumerate(right)], "j long, k long, u long")
    got = {r.i: r.table_j for r in joins.as_of(a, b, ["k"], "t", "u", "j").collect()}
    for i, (k, t) in enumerate(left):
        past = [(u, j) for j, (k2, u) in enumerate(right) if k2 == k and u <= t]
        assert got[i] == (max(past)[1] if past else None)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40)), max_size=10), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40)), max_size=10), st.integers(-10, 0), st.integers(0, 10))
def test_interval_by_brute_force(spark, left, right, low, high):
    a = frame(spark, [(i, k, at(t)) for i, (k, t) in enumerate(left)], "i long, k long, t timestamp")
    b = frame(spark, [(j, k, at(t)) for j, (k, t) in enumerate(right)], "j long, q long, u timestamp")
    got = sorted((r.i, r.j) for r in joins.interval(a, b, [("k", "q")], "t", "u", low, high).collect())
    assert got == sorted((i, j) for i, (k, t) in enumerate(left) for j, (q, u) in enumerate(right) if k == q and low <= t - u <= high)


# --- aggregates and functions
def test_two_percentiles(spark):
    df = frame(spark, [(float(i),) for i in range(1, 11)], "v double")
    r = df.agg(aggregates.nearest_rank(F.col("v"), 0.5).alias("a"), aggregates.floor_rank(F.col("v"), 50).alias("b")).first()
    assert (r.a, r.b) == (6.0, 6.0)


def test_scalar_semantics(spark):
    r = spark.range(1).select(scalar.length(F.lit("é")).alias("n"), scalar.trim(F.lit("\t x \n")).alias("t"), scalar.concat(F.lit("a"), F.lit(None), F.lit(1)).alias("c"), scalar.divide(F.lit(7), F.lit(0)).alias("d"), scalar.extract("DOW", F.lit(dt.datetime(2024, 1, 7))).alias("dow"), scalar.mask_partial(F.lit("ann@x.org")).alias("m")).first()
    assert tuple(r) == (2, "x", "a1", None, 0, "a***@x.org")


def test_empty_global_aggregate_has_a_row(spark):
    assert spark.range(0).agg(aggregates.total(F.col("id")).alias("s")).collect()[0].s is None


# --- patterns
def events(spark, rows):
    return frame(spark, [("u", at(t), e, i, float(v)) for i, (t, e, v) in enumerate(rows)], "k string, ts timestamp, e string, id long, v double")


def test_pattern_within_and_condition(spark):
    e = F.col("e")
    p = cep.Pattern().begin("login", e == "login").followed_by("out", (e == "withdrawal") & (F.col("v") > 10_000)).within(300)
    df = events(spark, [(0, "login", 0), (10, "view", 0), (20, "withdrawal", 500), (200, "withdrawal", 20_000), (900, "withdrawal", 20_000)])
    assert [r.ids for r in cep.match(df, p, "k", "ts", "id").collect()] == [[0, 3]]


def test_pattern_negation_and_strictness(spark):
    e = F.col("e")
    p = cep.Pattern().begin("login", e == "login").not_followed_by("logout", e == "logout").followed_by("buy", e == "buy")
    assert cep.match(events(spark, [(0, "login", 0), (1, "logout", 0), (2, "buy", 0)]), p, "k", "ts", "id").count() == 0
    assert cep.match(events(spark, [(0, "login", 0), (1, "x", 0), (2, "buy", 0)]), p, "k", "ts", "id").count() == 1
    assert cep.match(events(spark, [(0, "login", 0), (1, "x", 0), (2, "buy", 0)]), p.strictly(), "k", "ts", "id").count() == 0


# --- the rest
def test_z_score_finds_the_spike(spark):
    df = frame(spark, [("k", i, 100.0 if i == 40 else float(i % 3)) for i in range(50)], "k string, i long, v double")
    assert [r.i for r in anomaly.z_score(df, "k", ["i"], "v").where("is_anomaly").collect()] == [40]


def test_rollup_levels_agree(spark):
    df = frame(spark, [("cpu", at(t), float(v)) for t, v in [(0, 10), (30, 20), (60, 30), (90, 40), (120, 50), (180, 60), (300, 70)]], "m string, ts timestamp, v double")
    levels = timeseries.rollup(df, "ts", "v", [60, 300], ["m"])
    assert sorted((r["sum"], r["count"]) for r in levels[300].collect()) == [(70.0, 1), (210.0, 6)]


def test_diff_kinds(spark):
    a, b = frame(spark, [(1, "x"), (2, "y"), (3, None)], "k long, v string"), frame(spark, [(2, "z"), (3, None), (4, "n")], "k long, v string")
    assert {r.k: r.change for r in timeseries.diff(a, b, ["k"], ["v"]).collect()} == {1: "removed", 2: "modified", 3: "unchanged", 4: "added"}


def test_compaction_keeps_keyless_and_drops_tombstones(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), (None, 4, "z")], "key string, offset long, value string")
    assert sorted(r.offset for r in logs.compact(df, "key", "offset", F.col("value").isNull()).collect()) == [3, 4]


def test_flow_cycles_raise(spark):
    with pytest.raises(ValueError, match="cycle"):
        flow({"a": ("filter", {"condition": "true"}), "b": ("filter", {"condition": "true"})}, [("a", "b"), ("b", "a")], "a")


def test_debezium_nulls(spark):
    df = frame(spark, [('{"before":null,"after":{"id":1},"op":"c","ts_ms":5}',), ("junk",)], "v string")
    assert sorted([(r.op, r.after.id if r.after else None) for r in transforms.debezium(df, "v", "id: long").collect()], key=str) == [("c", 1), (None, None)]


def test_knn_refuses_many_queries(spark):
    v = frame(spark, [(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>")
    with pytest.raises(ValueError):
        vector.nearest(v, v.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 1, most_queries=3)


def test_knn_answers_many_queries_in_blocks(spark):
    v = frame(spark, [(i, [1.0, float(i)]) for i in range(12)] + [(12, None), (13, [0.0, 0.0])], "id long, vector array<double>")
    asked = v.select(F.col("id").alias("query_id"), F.col("vector").alias("query")).where("query_id < 12")
    once, blocks = (sorted(map(tuple, vector.nearest(v.repartition(3), asked, 2, most_queries=m, in_blocks=True).collect())) for m in (100, 3))
    assert len(once) == 24 and [r[:2] + r[3:] for r in once] == [r[:2] + r[3:] for r in blocks]
    assert all(r[1] == r[0] for r in once if r[3] == 1)


def test_quantised_vectors(spark):
    r = frame(spark, [([1.0, -2.0, 0.0],)], "v array<double>").select(vector.quantise_i8(F.col("v")).alias("q")).first()
    assert r.q in ([64, -127, 0], [63, -127, 0])


@pytest.mark.parametrize(("text", "want"), [("now", at(0)), ("-5m", at(-300)), ("2h", at(-7200)), ("yesterday", at(-86_400)), ("1704067200", T0), ("1704067200000", T0), ("2024-01-01T00:00:00Z", T0)])
def test_time_points(text, want):
    assert topics.time_point(text, T0) == want


def test_exports(spark, tmp_path):
    df = frame(spark, [(1, "a")], "i long, s string")
    for form in ("parquet", "json", "csv", "orc"):
        sinks.export(df, f"{tmp_path}/{form}", form)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().s == "a"
    with pytest.raises(ValueError):
        sinks.export(df, f"{tmp_path}/x", "xml")


# --- streams
def test_running_totals(spark, sf, tmp_path):
    s = runs.source(spark, sf, "events", "ts")
    got = []
    q = runs.running_totals(s, "event_type", "value").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda b, n: got.extend(b.collect())).start()
    q.awaitTermination()
    want = {r.event_type: r.n for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert {r.event_type: r.n for r in got} == want


def test_late_rows_go_aside(spark, tmp_path):
    for i, times in enumerate([(0, 100), (10, 200), (95, 201)]):
        frame(spark, [(at(t),) for t in times], "ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    runs.split_late(stream, "ts", 50, f"{tmp_path}/ok", f"{tmp_path}/late", f"{tmp_path}/c").awaitTermination()
    late = sorted((r.ts - T0).seconds for r in spark.read.parquet(f"{tmp_path}/late").collect())
    assert late == [10, 95] and spark.read.parquet(f"{tmp_path}/ok").count() == 4


def test_alert_runs(spark):
    df = frame(spark, [("k", at(t), v) for t, v in [(0, 9.0), (10, 9.0), (20, 1.0), (30, 9.0), (31, 9.0)]], "k string, ts timestamp, v double")
    assert [(r.started, r.ended) for r in runs.alerts(df, "v", 5, "k", "ts", 10).collect()] == [(at(0), at(10))]


def test_entry_works_without_the_subpackage(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_rate_limit_has_the_periods_of_its_sql_and_steady_ties(spark, tmp_path):
    edge = [dt.datetime(y, m, d, 23, 59, 59, us) for y, m, d in ((2024, 1, 1), (1969, 12, 31), (1969, 12, 30)) for us in (0, 499_999, 500_000, 999_999)]
    times = [t + dt.timedelta(hours=h) for t in edge for h in (-5, 0, 3)] + [None]
    rows = [(i, t, "e") for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["rate_limit"](spark, str(tmp_path)).collect())) == sorted(con.sql(ORACLE["rate_limit"]).fetchall())

    tied = [(i, dt.datetime(2024, 1, 1 + i % 2), "e") for i in reversed(range(200))]
    spark.createDataFrame(tied, "event_id long, ts timestamp_ntz, event_type string").repartition(7).write.parquet(f"{tmp_path}/tied/events.parquet")
    assert sorted(r.event_id for r in QUERIES["rate_limit"](spark, f"{tmp_path}/tied").collect()) == list(range(6))
