"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates as agg
from .functions import scalar
from .functions.registry import Functions
from .operators import anomaly, cells, cep, embedding, joins, logs, observe, schemas, timeseries, transforms, vector, windows
from .plans import questions
from .plans.builder import Pipeline, flow
from .plans.catalog import Catalog
from .plans.views import View, Views, apply_deltas, counted
from .session import scratch_path as scratch
from .sources import sinks, topics
from .streaming import runs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def sql(name: str, statement: str, oracle: str | None = None, time_column: str = "ts") -> None:
    """A statement of the dialect over the tables as topics; the oracle is the same text unless given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        catalog = Catalog(spark, time_column)
        text = statement
        for t in TABLES:
            if re.search(rf"\b{t}\b", statement):
                view = catalog.topic(t, table(spark, d, t))
                text = re.sub(rf"(?<!')\b{t}\b(?!')", view, text)
        return catalog.sql(text)

    QUERIES[name] = run
    ORACLE[name] = oracle or statement


def events(spark, d):
    return table(spark, d, "events")


# --- the flagship: the dialect, event time and aggregates
sql(
    "flagship_tumbling",
    "SELECT event_type, COUNT(*) AS cnt, ROUND(AVG(value), 4) AS avg_value FROM topic('events') WINDOW TUMBLING(INTERVAL '1 hour') GROUP BY event_type",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, COUNT(*) AS cnt, ROUND(AVG(value), 4) AS avg_value FROM events GROUP BY ALL",
)

# --- projection, filters, expressions
sql("project_alias", "SELECT event_id AS id, value * 2 AS twice, -value AS negated FROM events")
sql("filter_compare", "SELECT event_id, value FROM events WHERE value >= 10 AND value < 50 OR NOT event_type <> 'click'")
sql("filter_in", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)")
sql("filter_between", "SELECT event_id FROM events WHERE value BETWEEN 5 AND 20 AND user_id NOT BETWEEN 10 AND 50")
sql("filter_like", "SELECT event_id, event_type FROM events WHERE event_type LIKE 'c%' OR event_type LIKE '_iew'")
sql("filter_null", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL AND o_totalprice IS NOT NULL")
sql("case_when", "SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band, CASE event_type WHEN 'click' THEN 1 ELSE 0 END AS is_click FROM events")
sql("cast_types", "SELECT event_id, CAST(user_id AS DOUBLE) AS d, CAST(event_id AS VARCHAR(20)) AS s, CAST(user_id > 5 AS BOOLEAN) AS b FROM events")
sql("string_concat", "SELECT event_id, event_type || '-' || CAST(user_id AS VARCHAR(20)) AS tag FROM events")
sql("arithmetic_int", "SELECT event_id, user_id + 1 AS a, user_id * 3 AS m, user_id % 7 AS r, event_id DIV 7 AS q FROM events", "SELECT event_id, user_id + 1 AS a, user_id * 3 AS m, user_id % 7 AS r, event_id // 7 AS q FROM events")
sql("bitwise", "SELECT event_id, user_id & 6 AS a, user_id | 8 AS o, user_id ^ 5 AS x FROM events", "SELECT event_id, user_id & 6 AS a, user_id | 8 AS o, xor(user_id, 5) AS x FROM events")
sql("scalar_subquery", "SELECT event_id, value FROM events WHERE value > (SELECT AVG(value) FROM events)")
sql("from_subquery", "SELECT t, MAX(n) AS top FROM (SELECT event_type AS t, user_id AS u, COUNT(*) AS n FROM events GROUP BY event_type, user_id) x GROUP BY t")
sql("json_arrow", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE props ->> 'k' IS NOT NULL", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
sql("json_aggregate", "SELECT CAST(props ->> '$.k' AS BIGINT) % 10 AS k, COUNT(*) AS n FROM events GROUP BY CAST(props ->> '$.k' AS BIGINT) % 10", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, COUNT(*) AS n FROM events GROUP BY 1")
sql("extract_parts", "SELECT event_id, EXTRACT('YEAR', ts) AS y, EXTRACT('DOW', ts) AS dow, EXTRACT('DOY', ts) AS doy, EXTRACT('WEEK', ts) AS wk, EXTRACT('QUARTER', ts) AS q, EXTRACT('EPOCH', ts) AS ep FROM events",
    "SELECT event_id, year(ts) AS y, dayofweek(ts) AS dow, dayofyear(ts) AS doy, weekofyear(ts) AS wk, quarter(ts) AS q, CAST(floor(epoch(ts)) AS BIGINT) AS ep FROM events")
sql("length_bytes", "SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS n FROM documents", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents")
sql("date_functions", "SELECT event_id, date_trunc('day', ts) AS day, CAST(date_part('hour', ts) AS BIGINT) AS h FROM events")


@query("string_functions", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, substring(c_name, 1, 8) AS s, replace(c_name, '#', '-') AS r, concat(c_name, c_mktsegment) AS c, substring(c_name, 3, 4) AS z FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"), scalar.substring(F.col("c_name"), -2, 8).alias("s"), F.regexp_replace("c_name", "#", "-").alias("r"), scalar.concat(F.col("c_name"), F.lit(None), F.col("c_mktsegment")).alias("c"), scalar.substring0(F.col("c_name"), 2, 4).alias("z"))


@query("trim_functions", "SELECT event_id, trim(chr(9) || ' ' || event_type || '  ', ' ' || chr(9)) AS t, ltrim('  ' || event_type) AS l, rtrim(event_type || '  ') AS r FROM events")
def _(spark, d):
    pad = F.concat(F.lit("\t "), F.col("event_type"), F.lit("  "))
    return events(spark, d).select("event_id", scalar.trim(pad).alias("t"), scalar.ltrim(F.concat(F.lit("  "), F.col("event_type"))).alias("l"), scalar.rtrim(F.concat(F.col("event_type"), F.lit("  "))).alias("r"))


@query("numeric_functions", "SELECT event_id, abs(value - 50) AS a, CAST(floor(value) AS BIGINT) AS f, CAST(ceil(value) AS BIGINT) AS c, CASE WHEN user_id = 0 THEN NULL ELSE event_id // user_id END AS q FROM events")
def _(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", F.abs(v - 50).alias("a"), F.floor(v).alias("f"), F.ceil(v).alias("c"), scalar.divide(F.col("event_id"), F.col("user_id")).alias("q"))


@query("feature_math", "SELECT event_id, round(ln(value + 1), 6) AS l, round(log10(value + 1), 6) AS g, round(sqrt(abs(value)), 6) AS s, round((value - 50) / 10, 6) AS z, round(value / 100, 6) AS m, round(power(value, 2), 4) AS p FROM events")
def _(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", F.round(F.log(v + 1), 6).alias("l"), F.round(F.log10(v + 1), 6).alias("g"), F.round(F.sqrt(F.abs(v)), 6).alias("s"), F.round(scalar.normalise(v, 50, 10), 6).alias("z"), F.round(scalar.min_max(v, 0, 100), 6).alias("m"), F.round(F.pow(v, F.lit(2)), 4).alias("p"))


@query("feature_time", "SELECT event_id, hour(ts) AS h, (isodow(ts) - 1) AS dow, isodow(ts) >= 6 AS weekend, hour(ts) >= 9 AND hour(ts) < 17 AS business, strftime(ts, '%G') || '-W' || strftime(ts, '%V') AS week FROM events")
def _(spark, d):
    t = F.col("ts")
    return events(spark, d).select("event_id", scalar.hour_of_day(t).alias("h"), scalar.day_of_week(t).alias("dow"), scalar.is_weekend(t).alias("weekend"), scalar.is_business_hours(t).alias("business"), scalar.time_partition(t, "weekly").alias("week"))


# --- aggregation
sql("group_aggregates", "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, ROUND(SUM(value), 3) AS total, ROUND(AVG(value), 6) AS mean, MIN(value) AS low, MAX(value) AS high FROM events GROUP BY event_type")
sql("global_empty", "SELECT COUNT(*) AS n, MAX(value) AS m FROM events WHERE value < -1000000")
sql("having", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 60 AND AVG(value) > 0")
sql("distinct_rows", "SELECT DISTINCT event_type, user_id % 5 AS u FROM events")
sql("cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
sql("rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
sql("grouping_sets", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("deviations", "SELECT event_type, ROUND(STDDEV_POP(value), 6) AS sp, ROUND(STDDEV_SAMP(value), 6) AS ss, ROUND(VAR_POP(value), 4) AS vp, ROUND(VAR_SAMP(value), 4) AS vs FROM events GROUP BY event_type")
sql("percentile_cont", "SELECT event_type, ROUND(PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY value), 6) AS med FROM events GROUP BY event_type")


@query("first_last", "SELECT event_type, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(agg.first_by(F.col("value"), F.col("ts")).alias("first_value"), agg.last_by(F.col("value"), F.col("ts")).alias("last_value"))


@query("nearest_rank", "SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(least(floor(count(*) * 99.0 / 100), count(*) - 1) AS BIGINT) + 1] AS f99 FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(agg.nearest_rank(F.col("value"), 0.95).alias("p95"), agg.floor_rank(F.col("value"), 99).alias("f99"))


@query("top_k", "SELECT event_type, array_to_string(list_sort(list(event_id), 'DESC')[1:3], ',') AS top FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.array_join(agg.top_k(F.col("event_id"), 3), ",").alias("top"))


@query("string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(agg.joined(F.col("n_name")).alias("names"))


@query("array_agg_nulls", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    v = F.when(F.col("value") > 20, F.col("value"))
    return events(spark, d).groupBy("event_type").agg(F.size(agg.array_with_nulls(v)).cast("long").alias("n"))


@query("histogram", "SELECT event_type, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("event_type").agg(*[c.alias(n) for n, c in agg.cumulative_buckets(F.col("value"), [10, 50, 100]).items()])


@query("summary_stats", "SELECT event_type, count(value) AS n, round(sum(value), 3) AS s, round(avg(value), 6) AS m, min(value) AS lo, max(value) AS hi, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1")
def _(spark, d):
    v = F.col("value")
    return events(spark, d).groupBy("event_type").agg(F.count(v).alias("n"), F.round(agg.total(v), 3).alias("s"), F.round(F.avg(v), 6).alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(agg.deviation(v), 6).alias("sd"))


# --- analytic windows
sql("row_number", "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
sql("ranks", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_totalprice AS BIGINT)) AS r, DENSE_RANK() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_totalprice AS BIGINT)) AS dr FROM orders",
    "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderpriority ORDER BY CAST(trunc(o_totalprice) AS BIGINT)) AS r, DENSE_RANK() OVER (PARTITION BY o_orderpriority ORDER BY CAST(trunc(o_totalprice) AS BIGINT)) AS dr FROM orders")
sql("ntile", "SELECT event_id, NTILE(4) OVER (PARTITION BY event_type ORDER BY event_id) AS quarter FROM events")
sql("lag_lead", "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, LEAD(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events")
sql("first_last_over", "SELECT event_id, FIRST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts) AS f, LAST_VALUE(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM events")
sql("running_total", "SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS avg3 FROM events")
sql("range_frame", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM events")

# --- order, limit, sets
sql("order_limit_offset", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 5")
sql("nulls_order", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS LAST, o_orderkey LIMIT 50")
sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
sql("except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem")

# --- joins
sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000")
sql("join_right", "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
sql("join_full", "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s.s_nationkey = c.c_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_using", "SELECT l_orderkey, o_totalprice, l_quantity FROM (SELECT l_orderkey, l_orderkey AS k, l_quantity FROM lineitem) a JOIN (SELECT o_orderkey AS k, o_totalprice FROM orders) b USING (k)")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT c_nationkey AS k, c_custkey AS b FROM customer) y")
sql("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
sql("star_revenue", "SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi(table(spark, d, "customer"), big, "c_custkey").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return joins.anti(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


CLICKS = "(SELECT event_id AS a_id, user_id AS a_user, ts AS a_ts FROM events WHERE event_type = 'click') a"
BUYS = "(SELECT event_id AS b_id, user_id AS b_user, ts AS b_ts, value AS b_value FROM events WHERE event_type = 'purchase') b"


def pick(spark, d, kind, p):
    return events(spark, d).where(F.col("event_type") == kind).select(F.col("event_id").alias(p + "_id"), F.col("user_id").alias(p + "_user"), F.col("ts").alias(p + "_ts"), F.col("value").alias(p + "_value"))


@query("join_interval", f"SELECT a_id, b_id FROM {CLICKS} JOIN {BUYS} ON a_user = b_user AND a_ts - b_ts BETWEEN INTERVAL '-6 hours' AND INTERVAL '2 hours'")
def _(spark, d):
    return joins.interval(pick(spark, d, "click", "a"), pick(spark, d, "purchase", "b"), [("a_user", "b_user")], "a_ts", "b_ts", -6 * 3600, 2 * 3600).select("a_id", "b_id")


@query("join_within", f"SELECT a_id AS left_a_id, b_id AS right_b_id FROM {CLICKS} JOIN {BUYS} ON a_user = b_user AND abs(epoch_us(a_ts) - epoch_us(b_ts)) <= 3600000000")
def _(spark, d):
    j = joins.Join(pick(spark, d, "click", "a")).with_(pick(spark, d, "purchase", "b")).on(("a_user", "b_user")).within("a_ts", "b_ts", 3600).prefixed()
    return j.build().select("left_a_id", "right_b_id")


@query("join_as_of", f"SELECT a_id, b_id AS table_b_id FROM {CLICKS} ASOF LEFT JOIN {BUYS} ON a_user = b_user AND a_ts >= b_ts")
def _(spark, d):
    b = pick(spark, d, "purchase", "b").withColumnRenamed("b_user", "a_user")
    return joins.as_of(pick(spark, d, "click", "a"), b, ["a_user"], "a_ts", "b_ts", "b_id").select("a_id", "table_b_id")


@query("point_in_time", f"SELECT a_id, b_value AS buy_value FROM {CLICKS} ASOF LEFT JOIN {BUYS} ON a_user = b_user AND a_ts >= b_ts")
def _(spark, d):
    feature = pick(spark, d, "purchase", "b").select(F.col("b_user").alias("a_user"), F.col("b_ts").alias("ts"), F.col("b_value").alias("value"))
    return joins.point_in_time(pick(spark, d, "click", "a"), {"buy": feature}, "a_user", "a_ts").select("a_id", "buy_value")


# --- event-time windows
@query("window_hopping", "SELECT w AS window_start, w + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY ALL")
def _(spark, d):
    return windows.hopping(events(spark, d), "ts", "2 hours", "1 hour", ["event_type"], n=F.count("*"))


SESSIONS = "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) {} INTERVAL '4 hours' THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) "


@query("window_session", SESSIONS.format(">") + "SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '4 hours' AS window_end, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    return windows.session(events(spark, d), "ts", "4 hours", ["user_id"], n=F.count("*"))


@query("feature_session", SESSIONS.format(">") + "SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def _(spark, d):
    return windows.feature_session(events(spark, d), "ts", 4 * 3600, ["user_id"], total=F.round(F.sum("value"), 4))


@query("window_count", "SELECT user_id, CAST((rn - 1) // 5 AS BIGINT) AS window_no, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events) GROUP BY 1, 2")
def _(spark, d):
    return windows.count_window(events(spark, d), ["ts"], 5, ["user_id"], n=F.count("*"), total=F.round(F.sum("value"), 4))


@query("window_trailing", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS n FROM events")
def _(spark, d):
    return windows.trailing(events(spark, d), "ts", 86_400, ["user_id"], n=F.count("*")).select("event_id", "n")


@query("window_sliding_exact", "SELECT ts, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return windows.sliding_exact(events(spark, d), "ts", ["event_type"], n=F.count("*"))


# --- series
@query("downsample", "SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS bucket, round(avg(value), 6) AS value_avg, max(value) AS value_max, arg_max(value, ts) AS value_last FROM events GROUP BY 1, 2")
def _(spark, d):
    got = timeseries.downsample(events(spark, d), "ts", "value", 6 * 3600, ["event_type"], "avg", "max", "last")
    return got.withColumn("value_avg", F.round("value_avg", 6))


@query("series_rollup", "SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS bucket, round(sum(value), 3) AS sum, count(value) AS count, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def _(spark, d):
    day = timeseries.rollup(events(spark, d), "ts", "value", [60, 300, 3600, 86_400], ["event_type"])[86_400]
    return day.select("event_type", "bucket", F.round("sum", 3).alias("sum"), "count", "min", "max")


@query("series_filter", "SELECT event_id FROM events WHERE event_type LIKE '%ic%' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, d):
    e = events(spark, d)
    return e.where(timeseries.metric_matches(F.col("event_type"), "ic") & timeseries.in_range(F.col("ts"), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12))).select("event_id")


@query("series_latest", "SELECT event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return timeseries.latest(events(spark, d), "event_type", "ts").select("event_type", "event_id")


@query("time_travel", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1")
def _(spark, d):
    return timeseries.snapshot(events(spark, d), ["user_id"], "ts", dt.datetime(2024, 1, 10)).select("user_id", "event_id")


DIFF_SQL = "WITH a AS (SELECT user_id, arg_max(event_type, ts) AS e FROM events WHERE ts <= TIMESTAMP '2024-01-03' GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, ts) AS e FROM events WHERE ts <= TIMESTAMP '2024-01-06' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.e IS NULL THEN 'added' WHEN b.e IS NULL THEN 'removed' WHEN a.e = b.e THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id"


@query("snapshot_diff", DIFF_SQL)
def _(spark, d):
    e = events(spark, d)
    a, b = (timeseries.snapshot(e, ["user_id"], "ts", dt.datetime(2024, 1, day)) for day in (3, 6))
    return timeseries.diff(a, b, ["user_id"], ["event_type"])


# --- logs
@query("log_compaction", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return logs.compact(events(spark, d), "user_id", "event_id").select("user_id", "event_id")


@query("retention_time", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def _(spark, d):
    return logs.retain_time(events(spark, d), "ts", dt.datetime(2024, 1, 20)).select("event_id")


@query("retention_bytes", "SELECT event_id FROM (SELECT event_id, sum(strlen(props)) OVER (PARTITION BY event_type ORDER BY event_id DESC) AS s FROM events) WHERE s <= 2000")
def _(spark, d):
    return logs.retain_bytes(events(spark, d), "event_type", "event_id", F.octet_length("props"), 2000).select("event_id")


@query("consumer_lag", "SELECT user_id, max(event_id) - max(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) AS lag FROM events GROUP BY 1")
def _(spark, d):
    e = events(spark, d)
    done = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("committed"))
    return logs.lag(e.groupBy("user_id").agg(F.max("event_id").alias("latest")), done, ["user_id"]).select("user_id", "lag")


@query("partition_skew", "SELECT partitions, round(mean, 4) AS mean, round(cv, 6) AS cv, CASE WHEN cv < 0.2 THEN 'none' WHEN cv < 0.5 THEN 'low' WHEN cv < 1 THEN 'moderate' WHEN cv < 1.5 THEN 'high' ELSE 'critical' END AS severity FROM (SELECT count(*) AS partitions, avg(n) AS mean, stddev_pop(n) / avg(n) AS cv FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1))")
def _(spark, d):
    return logs.skew(table(spark, d, "documents"), "source").select("partitions", F.round("mean", 4).alias("mean"), F.round("cv", 6).alias("cv"), "severity")


@query("dead_letters", "SELECT event_id, 'too large' AS dlq_reason FROM events WHERE NOT value <= 80")
def _(spark, d):
    return logs.dead_letters(events(spark, d), F.col("value") <= 80, "too large")[1].select("event_id", "dlq_reason")


@query("producer_dedup", "SELECT user_id, seq, min(event_id) AS event_id FROM (SELECT user_id, event_id, event_id % 10 AS seq FROM events) GROUP BY 1, 2")
def _(spark, d):
    e = events(spark, d).select("user_id", "event_id", (F.col("event_id") % 10).alias("seq"), F.col("event_id").alias("at"))
    return logs.first_of_sequence(e, "user_id", "seq", "at").select("user_id", "seq", "event_id")


@query("conflict_resolution", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", F.col("event_id").alias("at"))
    return logs.resolve(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "at").select("user_id", "event_id")


@query("forget_keys", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 20)")
def _(spark, d):
    return logs.forget(events(spark, d), table(spark, d, "customer").where("c_custkey < 20").select(F.col("c_custkey").alias("user_id")), "user_id").select("event_id")


@query("contract_checks", "SELECT 'positive' AS \"check\", count(*) FILTER (NOT value > 5) AS violations FROM events UNION ALL SELECT 'known', count(*) FILTER (NOT event_type IN ('click', 'view')) FROM events UNION ALL SELECT 'pattern', count(*) FILTER (NOT regexp_matches(props, 'k')) FROM events")
def _(spark, d):
    return logs.contract(events(spark, d), {"positive": F.col("value") > 5, "known": F.col("event_type").isin("click", "view"), "pattern": F.col("props").rlike("k")})


@query("lineage_closure", "WITH RECURSIVE e AS (SELECT r_name AS src, n_name AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey), r AS (SELECT (SELECT min(r_name) FROM region) AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM r JOIN e ON src = node) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1")
def _(spark, d):
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    edges = r.join(n, r.r_regionkey == n.n_regionkey).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst")).union(n.join(s, s.s_nationkey == n.n_nationkey).select("n_name", "s_name"))
    return logs.closure(spark, edges, r.agg(F.min("r_name")).first()[0])


@query("crdt_counter", "SELECT event_type, sum(m) AS value FROM (SELECT event_type, user_id, max(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1".replace("sum(m)", "round(sum(m), 4)"))
def _(spark, d):
    return logs.g_counter(events(spark, d), "event_type", "user_id", "value").select("event_type", F.round("value", 4).alias("value"))


@query("crdt_lww", "SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY 1")
def _(spark, d):
    return logs.lww(events(spark, d), "user_id", "value", "ts", "event_id")


@query("crdt_or_set", "SELECT DISTINCT user_id AS element FROM events WHERE event_type = 'signup' AND event_id % 3 <> 0")
def _(spark, d):
    e = events(spark, d).where("event_type = 'signup'").select(F.col("user_id").alias("element"), F.col("event_id").alias("tag"))
    return logs.or_set(e, e.where("tag % 3 = 0"))


# --- reading and writing
def log_of(spark, d):
    return topics.records(events(spark, d), "event_id", "ts", "user_id", F.to_json(F.struct("event_type", "value")))


@query("topic_read", "SELECT event_id AS \"offset\", CAST(user_id % 4 AS INTEGER) AS partition FROM events WHERE event_id >= 100 AND event_id < 900 AND ts + INTERVAL '20 days' > TIMESTAMP '2024-01-25'")
def _(spark, d):
    got = topics.alive(topics.committed(topics.by_offset(log_of(spark, d), 100), 900), 20 * 86_400, dt.datetime(2024, 1, 25))
    return got.select("offset", "partition")


@query("topic_bounds", "SELECT CAST(user_id % 4 AS INTEGER) AS partition, min(event_id) AS earliest, max(event_id) AS latest FROM events GROUP BY 1")
def _(spark, d):
    return topics.bounds(log_of(spark, d))


@query("offset_at_time", "SELECT CAST(user_id % 4 AS INTEGER) AS partition, min(event_id) AS \"offset\" FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def _(spark, d):
    return topics.offset_at(log_of(spark, d), topics.time_point("1d", dt.datetime(2024, 1, 16)))


@query("grep_and_pick", "SELECT event_id AS \"offset\", event_type AS value FROM events WHERE regexp_matches(event_type, '^(cl|pur)')")
def _(spark, d):
    return topics.grep(topics.pick(log_of(spark, d), "$.event_type"), "^(CL|PUR)", ignore_case=True).select("offset", "value")


@query("message_search", "SELECT doc_id AS \"offset\" FROM documents WHERE contains(lower(text), 'idiot') ORDER BY doc_id LIMIT 1000")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("offset"), F.col("text").alias("value"))
    return topics.search(docs, "IDIOT", 5000).select("offset")


@query("topic_stats", "SELECT count(*) AS messages, round(count(*) / 86400.0, 8) AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def _(spark, d):
    return topics.stats(log_of(spark, d), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11), 86_400.0).select("messages", F.round("rate", 8).alias("rate"))


@query("columnar_read", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def _(spark, d):
    return topics.columnar(spark, f"{d}/events.parquet", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12), ["event_id", "ts"], "ts")


@query("sink_partitioned", "SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "sink")
    sinks.partitioned(events(spark, d), path, "ts", "day")
    return spark.read.option("recursiveFileLookup", "false").parquet(path).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n"))


@query("export_round_trip", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    path = scratch(spark, "export")
    sinks.export(events(spark, d).select("event_id", "event_type", "value"), path, "json")
    return spark.read.schema("event_id long, event_type string, value double").json(path)


@query("merge_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return sinks.merge(c, c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("line_protocol", "SELECT 'm,event_type=' || event_type || ' value=' || event_id || ' ' || (epoch_us(ts) * 1000) AS line FROM events")
def _(spark, d):
    return sinks.line_protocol(events(spark, d), "m", "event_id", ["event_type"], "ts")


# --- patterns, anomalies, trends
def purchase_path(d_frame):
    t = F.col("event_type")
    return cep.Pattern().begin("signup", t == "signup").not_followed_by("error", t == "error").followed_by("buy", (t == "purchase") & (F.col("value") > 20)).within(3 * 86_400)


@query("cep_strict", "SELECT user_id, ts AS match_start, n AS match_end FROM (SELECT *, lead(event_type) OVER w AS e2, lead(ts) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND e2 = 'click'")
def _(spark, d):
    t = F.col("event_type")
    p = cep.Pattern().begin("view", t == "view").followed_by("click", t == "click").strictly()
    return cep.match(events(spark, d), p, "user_id", "ts", "event_id").select("user_id", "match_start", "match_end")


@query("z_score", "SELECT event_id, CASE WHEN n >= 10 AND s > 0 THEN abs((value - m) / s) > 1.5 ELSE false END AS is_anomaly FROM (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))")
def _(spark, d):
    return anomaly.z_score(events(spark, d), "user_id", ["ts"], "value", threshold=1.5).select("event_id", "is_anomaly")


@query("iqr", "SELECT event_id, q1, q3, coalesce(value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5, false) AS is_anomaly FROM (SELECT event_id, value, CASE WHEN len(s) >= 20 THEN s[len(s) // 4 + 1] END AS q1, CASE WHEN len(s) >= 20 THEN s[len(s) * 3 // 4 + 1] END AS q3 FROM (SELECT event_id, value, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) AS s FROM events))")
def _(spark, d):
    return anomaly.iqr(events(spark, d), "user_id", ["ts"], "value").select("event_id", "q1", "q3", "is_anomaly")


@query("trend", "SELECT user_id, round(regr_slope(value, x), 6) AS slope, CASE WHEN regr_slope(value, x) / abs(avg(value)) > 0.01 THEN 'up' WHEN regr_slope(value, x) / abs(avg(value)) < -0.01 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts)::DOUBLE AS x FROM events) GROUP BY 1")
def _(spark, d):
    return anomaly.trend(events(spark, d), "user_id", ["ts"], "value").withColumn("slope", F.round("slope", 6))


# --- vectors and text
COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS n FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 5).alias("n"))


@query("vector_quantise", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS BIGINT) AS ones FROM embeddings")
def _(spark, d):
    bits = vector.quantise_binary(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x).alias("ones"))


WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
KEYWORD = f"WITH h AS (SELECT doc_id AS id, unnest(list_filter(['idiot', 'the', 'trash'], lambda w: list_contains({WORDS}, w))) AS w FROM documents), f AS (SELECT w, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM h GROUP BY 1), s AS (SELECT id, sum(idf) AS s FROM h JOIN f USING (w) GROUP BY 1) "


@query("keyword_search", KEYWORD + "SELECT id, round(s / (SELECT max(s) FROM s), 6) AS score FROM s")
def _(spark, d):
    return vector.keyword_search(table(spark, d, "documents"), "doc_id", "text", "the idiot trash").withColumn("score", F.round("score", 6))


@query("hybrid_search", KEYWORD + ", k AS (SELECT id, s / (SELECT max(s) FROM s) AS score FROM s), c AS (SELECT a.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0) SELECT coalesce(c.id, k.id) AS id, round(0.7 * coalesce(c.score, 0) + (1 - 0.7) * coalesce(k.score, 0), 6) AS score FROM c FULL JOIN k ON c.id = k.id")
def _(spark, d):
    v = table(spark, d, "embeddings")
    one = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    sem = v.join(one).select(F.col("vec_id").alias("id"), vector.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return vector.hybrid(sem, vector.keyword_search(table(spark, d, "documents"), "doc_id", "text", "the idiot trash")).withColumn("score", F.round("score", 6))


@query("chunk_fixed", "SELECT doc_id AS id, CAST(g AS BIGINT) AS chunk, substring(text, CAST(g * 450 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 50) / 450.0), 1) AS BIGINT))) AS g FROM documents WHERE length(text) > 0)")
def _(spark, d):
    return vector.chunk_fixed(table(spark, d, "documents"), "doc_id", "text", 500, 50)


@query("token_frequency", "SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, w LIMIT 25")
def _(spark, d):
    t = table(spark, d, "documents").select(F.explode(vector.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(25)


# --- transforms
@query("smt_chain", "SELECT event_id AS id, '****' AS event_type, value, 'v1' AS version FROM events WHERE NOT value > 50")
def _(spark, d):
    steps = (transforms.drop_where(F.col("value") > 50), transforms.insert_field("version", "v1"), transforms.mask("event_type"), transforms.replace_field(exclude=["props", "ts", "user_id"], rename={"event_id": "id"}))
    return transforms.chain(events(spark, d), *steps)


@query("mask_partial", "SELECT c_custkey, repeat('*', CAST(length(c_name) - 4 AS BIGINT)) || right(c_name, 4) AS c_name FROM customer")
def _(spark, d):
    return transforms.mask("c_name", how="partial")(table(spark, d, "customer")).select("c_custkey", "c_name")


@query("flatten", "SELECT event_id, event_type AS a_event_type, value AS a_b_value FROM events")
def _(spark, d):
    nested = events(spark, d).select("event_id", F.struct("event_type", F.struct("value").alias("b")).alias("a"))
    return transforms.flatten()(nested)


@query("json_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') <> '5'")
def _(spark, d):
    return transforms.json_filter("props", "k", "neq", "5")(events(spark, d)).select("event_id")


@query("route_topic", "SELECT event_id, 't-' || event_type || '-' || strftime(ts, '%Y%m%d') AS topic FROM events")
def _(spark, d):
    e = events(spark, d).withColumn("topic", F.col("event_type"))
    return transforms.chain(e, transforms.route_regex("topic", "^", "t-"), transforms.route_time("topic", "ts")).select("event_id", "topic")


@query("cdc_apply", "SELECT user_id, event_id FROM (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS op FROM events GROUP BY 1) WHERE op <> 'error'")
def _(spark, d):
    e = events(spark, d).select("user_id", "event_id", F.when(F.col("event_type") == "error", "d").otherwise("u").alias("op"), F.col("event_id").alias("at"))
    return transforms.apply_changes(e, ["user_id"], "op", "at").select("user_id", "event_id")


@query("debezium_envelope", "SELECT event_id, event_type AS e, event_id AS ts_ms FROM events")
def _(spark, d):
    e = events(spark, d)
    row = F.struct("event_type")
    env = e.select("event_id", F.to_json(F.struct(row.alias("after"), F.lit("c").alias("op"), F.col("event_id").alias("ts_ms"))).alias("value"))
    return transforms.debezium(env, "value", "event_type: string").select("event_id", F.col("after.event_type").alias("e"), "ts_ms")


# --- builders
@query("pipeline_builder", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY ALL HAVING count(*) > 5")
def _(spark, d):
    p = Pipeline(events(spark, d)).filter("value > 10").map(twice=F.col("value") * 2).tumbling("ts", "1 day").group_by("event_type").aggregate(n=F.count("*"))
    return p.having("n > 5").frame()


@query("flow_graph", "SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def _(spark, d):
    nodes = {
        "c": ("source", {"frame": table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")}),
        "n": ("source", {"frame": table(spark, d, "nation")}),
        "f": ("filter", {"condition": "c_acctbal > 0"}),
        "j": ("join", {"on": "n_nationkey"}),
        "a": ("aggregate", {"keys": ["n_regionkey"], "aggs": {"n": F.count("*")}}),
    }
    return flow(nodes, [("c", "f"), ("f", "j"), ("n", "j"), ("j", "a")], "a")


# --- cells, embeddings, standing queries
KNN = f"SELECT query_id, id, round(s, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS id, {COS} AS s, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) AS r FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0) WHERE r <= 5"
CELLS, PROBES = 16, 12  # these vectors lie nearly at random, so that many cells are probed for a recall over 0.9


def knn_in_cells(spark, d, probes):
    v = table(spark, d, "embeddings")
    c = cells.centres(cells.sample(v, "vec_id", "embedding"), CELLS)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))  # the stated query set
    return cells.nearest(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 5, c, probes, in_blocks=True).withColumn("similarity", F.round("similarity", 6))


@query("knn_cells")
def _(spark, d):
    return knn_in_cells(spark, d, PROBES)


@query("knn_all_cells", KNN)
def _(spark, d):
    return knn_in_cells(spark, d, CELLS)


@query("knn", KNN)
def _(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))  # the stated query set
    return vector.nearest(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 5, in_blocks=True).withColumn("similarity", F.round("similarity", 6))


@query("semantic_partitions")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return cells.partition(v, "embedding", cells.centres(cells.sample(v, "vec_id", "embedding"), CELLS)).select("vec_id", "cell")


@query("hash_embedding", "SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda w: 1 + 0.5 * greatest(strlen(w) - 2, 0))), 0)::DOUBLE AS total FROM documents")
def _(spark, d):
    e = table(spark, d, "documents").select("doc_id", embedding.embed(F.col("text")).alias("e"))
    return e.select("doc_id", F.aggregate("e", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double")).alias("total"))


@query("similarity_subscription", f"SELECT a.vec_id AS id, b.vec_id AS subscription, round({COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND {COS} >= 0.3")
def _(spark, d):
    v = table(spark, d, "embeddings")
    standing = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("subscription"), F.col("embedding").alias("query"))  # the stated query set
    return embedding.subscribe(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), standing, 0.3, in_blocks=True).withColumn("similarity", F.round("similarity", 6))


@query("chunk_recursive")
def _(spark, d):
    return embedding.chunk(table(spark, d, "documents"), "doc_id", "text", 500)


@query("chunk_semantic")
def _(spark, d):
    return embedding.chunk(table(spark, d, "documents"), "doc_id", "text", 500, how="semantic")


# --- schemas, functions, questions
@query("schema_summary", "SELECT k AS field, 'number' AS type, count(*) AS occurrences, 100.0 * count(*) / (SELECT count(*) FROM events) AS share FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def _(spark, d):
    return schemas.summary(events(spark, d), "props")


@query("user_functions", "SELECT event_type, round(max(value * 2) - min(value * 2), 6) AS width FROM events GROUP BY 1")
def _(spark, d):
    held = Functions(spark)
    held.scalar("tidemill_twice", lambda x: None if x is None else x * 2, ["double"], "double", "twice a value")
    held.aggregate("tidemill_width", lambda: (None, None), lambda s, x: s if x is None else (x if s[0] is None else min(s[0], x), x if s[1] is None else max(s[1], x)), lambda s: None if s[0] is None else s[1] - s[0], ["double"], "double")
    try:
        return spark.sql("SELECT event_type, round(tidemill_width(tidemill_twice(value)), 6) AS width FROM {e} GROUP BY event_type", e=events(spark, d))
    finally:
        for f in held.list():
            held.remove(f.name)


@query("question_sql", "SELECT avg(value) AS average FROM events")
def _(spark, d):
    e = events(spark, d)
    catalog = Catalog(spark, "ts")
    catalog.topic("events", e)
    return catalog.sql(questions.translate("What is the average value in events?", {"events": e.columns}, "ts").sql)


# --- traces, logs, fits
@query("trace_assembly", "SELECT user_id AS trace_id, count(*) AS spans, arg_min(event_id, ts) FILTER (event_id % 3 = 0) AS root_span, min(ts) AS started, max(ts + INTERVAL '90 seconds') AS ended, CASE WHEN bool_or(event_id % 3 = 0) THEN 90000 END AS duration_ms FROM events GROUP BY 1")
def _(spark, d):
    spans = events(spark, d).select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") - 1).alias("parent"), "ts", (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("te"))
    return observe.traces(spans, "user_id", "event_id", "parent", "ts", "te")


@query("log_query", "SELECT event_id FROM events WHERE event_type IN ('error', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND contains(props, '1') AND user_id = 7")
def _(spark, d):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "warn").otherwise("debug")
    e = events(spark, d).select("event_id", "ts", level.alias("level"), F.col("props").alias("body"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("attributes"), F.lit(None).cast("string").alias("trace_id"))
    return observe.log_query(e, "WARN", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20), "1", {"user": "7"}).select("event_id")


@query("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING), 6) AS average FROM events")
def _(spark, d):
    return observe.moving_average(events(spark, d), "user_id", ["ts"], "value", 5).select("event_id", F.round("average", 6).alias("average"))


@query("linear_fit", "SELECT 0 AS power, round(regr_intercept(o_totalprice, o_custkey), 2) AS coefficient FROM orders UNION ALL SELECT 1, round(regr_slope(o_totalprice, o_custkey), 2) FROM orders")
def _(spark, d):
    line = observe.polynomial(table(spark, d, "orders"), F.col("o_custkey"), F.col("o_totalprice"))
    return spark.createDataFrame([(i, round(c, 2)) for i, c in enumerate(line)], "power int, coefficient double")


# --- records
@query("json_edit", "SELECT event_id, '{\"key\":' || json_extract_string(props, '$.k') || ',\"v\":\"1\"}' AS props FROM events")
def _(spark, d):
    return transforms.json_edit("props", ("x",), {"k": "key"}, {"v": "1"})(events(spark, d)).select("event_id", "props")


@query("json_flatten", "SELECT event_id, '{\"a.b\":' || user_id || ',\"a.c.0\":1,\"a.c.1\":2}' AS value FROM events")
def _(spark, d):
    nested = F.to_json(F.struct(F.struct(F.col("user_id").alias("b"), F.array(F.lit(1), F.lit(2)).alias("c")).alias("a")))
    return transforms.json_flatten("value")(events(spark, d).select("event_id", nested.alias("value")))


@query("mask_hash", "SELECT c_custkey, 'masked_' || lpad(lower(to_hex(CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616::HUGEINT) AS UBIGINT))), 16, '0') AS c_name FROM customer")
def _(spark, d):
    return transforms.mask("c_name", how="hash")(table(spark, d, "customer")).select("c_custkey", "c_name")


@query("timestamp_header", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS at FROM events")
def _(spark, d):
    e = events(spark, d).select("event_id", F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))).alias("value"), F.lit(None).cast("map<string,string>").alias("headers"))
    return transforms.timestamp_header("value", "t")(e).select("event_id", F.col("headers")["x-extracted-timestamp"].alias("at"))


@query("cdc_route", "SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN 'c' WHEN event_id % 2 = 0 THEN 'even' ELSE 'rest' END AS topic FROM events")
def _(spark, d):
    e = events(spark, d).withColumn("db", F.lit("shop"))
    return transforms.route_changes([("c", transforms.table_glob("shop.c*", "db", "event_type")), ("even", F.col("event_id") % 2 == 0)], "rest")(e).select("event_id", "topic")


# --- materialised views
@query("view_refresh", "SELECT n_regionkey, sum(n) AS n FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    held = Views(spark, scratch(spark, "views"))
    held.source("customer", table(spark, d, "customer"))
    held.source("nation", table(spark, d, "nation"))
    held.define("regions", lambda f: f["nations"].join(f["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("n").alias("n")), ["nations", "nation"])
    held.define("nations", View("customer").where("c_acctbal > 0").group_by("c_nationkey").aggregate(n=F.count("*")))
    held.refresh("regions")
    return held.read("regions")


@query("view_deltas", "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def _(spark, d):
    e = events(spark, d)
    first, later = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").withColumn("sign", F.lit(1))
    gone = e.where("event_id % 5 = 0").withColumn("sign", F.lit(-1))
    return apply_deltas(counted(first, ["user_id"], "event_id"), later.unionByName(gone), ["user_id"], "event_id")


# --- streaming, checked against the batch result
@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    s = runs.windowed(runs.source(spark, d, "events", "ts"), "ts", "1 hour", "1 hour", ["event_type"], n=F.count("*"))
    got = runs.drain_complete(s, scratch(spark, "out"), scratch(spark, "checkpoint"))
    return got.select(F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz"), "event_type", "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    s = runs.source(spark, d, "events", "ts").withWatermark("ts", "60 days").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")
    return runs.drain(s, scratch(spark, "out"), scratch(spark, "checkpoint"))


@query("stream_join", f"SELECT a_id, b_id FROM {CLICKS} JOIN {BUYS} ON a_user = b_user AND a_ts >= b_ts - INTERVAL '1 hour' AND a_ts <= b_ts + INTERVAL '1 hour'")
def _(spark, d):
    e = runs.source(spark, d, "events", "ts")
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("a_id"), F.col("user_id").alias("a_user"), F.col("ts").alias("a_ts"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"))
    j = runs.interval_join(a, b, ("a_user", "b_user"), "a_ts", "b_ts", "2 hours", 3600).select("a_id", "b_id")
    return runs.drain(j, scratch(spark, "out"), scratch(spark, "checkpoint"))


@query("alert_runs", "WITH g AS (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM events) SELECT user_id, min(ts) AS started, min(ts) + INTERVAL '1 hour' AS fired, max(ts) AS ended FROM g WHERE value > 20 GROUP BY user_id, k HAVING max(ts) - min(ts) >= INTERVAL '1 hour'")
def _(spark, d):
    return runs.alerts(events(spark, d), "value", 20, "user_id", "ts", 3600)


from . import queries_more  # noqa: E402, F401
