"""Further queries over the driver's tables with their DuckDB SQL; queries.py imports them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .functions import aggregates as agg
from .functions import scalar
from .operators import anomaly, joins, logs, observe, ranks, schemas, timeseries, transforms, vector, windows
from .plans import expressions
from .plans.builder import Pipeline, flow
from .plans.catalog import Catalog
from .plans.dialect import DialectError
from .plans.views import apply_value_deltas, change_feed, counted_values, summed
from .queries import BUYS, CLICKS, events, pick, query, sql, table
from .session import scratch_path as scratch
from .sources import avro, cdc, connect, lake, sinks, topics
from .streaming import runs

# --- SQL: topics, names, functions with semantics of their own
for name, source in (("topic_function", "any_topic('events')"), ("topic_view_name", "topic_events_view"), ("topic_table_name", "topic_events")):

    def _(spark, d, source=source):
        catalog = Catalog(spark, "ts")
        catalog.topic("events", events(spark, d))
        return catalog.sql(f"SELECT event_type, COUNT(*) AS n FROM {source} GROUP BY event_type")

    query(name, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(_)


@query("topic_autosync", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    return Catalog(spark, "ts", folder=d).sql("SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("topic_list", "SELECT 'nation' AS name, CAST(3 AS INTEGER) AS columns, count(*) AS rows FROM nation UNION ALL SELECT 'region', CAST(2 AS INTEGER), count(*) FROM region")
def _(spark, d):
    catalog = Catalog(spark)
    for t in ("nation", "region"):
        catalog.topic(t, table(spark, d, t))
    return catalog.tables(rows=True)


sql("default_names", "SELECT event_id, UPPER(event_type), user_id + 1 FROM events", "SELECT event_id, upper(event_type) AS upper, user_id + 1 AS expr_2 FROM events")
sql("default_aggregate_names", "SELECT event_type, COUNT(*), MAX(value) FROM events GROUP BY event_type", "SELECT event_type, count(*) AS agg_1, max(value) AS agg_2 FROM events GROUP BY 1")
sql("star_of_alias", "SELECT e.* FROM (SELECT event_id, value FROM events) e WHERE e.value > 10", "SELECT event_id, value FROM events WHERE value > 10")
sql("divide_whole", "SELECT event_id, event_id / 7 AS q, event_id * 3 / (user_id % 4) AS z, value / 2 AS h FROM events", "SELECT event_id, CAST(event_id // 7 AS DOUBLE) AS q, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(event_id * 3 // (user_id % 4) AS DOUBLE) END AS z, value / 2 AS h FROM events")
sql("sum_is_double", "SELECT event_type, SUM(event_id) AS s, AVG(CAST(user_id AS VARCHAR(9))) AS a FROM events GROUP BY event_type", "SELECT event_type, CAST(sum(event_id) AS DOUBLE) AS s, avg(user_id) AS a FROM events GROUP BY 1")
sql("concat_skips_nulls", "SELECT event_id, CONCAT(event_type, NULLIF(event_type, 'click'), user_id) AS c FROM events", "SELECT event_id, event_type || coalesce(nullif(event_type, 'click'), '') || user_id AS c FROM events")
sql("array_agg_keeps_nulls", "SELECT event_type, array_join(array_agg(NULLIF(user_id % 3, 0) ORDER BY event_id), ',', '-') AS a FROM events WHERE event_id < 200 GROUP BY event_type", "SELECT event_type, array_to_string(list(coalesce(CAST(nullif(user_id % 3, 0) AS VARCHAR), '-') ORDER BY event_id), ',') AS a FROM events WHERE event_id < 200 GROUP BY 1")
sql("trim_any_space", "SELECT event_id, TRIM(' ' || event_type || '\t ') AS t, LTRIM('  ' || event_type) AS l, RTRIM(event_type || '  ') AS r FROM events", "SELECT event_id, event_type AS t, event_type AS l, event_type AS r FROM events")
sql("substring_clamped", "SELECT event_id, SUBSTRING(event_type, 0, 3) AS a, SUBSTRING(event_type, 2, -1) AS b FROM events", "SELECT event_id, substring(event_type, 1, 3) AS a, '' AS b FROM events")
sql("json_operands", "SELECT event_id, (props) -> 'k' AS k, CAST(lower(props) ->> 'k' AS BIGINT) + 1 AS n FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS n FROM events")
sql("string_agg_sql", "SELECT n_regionkey, STRING_AGG(n_name, ';' ORDER BY n_name DESC) AS names, LISTAGG(n_name) AS l FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names, string_agg(n_name, ',' ORDER BY n_name) AS l FROM nation GROUP BY 1")
sql("topk_sql", "SELECT event_type, array_join(TOPK(event_id, 3), ',') AS top, EARLIEST(event_id) AS a, LATEST(event_id) AS b, array_join(COLLECT_SET(user_id % 3), ',') AS s FROM events GROUP BY event_type", "SELECT event_type, array_to_string(list_sort(list(event_id), 'DESC')[1:3], ',') AS top, arg_min(event_id, ts) AS a, arg_max(event_id, ts) AS b, array_to_string(list_sort(list(DISTINCT user_id % 3)), ',') AS s FROM events GROUP BY 1")
sql("approx_distinct", "SELECT event_type, ABS(APPROX_COUNT_DISTINCT(user_id) - COUNT(DISTINCT user_id)) <= 0.15 * COUNT(DISTINCT user_id) AS near FROM events GROUP BY event_type", "SELECT event_type, true AS near FROM events GROUP BY 1")
sql("now_is_later", "SELECT event_id, NOW() > ts AS past, now_ms() > 1700000000000 AS ms FROM events", "SELECT event_id, true AS past, true AS ms FROM events")
sql("age_and_epoch", "SELECT event_id, CAST(EXTRACT('EPOCH', epoch_ms(event_id * 1000)) AS BIGINT) AS s, AGE(ts, ts - INTERVAL '2' DAY) = INTERVAL '2' DAY AS two FROM events", "SELECT event_id, event_id AS s, true AS two FROM events")
sql("window_partition_by", "SELECT COUNT(*) AS n FROM topic('events') WINDOW TUMBLING(INTERVAL '1 day') PARTITION BY event_type", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
sql("window_ksql_hopping", "SELECT event_type, COUNT(*) AS n FROM topic('events') WINDOW HOPPING (SIZE 2 HOURS, ADVANCE BY 1 HOUR, GRACE PERIOD 10 MINUTES) GROUP BY event_type EMIT CHANGES", "SELECT w AS window_start, w + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY ALL")
sql("window_ms_clause", "SELECT event_type, SUM(value) AS s, FIRST_VALUE(event_id) AS f FROM topic('events') WINDOW TUMBLING SIZE 3600000 GROUP BY event_type HAVING COUNT(*) > 1", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, sum(value) AS s, arg_min(event_id, ts) AS f FROM events GROUP BY ALL HAVING count(*) > 1")
sql("window_session_clause", "SELECT user_id, COUNT(*) AS n FROM topic('events') WINDOW SESSION (GAP 14400000) GROUP BY user_id", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '4 hours' THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '4 hours' AS window_end, count(*) AS n FROM s GROUP BY user_id, k")
sql("window_sliding_clause", "SELECT event_type, COUNT(*) AS n FROM topic('events') WINDOW SLIDING(INTERVAL '1 hour') GROUP BY event_type", "SELECT ts - INTERVAL '1 hour' AS window_start, ts AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
sql("window_distinct", "SELECT DISTINCT COUNT(*) AS n FROM topic('events') WINDOW TUMBLING(INTERVAL '1 day')", "SELECT DISTINCT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, count(*) AS n FROM events GROUP BY 1, 2")
sql("join_within_sql", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM (SELECT * FROM events WHERE event_type = 'click') a JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id WITHIN INTERVAL '1 hour'", f"SELECT a_id, b_id FROM {CLICKS} JOIN {BUYS} ON a_user = b_user AND abs(epoch_us(a_ts) - epoch_us(b_ts)) <= 3600000000")


@query("trailing_text_raises", "SELECT 'SELECT 1 FROM t SELECT 2' AS statement, true AS raised UNION ALL SELECT 'SELECT 1 AS a b c', true")
def _(spark, d):
    def raised(text):
        try:
            Catalog(spark).sql(text).count()
            return False
        except Exception as e:
            return "PARSE_SYNTAX_ERROR" in str(e) or isinstance(e, DialectError)

    return spark.createDataFrame([(t, raised(t)) for t in ("SELECT 1 FROM t SELECT 2", "SELECT 1 AS a b c")], "statement string, raised boolean")


@query("insert_into", "SELECT event_id AS id, event_type AS kind, CAST(NULL AS DOUBLE) AS value FROM events WHERE value > 50 UNION ALL SELECT -1, 'x', NULL")
def _(spark, d):
    catalog = Catalog(spark, "ts", root=scratch(spark, "topics"))
    catalog.topic("events", events(spark, d))
    catalog.sql("CREATE STREAM big_events (id BIGINT, kind VARCHAR, value DOUBLE)")
    catalog.sql("INSERT INTO big_events (id, kind) SELECT event_id, event_type FROM topic('events') WHERE value > 50")
    catalog.sql("INSERT INTO big_events (id, kind) VALUES (-1, 'x')")
    return catalog.sql("SELECT id, kind, value FROM big_events")


@query("emit_to", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    catalog = Catalog(spark, "ts", root=scratch(spark, "topics"))
    catalog.topic("events", events(spark, d))
    catalog.sql("SELECT event_type, COUNT(*) AS n FROM topic('events') GROUP BY event_type EMIT TO 'counts'")
    return catalog.sql("SELECT * FROM topic('counts')")


@query("statements", "SELECT 'alert' AS kind, 'busy' AS name UNION ALL SELECT 'query', 'v' UNION ALL SELECT 'stream', 'events' UNION ALL SELECT 'stream', 'v'")
def _(spark, d):
    catalog = Catalog(spark, "ts")
    catalog.topic("events", events(spark, d))
    for s in ("CREATE STREAM VIEW v AS SELECT * FROM topic('events')", "CREATE TABLE gone AS SELECT 1 AS one", "CREATE ALERT busy AS SELECT * FROM topic('events') WHERE value > 10 NOTIFY webhook 'http://x'", "PAUSE v", "RESUME v", "TERMINATE gone"):
        catalog.sql(s)
    parts = [catalog.sql(f"SHOW {k}").selectExpr(f"'{n}' AS kind", "name") for k, n in (("ALERTS", "alert"), ("QUERIES", "query"), ("STREAMS", "stream"))]
    return parts[0].union(parts[1]).union(parts[2])


@query("alerts_firing", "SELECT 'busy' AS alert, 'http://x' AS notify, count(*) AS matches FROM events WHERE value > 90 HAVING count(*) > 0")
def _(spark, d):
    catalog = Catalog(spark, "ts")
    catalog.topic("events", events(spark, d))
    catalog.sql("CREATE ALERT busy AS SELECT * FROM topic('events') WHERE value > 90 NOTIFY webhook 'http://x'")
    catalog.sql("CREATE ALERT never AS SELECT * FROM topic('events') WHERE value < -1 NOTIFY webhook 'http://y'")
    return catalog.firing()


@query("pages_follow_the_topic", "SELECT r_regionkey + CAST(10 AS INTEGER) AS k FROM region")
def _(spark, d):
    catalog, out = Catalog(spark), []
    for shift in (0, 10):
        catalog.topic("r", table(spark, d, "region").selectExpr(f"CAST(r_regionkey + {shift} AS BIGINT) AS k"))
        out, cursor = [], None
        while True:
            rows, cursor = catalog.page("SELECT k FROM topic('r') ORDER BY k", 2, cursor)
            out += rows
            if cursor is None:
                break
    return spark.createDataFrame([(r["k"],) for r in out], "k long")


# --- expressions as data
SPEC = {"if": {"op": "and", "left": {"op": "gt", "left": {"field": "value"}, "right": {"var": "limit"}}, "right": {"op": "in", "left": {"field": "event_type"}, "values": ["click", "view"]}}, "then": {"call": "CONCAT", "args": [{"call": "UPPER", "args": [{"field": "event_type"}]}, "-", {"call": "SUBSTRING", "args": [{"field": "event_type"}, 1, 2]}]}, "else": {"value": "none"}}


@query("expression_spec", "SELECT event_id, CASE WHEN value > 20 AND event_type IN ('click', 'view') THEN upper(event_type) || '-' || substring(event_type, 2, 2) ELSE 'none' END AS tag, -value AS n, event_type LIKE 'c%' OR contains(event_type, 'ie') AS l FROM events WHERE NOT value IS NULL")
def _(spark, d):
    col = expressions.column
    p = Pipeline(events(spark, d)).filter(col({"op": "is_not_null", "of": {"field": "value"}}))
    like = {"op": "or", "left": {"op": "like", "left": {"field": "event_type"}, "right": "c%"}, "right": {"op": "contains", "left": {"field": "event_type"}, "right": "ie"}}
    p = p.map(tag=col(SPEC, {"limit": 20}), n=col({"op": "neg", "of": {"field": "value"}}), l=col(like))
    return p.project("event_id", "tag", "n", "l").frame()


@query("pipeline_project", "SELECT event_id, event_type AS kind FROM events")
def _(spark, d):
    return Pipeline(events(spark, d)).project("event_id", kind="event_type").frame()


@query("flow_windows", "SELECT time_bucket(INTERVAL '2 hours', ts) AS window_start, time_bucket(INTERVAL '2 hours', ts) + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY ALL")
def _(spark, d):
    nodes = {"s": ("source", {"frame": events(spark, d)}), "f": ("filter", {"condition": "value > 5"}), "w": ("window", {"ts": "ts", "size": "2 hours", "keys": ["event_type"], "aggs": {"n": F.count("*")}})}
    return flow(nodes, [("s", "f"), ("f", "w")], "w")


# --- joins with nulls, several tables
@query("as_of_nulls", f"WITH a AS (SELECT a_id, CASE WHEN a_id % 5 = 0 THEN NULL ELSE a_user END AS a_user, CASE WHEN a_id % 7 = 0 THEN NULL ELSE a_ts END AS a_ts FROM {CLICKS}), b AS (SELECT b_id, b_user, b_ts FROM {BUYS} WHERE b_id % 4 <> 0 AND b_id % 6 <> 0) SELECT a_id, b_id AS table_b_id FROM a ASOF LEFT JOIN b ON a_user = b_user AND a_ts >= b_ts")
def _(spark, d):
    a = pick(spark, d, "click", "a").withColumn("a_user", F.when(F.col("a_id") % 5 != 0, F.col("a_user"))).withColumn("a_ts", F.when(F.col("a_id") % 7 != 0, F.col("a_ts")))
    b = pick(spark, d, "purchase", "b").withColumn("a_user", F.when(F.col("b_id") % 4 != 0, F.col("b_user"))).withColumn("b_ts", F.when(F.col("b_id") % 6 != 0, F.col("b_ts"))).drop("b_user")
    return joins.as_of(a, b, ["a_user"], "a_ts", "b_ts", "b_id").select("a_id", "table_b_id")


@query("features_of_two_tables", f"SELECT a.a_id, b.b_value AS buy_value, e.v AS error_value FROM (SELECT a_id, b_value, a_user, a_ts FROM {CLICKS} ASOF LEFT JOIN {BUYS} ON a_user = b_user AND a_ts >= b_ts) b JOIN (SELECT a_id FROM {CLICKS}) a USING (a_id) ASOF LEFT JOIN (SELECT user_id AS u, ts AS t, value AS v FROM events WHERE event_type = 'error') e ON a_user = u AND a_ts >= t")
def _(spark, d):
    side = lambda k: pick(spark, d, k, "b").select(F.col("b_user").alias("a_user"), F.col("b_ts").alias("ts"), F.col("b_value").alias("value"))
    return joins.point_in_time(pick(spark, d, "click", "a"), {"buy": side("purchase"), "error": side("error")}, "a_user", "a_ts").select("a_id", "buy_value", "error_value")


@query("feature_expiry", "SELECT user_id, event_type, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2")
def _(spark, d):
    return logs.features_as_of(events(spark, d), "user_id", "event_type", "value", "ts", dt.datetime(2024, 1, 20), 10 * 86_400).select("user_id", "event_type", "value")


# --- aggregates
@query("ranks_without_lists", "SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(least(floor(count(*) * 99.0 / 100), count(*) - 1) AS BIGINT) + 1] AS f99 FROM events GROUP BY 1")
def _(spark, d):
    return ranks.at_ranks(events(spark, d), ["event_type"], "value", p95=ranks.nearest(0.95), f99=ranks.floored(99))


NEAR = "list_sort(list(value))[CAST(floor((count(*) - 1) * {} + 0.5) AS BIGINT) + 1]"


@query("summary_percentiles", f"SELECT event_type, count(value) AS count, round(sum(value), 3) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS stddev, {NEAR.format(0.5)} AS p50, {NEAR.format(0.95)} AS p95, {NEAR.format(0.99)} AS p99 FROM events GROUP BY 1")
def _(spark, d):
    return ranks.summary(events(spark, d), ["event_type"], "value").withColumns({"sum": F.round("sum", 3), "avg": F.round("avg", 6), "stddev": F.round("stddev", 6)})


@query("top_rows", "SELECT event_type, event_id, CAST(r AS INTEGER) AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def _(spark, d):
    return ranks.top(events(spark, d), ["event_type"], 5, F.desc("value"), F.col("event_id")).select("event_type", "event_id", "rank")


@query("value_histogram", "SELECT event_type, user_id % 4 AS v, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return ranks.value_histogram(events(spark, d).withColumn("v", F.col("user_id") % 4), ["event_type"], "v")


@query("hll_distinct", "SELECT event_type, true AS near FROM events GROUP BY 1")
def _(spark, d):
    got = events(spark, d).groupBy("event_type").agg(agg.distinct_sketch(F.col("user_id")).alias("a"), F.count_distinct("user_id").alias("b"))
    return got.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("near"))


@query("downsample_fields", "SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, f AS field, round(avg(v), 6) AS avg, count(v) AS count, max(v) AS max, arg_max(v, event_id) AS last FROM (SELECT ts, event_id, 'v' AS f, value AS v FROM events UNION ALL SELECT ts, event_id, 'u', user_id FROM events) GROUP BY 1, 2")
def _(spark, d):
    e = events(spark, d).withColumn("values", F.create_map(F.lit("v"), F.col("value"), F.lit("u"), F.col("user_id").cast("double")))
    return timeseries.downsample_fields(e, "ts", "values", 6 * 3600, "avg", "count", "max", "last", order="event_id").withColumn("avg", F.round("avg", 6))


@query("fields_map", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, min(value) AS v_min, max(value) AS v_max FROM events GROUP BY 1")
def _(spark, d):
    e = events(spark, d).withColumn("values", F.create_map(F.lit("V"), F.col("value")))
    got = timeseries.fields_map(timeseries.downsample_fields(e, "ts", "values", 86_400, "min", "max"), "min", "max")
    return got.select("bucket", F.col("values")["v_min"].alias("v_min"), F.col("values")["v_max"].alias("v_max"))


def points(spark, d):
    tags = F.map_filter(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("odd"), F.when(F.col("event_id") % 2 == 1, F.lit("yes"))), lambda k, v: v.isNotNull())
    return events(spark, d).select("event_id", "ts", F.concat(F.lit("m."), "event_type").alias("metric"), "value", tags.alias("tags"))


@query("tag_filters", "SELECT event_id FROM events WHERE (event_id % 2 = 1 AND regexp_matches(CAST(user_id AS VARCHAR), '^1') OR event_type LIKE 'cl%') AND NOT (value > 60) AND value BETWEEN 1 AND 90")
def _(spark, d):
    spec = ("and", ("or", ("and", ("has", "odd"), ("tag", "odd", "yes"), ("tag_like", "user", "^1")), ("metric_like", "^m[.]cl")), ("not", ("above", 60)), ("between", 1, 90))
    return points(spark, d).where(timeseries.tag_filter(spec)).select("event_id")


@query("metric_list", "SELECT DISTINCT 'm.' || event_type AS metric FROM events")
def _(spark, d):
    return timeseries.metrics(points(spark, d))


@query("group_by_tags", "SELECT CAST(user_id AS VARCHAR) AS user, time_bucket(INTERVAL '7 days', ts - INTERVAL '3 days') + INTERVAL '3 days' AS bucket, max(value) AS value_max FROM events WHERE false GROUP BY 1, 2 UNION ALL SELECT CAST(user_id AS VARCHAR), time_bucket(INTERVAL '1 day', ts), max(value) FROM events GROUP BY 1, 2")
def _(spark, d):
    p = points(spark, d).withColumn("user", F.col("tags")["user"])
    return timeseries.downsample(p, "ts", "value", 86_400, ["user"], "max")


@query("rollup_first_last", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS bucket, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events GROUP BY 1, 2")
def _(spark, d):
    return timeseries.rollup(events(spark, d), "ts", "value", [60, 3600], ["event_type"])[3600].select("event_type", "bucket", "first", "last")


@query("groups_frame", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id % 10 GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM events")
def _(spark, d):
    return windows.groups_frame(events(spark, d).withColumn("u", F.col("user_id") % 10), ["event_type"], ["u"], 1, 1, n=F.count("*")).select("event_id", "n")


@query("global_window", "SELECT event_type, count(*) AS n, max(value) AS m FROM events GROUP BY 1")
def _(spark, d):
    return windows.whole(events(spark, d), ["event_type"], n=F.count("*"), m=F.max("value"))


@query("deltas_with_extremes", "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, avg(event_id) AS mean, min(event_id) AS least, max(event_id) AS most FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def _(spark, d):
    e = events(spark, d)
    later, gone = e.where("event_id % 2 = 1").withColumn("sign", F.lit(1)), e.where("event_id % 5 = 0").withColumn("sign", F.lit(-1))
    state = apply_value_deltas(counted_values(e.where("event_id % 2 = 0"), ["user_id"], "event_id"), later.unionByName(gone), ["user_id"], "event_id")
    return summed(state, ["user_id"], "event_id")


@query("change_feed", "WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.n IS NULL THEN 'insert' WHEN b.n IS NULL THEN 'delete' ELSE 'update' END AS change, coalesce(b.n, a.n) AS n FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.n IS DISTINCT FROM b.n")
def _(spark, d):
    a, b = (events(spark, d).where(f"event_id % {k} = 0").groupBy("user_id").agg(F.count("*").alias("n")) for k in (3, 2))
    return change_feed(a, b, ["user_id"])


@query("crdt_pn_counter", "SELECT event_type, sum(a) - sum(t) AS value FROM (SELECT event_type, user_id, max(event_id) AS a, max(event_id % 7) AS t FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    e = events(spark, d).withColumn("t", F.col("event_id") % 7)
    return logs.pn_counter(e, "event_type", "user_id", "event_id", "t")


@query("crdt_sequence", "WITH RECURSIVE e AS (SELECT user_id AS doc, event_id AS id, CASE WHEN row_number() OVER w = 1 THEN NULL ELSE CASE WHEN row_number() OVER w % 3 = 0 THEN first_value(event_id) OVER w ELSE lag(event_id) OVER w END END AS after, event_type AS v, event_id % 4 = 0 AS gone FROM events WHERE event_id < 1500 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT doc, id, v, gone, [-id] AS p FROM e WHERE after IS NULL UNION ALL SELECT e.doc, e.id, e.v, e.gone, list_append(r.p, -e.id) FROM r JOIN e ON e.doc = r.doc AND e.after = r.id) SELECT doc, v, CAST(row_number() OVER (PARTITION BY doc ORDER BY p) AS INTEGER) AS place FROM r WHERE NOT gone")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    n, first = F.row_number().over(w), F.first("event_id").over(w)
    e = events(spark, d).where("event_id < 1500").select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), F.when(n == 1, None).when(n % 3 == 0, first).otherwise(F.lag("event_id").over(w)).alias("after"), F.col("event_type").alias("v"), (F.col("event_id") % 4 == 0).alias("gone"))
    return logs.sequence(e.unionByName(e.where("id % 8 = 0")), "doc", "id", "after", "v", "gone")


# --- features of texts, quantising, routes
@query("feature_text", "SELECT c_custkey, len(regexp_extract_all(c_name || ' ' || c_mktsegment, '\\S+')) AS words, strlen(c_name) AS size FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.word_count(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("words"), scalar.length(F.col("c_name")).alias("size"))


@query("hash_string", "SELECT n_nationkey, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS h FROM (SELECT n_nationkey, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(n_name, ''), lambda c: ord(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616::HUGEINT) AS h FROM nation)")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", scalar.hash31(F.col("n_name")).alias("h"))


@query("quantise_whole", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: round(greatest(least(x::DOUBLE, 1), -1) * 127)::BIGINT)) AS BIGINT) AS i8, CAST(list_sum(list_transform(embedding, lambda x: round(greatest(least(x::DOUBLE, 1), -1) * 7)::BIGINT + 8)) AS BIGINT) AS i4 FROM embeddings")
def _(spark, d):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    four = F.transform(vector.quantise_i4(F.col("embedding")), lambda b: (b % 16) + F.floor(b / 16).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", total(vector.clamped(F.col("embedding"), 127)).alias("i8"), total(four).alias("i4"))


RULES = {"abuse": ["idiot", "trash", "scum"], "english": ["the", "of", "and"], "german": ["der", "die", "und"]}
HAS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
SCORE = "len(list_filter([{}], lambda w: list_contains({}, w))) / 3.0"


@query("semantic_route", "WITH s AS (SELECT doc_id, unnest([" + ", ".join(f"{{'s': {SCORE.format(', '.join(repr(w) for w in ws), HAS)}, 'r': '{n}'}}" for n, ws in sorted(RULES.items())) + "]) AS x FROM documents), o AS (SELECT doc_id, list(x.r ORDER BY x.s DESC, x.r DESC) AS r, max(x.s) AS m FROM s GROUP BY 1) SELECT doc_id AS id, CASE WHEN m >= 0.5 THEN r[1] ELSE 'default' END AS route, round(m, 6) AS score, array_to_string(CASE WHEN m >= 0.5 THEN r[2:] ELSE r END, ',') AS alternatives FROM o")
def _(spark, d):
    got = vector.route(table(spark, d, "documents"), "doc_id", "text", RULES, 0.5)
    return got.select("id", "route", F.round("score", 6).alias("score"), F.array_join("alternatives", ",").alias("alternatives"))


@query("route_near", "WITH r AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id IN (0, 1, 2)), s AS (SELECT a.vec_id AS id, 'r' || q AS r, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS s FROM embeddings a, r) SELECT id, CASE WHEN max(s) >= 0.2 THEN arg_max(r, s) ELSE 'default' END AS route, round(max(s), 6) AS score FROM s GROUP BY 1")
def _(spark, d):
    v = table(spark, d, "embeddings")
    rules = {f"r{r['vec_id']}": r["embedding"] for r in v.where("vec_id IN (0, 1, 2)").collect()}
    return vector.route_near(v, "vec_id", "embedding", rules, 0.2).select("id", "route", F.round("score", 6).alias("score"))


@query("chunk_sentences", "SELECT doc_id AS id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS BIGINT) AS n FROM documents WHERE trim(text) <> ''")
def _(spark, d):
    return vector.chunk_sentences(table(spark, d, "documents"), "doc_id", "text").groupBy("id").agg(F.count("*").alias("n"))


# --- ordered values, by recursion in SQL
CHAIN = "WITH RECURSIVE o AS (SELECT event_id, user_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), r AS ("
STEP = " FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) "


@query("ema", CHAIN + "SELECT user_id, i, event_id, v AS m, 0::DOUBLE AS q, false AS a FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.event_id, r.m + (2 / 21.0::DOUBLE) * (o.v - r.m), (1 - 2 / 21.0::DOUBLE) * (r.q + (2 / 21.0::DOUBLE) * (o.v - r.m) * (o.v - r.m)), o.i > 10 AND r.q > 0 AND abs(o.v - r.m) > 3 * sqrt(r.q)" + STEP + "SELECT event_id, round(m, 5) AS ema, a AS is_anomaly FROM r")
def _(spark, d):
    got = anomaly.ema(events(spark, d).select("event_id", "user_id", "ts", "value"), "user_id", ["ts"], "value")
    return got.select("event_id", F.round("ema", 5).alias("ema"), "is_anomaly")


@query("ewma", CHAIN + "SELECT user_id, i, event_id, v AS m, 0::DOUBLE AS q, NULL::DOUBLE AS d FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.event_id, r.m + 0.3::DOUBLE * (o.v - r.m), 0.7::DOUBLE * (r.q + 0.3::DOUBLE * (o.v - r.m) * (o.v - r.m)), CASE WHEN o.i > 10 AND r.q > 0 THEN abs(o.v - r.m) / sqrt(r.q) END" + STEP + "SELECT event_id, round(d, 5) AS deviation, coalesce(d > 3, false) AS is_anomaly FROM r")
def _(spark, d):
    return anomaly.ewma(events(spark, d), "user_id", ["ts"], "value").select("event_id", F.round("deviation", 5).alias("deviation"), "is_anomaly")


@query("holt_forecast", CHAIN + "SELECT user_id, i, event_id, v AS l, 0::DOUBLE AS t FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.event_id, 0.5::DOUBLE * o.v + 0.5::DOUBLE * (r.l + r.t), 0.3::DOUBLE * (0.5::DOUBLE * o.v + 0.5::DOUBLE * (r.l + r.t) - r.l) + 0.7::DOUBLE * r.t" + STEP + "SELECT event_id, round(l + t, 5) AS forecast FROM r")
def _(spark, d):
    return anomaly.holt(events(spark, d).select("event_id", "user_id", "ts", "value"), "user_id", ["ts"], "value").select("event_id", scalar.round_binary(F.col("forecast"), 5).alias("forecast"))


@query("window_capped_session", "WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), r AS (SELECT user_id, i, ts, ts AS b, 0 AS s FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.ts, CASE WHEN o.ts - r.ts > INTERVAL '4 hours' OR o.ts - r.b > INTERVAL '12 hours' THEN o.ts ELSE r.b END, CASE WHEN o.ts - r.ts > INTERVAL '4 hours' OR o.ts - r.b > INTERVAL '12 hours' THEN r.s + 1 ELSE r.s END" + STEP + "SELECT user_id, CAST(s AS BIGINT) AS session, min(ts) AS window_start, max(ts) AS window_end, count(*) AS events FROM r GROUP BY user_id, s")
def _(spark, d):
    return windows.capped_session(events(spark, d), "ts", 4 * 3600, 12 * 3600, "user_id")


PAST = "FROM (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS s FROM events)"


@query("local_outliers", f"SELECT event_id, round(lof, 6) AS lof, coalesce(lof > 2, false) AS is_anomaly FROM (SELECT event_id, CASE WHEN len(s) >= 10 THEN CASE WHEN list_sum(d) > 0 THEN d[-1] / (list_sum(d) / len(d)) ELSE 1 END END AS lof FROM (SELECT event_id, s, list_sort(list_transform(s, lambda x: abs(x - value)))[1:5] AS d {PAST}))")
def _(spark, d):
    return anomaly.local_outliers(events(spark, d), "user_id", ["ts"], "value").select("event_id", F.round("lof", 6).alias("lof"), "is_anomaly")


@query("isolation_values", f"SELECT event_id, round(i, 6) AS isolation, coalesce(i < 0.1, false) AS is_anomaly FROM (SELECT event_id, CASE WHEN len(s) >= 10 THEN len(list_filter(s, lambda x: (list_avg(s) - value >= 0) <> (list_avg(s) - x >= 0) AND abs(x) < abs(value))) / len(s) END AS i {PAST})")
def _(spark, d):
    return anomaly.isolation(events(spark, d), "user_id", ["ts"], "value").select("event_id", F.round("isolation", 6).alias("isolation"), "is_anomaly")


@query("seasons", "WITH x AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS d, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), v AS (SELECT event_type, avg(d * d) AS v FROM x GROUP BY 1), c AS (SELECT a.event_type, p AS period, sum(a.d * b.d) / count(*) / any_value(v.v) AS correlation FROM x a CROSS JOIN range(2, 65) t(p) JOIN x b ON b.event_type = a.event_type AND b.i = a.i + p JOIN v ON v.event_type = a.event_type WHERE p <= a.n // 2 GROUP BY 1, 2) SELECT event_type, period, round(correlation, 6) AS correlation FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY correlation DESC, period) AS r FROM c WHERE correlation > 0.01) WHERE r <= 3")
def _(spark, d):
    return anomaly.seasons(events(spark, d), "event_type", ["ts"], "value", least=0.01).withColumn("correlation", F.round("correlation", 6))


@query("z_values", "SELECT event_id, round(CASE WHEN n >= 10 AND s > 0 THEN (value - m) / s END, 5) AS z FROM (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))")
def _(spark, d):
    return anomaly.z_score(events(spark, d), "user_id", ["ts"], "value").select("event_id", F.round("z", 5).alias("z"))


@query("cep_pattern", "SELECT user_id, match_start, match_end, first_id, last_id FROM (SELECT s.user_id, s.ts AS match_start, s.event_id AS first_id, (SELECT min(b.ts) FROM events b WHERE b.user_id = s.user_id AND b.ts > s.ts AND b.event_type = 'purchase' AND b.value > 20) AS match_end, (SELECT arg_min(b.event_id, b.ts) FROM events b WHERE b.user_id = s.user_id AND b.ts > s.ts AND b.event_type = 'purchase' AND b.value > 20) AS last_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = s.user_id AND x.ts > s.ts AND x.event_type = 'error') AS banned FROM events s WHERE s.event_type = 'signup') WHERE match_end - match_start <= INTERVAL '3 days' AND (banned IS NULL OR banned > match_end)")
def _(spark, d):
    from .operators import cep
    from .queries import purchase_path

    got = cep.match(events(spark, d), purchase_path(None), "user_id", "ts", "event_id")
    return got.select("user_id", "match_start", "match_end", F.col("ids")[0].alias("first_id"), F.col("ids")[1].alias("last_id"))


# --- records, logs, sources
@query("sample_records", "SELECT event_id AS \"offset\" FROM events WHERE ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT % 10000 < 2500")
def _(spark, d):
    return topics.sample(topics.records(events(spark, d), "event_id", "ts", "user_id", F.col("props")), 25, seed=7).select("offset")


@query("log_projections", "SELECT event_id AS \"offset\", ts AS timestamp, props AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def _(spark, d):
    log = topics.records(events(spark, d), "event_id", "ts", "user_id", F.col("props"))
    path = scratch(spark, "segment")
    sinks.segments(log, path, row_group_bytes=1 << 20, bloom=("key",))
    return topics.project(topics.columnar(spark, path, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6), log.columns), "minimal")


@query("topic_store", "SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    path, packed = scratch(spark, "store"), scratch(spark, "store-packed")
    e = events(spark, d).select("event_id", "value", F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"))
    sinks.topic_store(e.where("event_id % 2 = 0"), path)
    sinks.topic_store(e.where("event_id % 2 = 1"), path)
    sinks.topic_store(spark.read.parquet(path).coalesce(4), packed)
    return spark.read.parquet(packed).groupBy("topic", "partition").agg(F.count("*").alias("n"))


@query("lake_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -1, 1.0")
def _(spark, d):
    held = lake.Lake(spark, scratch(spark, "lake"))
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    held.append(c.where("c_custkey % 2 = 0"))
    held.append(c.where("c_custkey % 2 = 1"))
    held.merge(c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(1.0)).unionByName(spark.createDataFrame([(-1, 1.0)], c.schema)), ["c_custkey"])
    held.optimize(2)
    held.vacuum()
    return held.read()


@query("lake_time_travel", "SELECT 0 AS version, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 1, count(*) FROM customer UNION ALL SELECT 2, count(*) FROM supplier")
def _(spark, d):
    held = lake.Lake(spark, scratch(spark, "lake"))
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    held.append(c.where("k % 2 = 0"))
    held.append(c.where("k % 2 = 1"))
    held.overwrite(s)
    times = [v["time"] for v in held.versions()]
    rows = [(0, held.read(version=0).count()), (1, held.read(at=times[1]).count()), (2, held.read().count())]
    return spark.createDataFrame(rows, "version int, n long")


@query("lake_records", "SELECT event_id AS \"offset\", json_extract_string(props, '$.k') AS _partition_value FROM events")
def _(spark, d):
    log = topics.records(events(spark, d), "event_id", "ts", "user_id", F.col("props"))
    return lake.records(log, "field", "k").select("offset", "_partition_value")


@query("stream_to_lake", "SELECT event_id, event_type FROM events")
def _(spark, d):
    held, checkpoint = lake.Lake(spark, scratch(spark, "lake")), scratch(spark, "checkpoint")
    for _ in range(2):  # a second run finds nothing new
        lake.bind(runs.source(spark, d, "events", "ts").select("event_id", "event_type"), held, checkpoint).awaitTermination()
    return held.read()


@query("cdc_postgres", "SELECT 'public.e' AS \"table\", CASE event_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'u' ELSE 'd' END AS op, CASE WHEN event_id % 3 < 2 THEN event_type END AS e, CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR) END AS was FROM events")
def _(spark, d):
    pair = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value"))
    action = F.element_at(F.array(F.lit("I"), F.lit("U"), F.lit("D")), (F.col("event_id") % 3 + 1).cast("int"))
    line = F.to_json(F.struct(action.alias("action"), F.lit("public").alias("schema"), F.lit("e").alias("table"), F.when(F.col("event_id") % 3 < 2, F.array(pair("id", "event_id"), pair("event_type", "event_type"))).alias("columns"), F.when(F.col("event_id") % 3 == 2, F.array(pair("id", "event_id"))).alias("identity")))
    got = cdc.postgres(events(spark, d).select(line.alias("value")))
    return got.select("table", "op", F.get_json_object("after", "$.event_type").alias("e"), F.get_json_object("before", "$.id").alias("was"))


@query("cdc_mysql", "SELECT 'shop.e' AS \"table\", CASE WHEN event_id % 2 = 0 THEN 'c' ELSE 'd' END AS op, event_type AS e, event_id * 1000 AS at_ms FROM events")
def _(spark, d):
    line = F.to_json(F.struct(F.lit("shop").alias("database"), F.lit("e").alias("table"), F.when(F.col("event_id") % 2 == 0, "insert").otherwise("delete").alias("type"), F.col("event_id").alias("ts"), F.struct("event_type").alias("data")))
    got = cdc.mysql(events(spark, d).select(line.alias("value")))
    return got.select("table", "op", F.get_json_object(F.coalesce("after", "before"), "$.event_type").alias("e"), "at_ms")


@query("cdc_mongodb", "SELECT 'shop.e' AS \"table\", 'u' AS op, event_type AS e FROM events")
def _(spark, d):
    line = F.to_json(F.struct(F.lit("replace").alias("operationType"), F.struct(F.lit("shop").alias("db"), F.lit("e").alias("coll")).alias("ns"), F.struct("event_type").alias("fullDocument")))
    return cdc.mongodb(events(spark, d).select(line.alias("value"))).select("table", "op", F.get_json_object("after", "$.event_type").alias("e"))


@query("cdc_sqlserver", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'u' ELSE 'd' END AS op FROM events")
def _(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("id"), "event_type", F.col("event_id").cast("string").alias("__$start_lsn"))
    rows = e.where("id % 2 = 1").withColumn("__$operation", F.lit(1)).unionByName(e.where("id % 2 = 0").withColumn("__$operation", F.lit(3))).unionByName(e.where("id % 2 = 0").withColumn("__$operation", F.lit(4)))
    return cdc.sqlserver(rows, "dbo.e", ["id", "event_type"]).select(F.get_json_object(F.coalesce("after", "before"), "$.id").cast("long").alias("id"), "op")


@query("debezium_round_trip", "SELECT event_id, event_type AS e, epoch_us(ts) // 1000 AS ts_ms FROM events")
def _(spark, d):
    e = events(spark, d).withColumn("row", F.to_json(F.struct("event_type"))).withColumn("op", F.lit("c"))
    made = transforms.to_envelope(e, None, "row", "op", "ts").select("event_id", F.regexp_replace(F.regexp_replace("value", r'\\"', '"'), r'"(\{.*?\})"', "$1").alias("value"))
    return transforms.debezium(made, "value", "event_type: string").select("event_id", F.col("after.event_type").alias("e"), "ts_ms")


@query("federated_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    path = scratch(spark, "nations")
    sinks.export(table(spark, d, "nation").select("n_nationkey", "n_name"), path, "csv")
    connect.attach(spark, "far_nation", "csv", path=path)
    connect.attach(spark, "far_customer", "parquet", path=f"{d}/customer.parquet")
    return spark.sql("SELECT n_name, count(*) AS n FROM far_customer JOIN far_nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("sink_payloads", "SELECT '{\"index\":{\"_index\":\"' || event_type || '\",\"_id\":\"' || event_id || '\"}}' || chr(10) || props || chr(10) AS payload FROM events UNION ALL SELECT event_type || chr(9) || event_id || chr(9) || props FROM events UNION ALL SELECT '{\"text\":\"[' || event_type || '] x\"}' FROM events")
def _(spark, d):
    rows = events(spark, d).select(F.col("event_type").alias("topic"), F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").alias("timestamp"))
    return connect.payloads(rows, "elasticsearch").union(connect.payloads(rows, "console")).union(connect.payloads(rows.withColumn("value", F.lit("x")), "slack"))


@query("function_batches", "SELECT count(*) AS n FROM events")
def _(spark, d):
    rows = events(spark, d).select(F.to_json(F.struct("event_id")).alias("payload"))
    return connect.batched(rows, 100).select(F.sum(F.size(F.from_json("payload", "records array<struct<event_id: long>>")["records"])).alias("n"))


@query("prometheus_lines", "SELECT 'm{event_type=\"' || event_type || '\"} ' || event_id AS line FROM events")
def _(spark, d):
    return sinks.prometheus(events(spark, d), "m", "event_id", ["event_type"])


@query("otlp_points", "SELECT '{\"name\":\"m\",\"gauge\":{\"dataPoints\":[{\"timeUnixNano\":\"' || (epoch_us(ts) * 1000) || '\",\"asDouble\":' || event_id || '.0,\"attributes\":[{\"key\":\"t\",\"value\":{\"stringValue\":\"' || event_type || '\"}}]}]}}' AS line FROM events")
def _(spark, d):
    return sinks.otlp_points(events(spark, d).withColumn("t", F.col("event_type")), "m", "event_id", ["t"], "ts")


@query("metric_json", "SELECT '{\"name\":\"m\",\"value\":' || event_id || ',\"labels\":{\"event_type\":\"' || event_type || '\"},\"timestamp\":' || (epoch_us(ts) // 1000) || '}' AS line FROM events")
def _(spark, d):
    return sinks.json_points(events(spark, d), "m", "event_id", ["event_type"], "ts")


@query("counter_increase", "SELECT user_id, sum(CASE WHEN b IS NULL THEN 0 WHEN v >= b THEN v - b ELSE v END) AS increase FROM (SELECT user_id, (event_id % 100)::DOUBLE AS v, lag((event_id % 100)::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY 1")
def _(spark, d):
    return observe.counter(events(spark, d).withColumn("v", (F.col("event_id") % 100).cast("double")), ["user_id"], "v", "event_id")


@query("gauge_latest", "SELECT event_type, arg_max(value, ts) AS value FROM events GROUP BY 1")
def _(spark, d):
    return observe.gauge(events(spark, d), ["event_type"], "value", "ts")


@query("logs_by_level", "SELECT event_type AS level, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return observe.count_by_level(events(spark, d).withColumnRenamed("event_type", "level"))


@query("recent_logs", "SELECT event_id FROM events ORDER BY ts DESC LIMIT 50")
def _(spark, d):
    return observe.recent(events(spark, d), 50).select("event_id")


@query("alert_rules", "SELECT 'high' AS rule, event_id AS at, value FROM (SELECT *, lag(value > 40) OVER (ORDER BY event_id) AS was FROM events WHERE event_type = 'click') WHERE value > 40 AND NOT coalesce(was, false) UNION ALL SELECT 'low', event_id, value FROM (SELECT *, lag(value < 2) OVER (ORDER BY event_id) AS was FROM events WHERE event_type = 'view') WHERE value < 2 AND NOT coalesce(was, false)")
def _(spark, d):
    s = events(spark, d).select(F.timestamp_seconds("event_id").alias("at"), F.col("event_type").alias("metric"), "value")
    got = observe.rule_alerts(s, [("high", "above", "click", 40), ("low", "below", "view", 2)], "at")
    return got.select("rule", F.unix_seconds("started").alias("at"), "value")


@query("consumer_lag_stats", "SELECT p, count(*) AS partitions, count(*) FILTER (lag > 0) AS lagging, CAST(sum(lag) AS BIGINT) AS total_lag, max(lag) AS max_lag, min(lag) AS min_lag, avg(lag) AS avg_lag FROM (SELECT user_id % 3 AS p, user_id, max(event_id) - max(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) AS lag FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    e = events(spark, d)
    done = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_id").alias("committed"))
    lags = logs.lag(e.groupBy("user_id").agg(F.max("event_id").alias("latest")), done, ["user_id"]).withColumn("p", F.col("user_id") % 3)
    return logs.lag_stats(lags, ["p"])


def letters(spark, d):
    held = logs.dead_letters(events(spark, d), F.col("value") <= 80, "too large")[1]
    return held.withColumn("attempts", (F.col("event_id") % 6).cast("int"))


@query("dead_letter_replay", "SELECT event_id FROM events WHERE NOT value <= 80 AND event_id % 6 < 3")
def _(spark, d):
    return logs.replay(letters(spark, d), "too large", 3).select("event_id")


@query("dead_letter_stats", "SELECT 'too large' AS dlq_reason, count(*) AS letters, min(ts) AS oldest, max(ts) AS newest FROM events WHERE NOT value <= 80 HAVING count(*) > 0")
def _(spark, d):
    return logs.letter_stats(letters(spark, d), "ts")


@query("dead_letter_retry", "SELECT event_id, ts + to_seconds(least(power(2, event_id % 6), 20)) AS retry_at FROM events WHERE NOT value <= 80")
def _(spark, d):
    return logs.retry_at(letters(spark, d), "ts", "attempts", most_seconds=20).select("event_id", "retry_at")


@query("contract_order_unique", "SELECT 'ordering' AS \"check\", count(*) AS violations FROM (SELECT value < lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b UNION ALL SELECT 'unique', count(*) - count(DISTINCT user_id) FROM events")
def _(spark, d):
    e = events(spark, d)
    a = logs.ordering_violations(e, "value", "user_id", "event_id").select(F.lit("ordering").alias("check"), "violations")
    return a.union(logs.uniqueness_violations(e, "user_id").select(F.lit("unique"), "violations"))


@query("conflict_rule", "WITH a AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.event_id IS NULL THEN a.event_id WHEN a.event_id IS NULL THEN b.event_id ELSE least(a.event_id, b.event_id) END AS event_id FROM a FULL JOIN b ON a.user_id = b.user_id")
def _(spark, d):
    a, b = (events(spark, d).where(F.col("event_type") == k).groupBy("user_id").agg(F.max("event_id").alias("event_id")) for k in ("click", "view"))
    return logs.resolve_by(a, b, "user_id", lambda x, y: x["event_id"] <= y["event_id"])


def chain_of(spark, d, cycle):
    e = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("src"), (F.col("c_custkey") + 1).cast("string").alias("dst")).where("cast(src AS long) BETWEEN 1 AND 100")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if cycle else e


CHAIN100 = "SELECT CAST(i AS VARCHAR) AS node, CAST(i - 1 AS INTEGER) AS depth FROM range(1, 102) t(i)"


@query("lineage_long_chain", CHAIN100)
def _(spark, d):
    return logs.closure(spark, chain_of(spark, d, False), "1")


@query("lineage_cycles", "SELECT CAST(i AS VARCHAR) AS node, CAST(abs(i - 5) AS INTEGER) AS depth FROM range(1, 102) t(i) WHERE i <= 12")
def _(spark, d):
    return logs.closure(spark, chain_of(spark, d, True).where("cast(src AS long) <= 12 AND cast(dst AS long) <= 12"), "5")


@query("lineage_rounds", "SELECT CAST(i AS VARCHAR) AS node, CAST(i - 1 AS INTEGER) AS depth FROM range(1, 9) t(i)")
def _(spark, d):
    return logs.closure(spark, chain_of(spark, d, True).where("cast(src AS long) <= 8 AND cast(dst AS long) <= 8"), "1", few=0)


@query("lineage_upstream", "SELECT CAST(i AS VARCHAR) AS node, CAST(20 - i AS INTEGER) AS depth FROM range(1, 21) t(i)")
def _(spark, d):
    return logs.closure(spark, chain_of(spark, d, False), "20", upstream=True)


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")]


@query("lineage_paths", "SELECT unnest(['a>b>d>e', 'a>c>d>e']) AS path FROM (SELECT 1 FROM region LIMIT 1)")
def _(spark, d):
    return logs.paths(spark.createDataFrame(DIAMOND, "src string, dst string"), "a", "e").select(F.array_join("path", ">").alias("path"))


@query("impact_analysis", "SELECT 2 AS direct, 2 AS transitive, 'medium' AS level FROM (SELECT 1 FROM region LIMIT 1)")
def _(spark, d):
    return logs.impact(spark, spark.createDataFrame(DIAMOND, "src string, dst string"), "a").selectExpr("CAST(direct AS INT) AS direct", "CAST(transitive AS INT) AS transitive", "level")


@query("catalog_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '01') OR contains(lower(c_mktsegment), '01')")
def _(spark, d):
    return logs.search_catalog(table(spark, d, "customer"), "01", "c_name", "c_mktsegment").select("c_custkey")


@query("schema_migrate", "SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, CAST(NULL AS BIGINT) AS added FROM customer")
def _(spark, d):
    from pyspark.sql import types as T

    new = T.StructType.fromDDL("c_custkey long, c_acctbal string, added long")
    return schemas.migrate(table(spark, d, "customer"), new)


# --- record transforms
@query("insert_templates", "SELECT event_id, 'events@' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS tag FROM events")
def _(spark, d):
    e = events(spark, d).select("event_id", F.lit("events").alias("topic"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    return transforms.insert_filled("tag", "${topic}@${timestamp}")(e).select("event_id", "tag")


@query("converters", "SELECT event_id, value, event_type FROM events")
def _(spark, d):
    e = events(spark, d).select("event_id", F.struct("value").alias("j"), F.struct("value").alias("k"), "event_type", F.col("event_type").alias("b"))
    e = transforms.chain(e, transforms.convert("j", "json"), transforms.convert("k", "json_envelope"), transforms.convert("event_type", "string"), transforms.convert("b", "bytes"))
    e = transforms.chain(e, transforms.convert_back("j", "json", "struct<value: double>"), transforms.convert_back("k", "json_envelope", "struct<value: double>"), transforms.convert_back("event_type", "string", "string"), transforms.convert_back("b", "bytes", "string"))
    return e.where("b = event_type AND j.value <=> k.value").select("event_id", F.col("j.value").alias("value"), "event_type")


@query("declared_steps", "SELECT event_id AS id, '****' AS event_type, CAST(value AS BIGINT) AS value FROM (SELECT event_id, value - (value % 1) AS value FROM events WHERE value > 10)")
def _(spark, d):
    e = events(spark, d).select("event_id", "event_type", F.floor("value").alias("v"), "value")
    steps = [("field-filter", {"condition": "value > 10"}), ("drop", {"columns": ["value"]}), ("field-rename", {"event_id": "id", "v": "value"}), ("pii-redactor", {"columns": ["event_type"]}), ("deduplicator", {"keys": ["id"]}), ("cast", {"value": "bigint"})]
    return transforms.declared(e, steps)


@query("rate_limit", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(epoch(ts) AS BIGINT) // 86400 ORDER BY ts) AS r FROM events) WHERE r <= 3")
def _(spark, d):
    return transforms.limit_rate("event_type", "ts", 3, 86_400, ("event_id",))(events(spark, d)).select("event_id")


@query("json_filter_kinds", "SELECT 'eq' AS op, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') = '5' UNION ALL SELECT 'contains', count(*) FROM events WHERE contains(json_extract_string(props, '$.k'), '1') UNION ALL SELECT 'exists', count(*) FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, d):
    parts = [transforms.json_filter("props", "k", op, w)(events(spark, d)).agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, w in (("eq", "5"), ("contains", "1"), ("exists", None))]
    return parts[0].union(parts[1]).union(parts[2])


@query("guarded_steps", "SELECT event_id, CASE WHEN NOT value > 5 THEN 'small' WHEN event_type = 'error' THEN 'error' END AS dlq_reason FROM events")
def _(spark, d):
    ok, failed = transforms.guarded(events(spark, d), ("small", F.col("value") > 5, transforms.insert_field("a", 1)), ("error", F.col("event_type") != "error", transforms.insert_field("b", 2)))
    return ok.select("event_id", F.lit(None).cast("string").alias("dlq_reason")).unionByName(failed.select("event_id", "dlq_reason"))


@query("replay_mutators", "SELECT c_custkey, left(c_name, 2) || repeat('#', CAST(length(c_name) - 5 AS BIGINT)) || right(c_name, 3) AS c_name, 'k=' || c_custkey || ';' AS made FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.to_json(F.struct("c_custkey")).alias("value"))
    return transforms.chain(c, transforms.mask_ends("c_name", 2, 3, "#"), transforms.fill_template("made", "k={{c_custkey}};{{none}}"), transforms.replace_field(exclude=["value"]))


@query("shift_time", "SELECT event_id, ts + INTERVAL '90 seconds' AS ts FROM events")
def _(spark, d):
    return transforms.shift_time("ts", 90_000)(events(spark, d)).select("event_id", "ts")


@query("record_function", "SELECT event_id, event_type AS topic, value * 2 AS value FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'copy', value FROM events WHERE event_type = 'click'")
def _(spark, d):
    def call(r):
        if r["event_type"] == "error":
            return None
        twice = {"event_id": r["event_id"], "topic": r["event_type"], "value": r["value"] * 2}
        return [twice, {"event_id": r["event_id"], "topic": "copy", "value": r["value"]}] if r["event_type"] == "click" else twice

    return transforms.record_function(events(spark, d).select("event_id", "event_type", "value"), call, "event_id long, topic string, value double")


@query("integration_pipeline", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'other' END AS class, n_name FROM events JOIN nation ON n_nationkey = user_id % 25 WHERE value <= 80")
def _(spark, d):
    change = events(spark, d).select(F.to_json(F.struct(F.struct("event_id", "event_type", "user_id", "value").alias("after"), F.lit("c").alias("op"), F.lit(1).cast("long").alias("ts_ms"))).alias("value"))
    rows = transforms.debezium(change, "value", "event_id: bigint, event_type: string, user_id: bigint, value: double").select("after.*")
    rows = rows.join(F.broadcast(table(spark, d, "nation").limit(1_000)), F.col("n_nationkey") == F.col("user_id") % 25)  # 25 nations
    good, _ = logs.dead_letters(rows, F.col("value") <= 80, "too large")
    return good.select("event_id", F.when(F.col("event_type").isin("click", "view"), "browse").otherwise("other").alias("class"), "n_name")


# --- streaming
@query("stream_features", "SELECT user_id, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, arg_min(value, ts) AS first, arg_max(value, ts) AS last, count(DISTINCT value) AS \"distinct\" FROM events GROUP BY 1")
def _(spark, d):
    s = runs.features(runs.source(spark, d, "events", "ts"), "user_id", "value", "ts")
    got = runs.drain_complete(s, scratch(spark, "out"), scratch(spark, "checkpoint"))
    return got.select("user_id", "n", F.round("total", 4).alias("total"), "least", "most", "first", "last", F.col("distinct").cast("long").alias("distinct"))


def dealt(spark, d, parts=3):
    """The events as a stream of several files, in order of time, and one far later row that moves every watermark."""
    path = scratch(spark, "dealt")
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    cuts = e.approxQuantile("event_id", [i / parts for i in range(1, parts)], 0.001)
    for i, (a, b) in enumerate(zip([-1, *cuts], [*cuts, 1e18])):
        e.where(f"event_id > {a} AND event_id <= {b}").coalesce(1).write.parquet(f"{path}/b={i}")
    late = spark.createDataFrame([(-1, -1, "end", 0.0)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
    late.select(*e.columns).coalesce(1).write.parquet(f"{path}/b={parts}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


@query("stream_append_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    s = windows.tumbling(runs.watermarked(dealt(spark, d), "ts", "bounded", "40 days"), "ts", "1 day", ["event_type"], n=F.count("*"))
    got = runs.drain(s, scratch(spark, "out"), scratch(spark, "checkpoint"))
    return got.select(F.col("window_start").cast("timestamp_ntz"), "event_type", "n").where("event_type <> 'end'")


@query("stream_left_join", f"SELECT a_id, b_id FROM {CLICKS} LEFT JOIN {BUYS} ON a_user = b_user AND a_ts >= b_ts - INTERVAL '1 hour' AND a_ts <= b_ts + INTERVAL '1 hour'")
def _(spark, d):
    e = dealt(spark, d)
    a = e.where("event_type IN ('click', 'end')").select(F.col("event_id").alias("a_id"), F.col("user_id").alias("a_user"), F.col("ts").alias("a_ts"))
    b = e.where("event_type IN ('purchase', 'end')").select(F.col("event_id").alias("b_id"), F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"))
    j = runs.interval_join(a, b, ("a_user", "b_user"), "a_ts", "b_ts", "40 days", 3600, "left").select("a_id", "b_id")
    return runs.drain(j, scratch(spark, "out"), scratch(spark, "checkpoint")).where("a_id >= 0")


@query("stream_semi_join", f"SELECT a_id FROM {CLICKS} WHERE EXISTS (SELECT 1 FROM {BUYS} WHERE a_user = b_user AND a_ts >= b_ts - INTERVAL '1 hour' AND a_ts <= b_ts + INTERVAL '1 hour')")
def _(spark, d):
    e = dealt(spark, d)
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("a_id"), F.col("user_id").alias("a_user"), F.col("ts").alias("a_ts"))
    b = e.where("event_type = 'purchase'").select(F.col("user_id").alias("b_user"), F.col("ts").alias("b_ts"))
    j = runs.interval_join(a, b, ("a_user", "b_user"), "a_ts", "b_ts", "40 days", 3600, "left_semi").select("a_id")
    return runs.drain(j, scratch(spark, "out"), scratch(spark, "checkpoint"))


@query("stream_late_rows", "WITH b AS (SELECT event_id, ts, ntile(3) OVER (ORDER BY event_id) AS b FROM events) SELECT 'all' AS kind, count(*) AS n FROM b UNION ALL SELECT 'kept', count(*) FROM b")
def _(spark, d):
    ok, late = scratch(spark, "on-time"), scratch(spark, "late")
    runs.split_late(dealt(spark, d), "ts", 3600, ok, late, scratch(spark, "checkpoint")).awaitTermination()
    kept = spark.read.parquet(ok).where("event_type <> 'end'").unionByName(spark.read.parquet(late)).agg(F.count("*").alias("n"))
    return kept.select(F.lit("kept").alias("kind"), "n").union(events(spark, d).agg(F.count("*").alias("n")).select(F.lit("all"), "n"))


@query("stream_restart", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    path, checkpoint = scratch(spark, "in"), scratch(spark, "checkpoint")
    target = scratch(spark, "out")
    e = events(spark, d).select("event_id", "user_id")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(target)

    for k in (0, 1):  # the second run goes on from the first one's state
        e.where(f"event_id % 2 = {k}").coalesce(1).write.parquet(f"{path}/k={k}")
        s = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))
        runs.started(s, put, checkpoint, mode="complete").awaitTermination()
    return spark.read.parquet(target)


@query("stream_dedup_window", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    e = runs.source(spark, d, "events", "ts").select("event_id", "ts")
    s = runs.distinct(e.unionByName(e), "ts", "60 days", ["event_id"]).select("event_id")
    return runs.drain(s, scratch(spark, "out"), scratch(spark, "checkpoint"))


@query("key_state", "SELECT event_type AS key, CAST(max(event_id) AS VARCHAR) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(spark, d):
    state = runs.KeyState(spark, scratch(spark, "state"))
    top = lambda c: events(spark, d).groupBy(F.col("event_type").alias("key")).agg(c.cast("string").alias("value")).withColumn("namespace", F.lit("a"))
    state.put(top(F.max("event_id")))
    held = state.checkpoint()
    state.put(top(F.min("event_id")))
    state.restore(held)
    state.delete(spark.createDataFrame([("a", "error")], "namespace string, key string"))
    return state.scan("a").select("key", "value")


@query("avro_round_trip", "SELECT event_id, ts, event_type, value FROM events")
def _(spark, d):
    path = scratch(spark, "avro")
    sinks.export(events(spark, d).select("event_id", "ts", "event_type", "value"), path, "avro")
    return avro.read(spark, path)
