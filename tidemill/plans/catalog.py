"""Topics, streams, tables, views, queries and alerts by name; statements run against them."""

from __future__ import annotations

import base64
import json
import re
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import dialect

VERB = r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:MATERIALIZED\s+|STREAM\s+)?(?:VIEW|TABLE|STREAM)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.*)"
DECLARED = r"\s*CREATE\s+(?:STREAM|TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*?)\)\s*(?:WITH\s*\((.*)\))?\s*"
ALERT = r"\s*CREATE\s+ALERT\s+(\w+)\s+AS\s+(.*?)\s+NOTIFY\s+\w*\s*'([^']*)'\s*"


class Catalog:
    """Holds frames as temp views (no copies) and runs the dialect over them.

    A topic `t` is known as topic('t'), any_topic('t'), topic_t and topic_t_view; names of a folder's tables are found by
    themselves. Statements that write append to Parquet folders below `root`, and readers see what was there when they
    began. Pages are kept by statement, options and version of the catalog, the last `pages` of them.
    """

    def __init__(self, spark: SparkSession, time_column: str = "timestamp", folder: str | None = None, root: str | None = None, pages: int = 64) -> None:
        self.spark, self.time_column, self.folder, self.root, self.pages = spark, time_column, folder, root, pages
        self.topics, self.views, self.frames, self.sinks, self.queries, self.alerts = {}, {}, {}, {}, {}, {}
        self.cache, self.version = OrderedDict(), 0

    def topic(self, name: str, df: DataFrame) -> str:
        view = "topic_" + re.sub(r"\W", "_", name)
        for v in (view, f"{view}_view"):
            df.createOrReplaceTempView(v)
        self.topics[name], self.frames[name] = view, df
        self.version += 1
        return view

    def find(self, statement: str) -> None:
        """Registers tables of the folder that the statement names, and views of their names."""
        if not self.folder:
            return
        for word in {t.strip("'\"`") for t in dialect.lex(statement)}:
            if re.fullmatch(r"\w+", word) and word not in self.topics:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{word}.parquet")
                if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                    df = self.spark.read.parquet(f"{self.folder}/{word}.parquet")
                    self.topic(word, df)
                    df.createOrReplaceTempView(word)

    def tables(self, rows: bool = False) -> DataFrame:
        """name, columns, and with `rows` the number of rows, of each topic."""
        held = [(n, len(df.columns), df.count() if rows else None) for n, df in sorted(self.frames.items())]
        return self.spark.createDataFrame(held, "name string, columns int, rows long")

    def listed(self, names, column: str = "name") -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(names)], f"{column} string")

    def write(self, target: str, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Appends rows to a topic's folder, by position into `columns` or all of them; gives the number written."""
        if target in self.sinks:
            path, schema = self.sinks[target]
            names = columns or [f.name for f in schema]
            if len(names) != len(df.columns):
                raise dialect.DialectError(f"{target} takes {len(names)} columns, not {len(df.columns)}")
            kinds = {f.name: f.dataType for f in schema}
            given = {n: F.col(f"`{c}`").cast(kinds[n]) for n, c in zip(names, df.columns)}
            df = df.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
        else:
            path = f"{self.root}/{target}" if self.root else scratch_path(self.spark, f"topic-{target}")
            self.sinks[target] = (path, df.schema)
        df.write.mode("append").parquet(path)
        held = self.spark.read.schema(self.sinks[target][1]).parquet(path)
        self.topic(target, held)
        held.createOrReplaceTempView(target)
        return self.listed([target], "written")

    def sql(self, statement: str, time_column: str | None = None) -> DataFrame:
        """SELECT (also with EMIT TO t), INSERT INTO t [(columns)] SELECT or VALUES, CREATE [OR REPLACE] VIEW, TABLE or
        STREAM v AS, CREATE STREAM t (column type, ...), CREATE ALERT a AS ... NOTIFY channel 'address', PAUSE, RESUME, DROP
        and TERMINATE, SHOW TOPICS, STREAMS, TABLES, VIEWS, QUERIES and ALERTS, DESCRIBE [EXTENDED], EXPLAIN."""
        statement = statement.strip().rstrip(";")
        self.find(statement)
        tokens = dialect.lex(statement)
        words = [t.upper() for t in tokens[:3]]
        flags = re.IGNORECASE | re.DOTALL
        if words[:1] == ["SHOW"] and len(tokens) == 2:
            kinds = {"TOPICS": self.topics, "STREAMS": {**self.topics, **self.views}, "TABLES": self.frames, "VIEWS": self.views, "QUERIES": self.queries, "ALERTS": self.alerts}
            if words[1] in kinds:
                return self.listed(kinds[words[1]])
        if words[:1] == ["DESCRIBE"]:
            name = self.topics.get(tokens[1], tokens[1])
            return self.spark.sql(f"DESCRIBE {'EXTENDED ' if words[-1] == 'EXTENDED' else ''}{name}")
        if words[:1] == ["EXPLAIN"]:
            plan = self.sql(re.sub(r"^\s*EXPLAIN\s", "", statement, flags=re.IGNORECASE), time_column)._jdf.queryExecution().simpleString()
            return self.spark.createDataFrame([(x,) for x in plan.splitlines()], "plan string")
        if m := re.fullmatch(ALERT, statement, flags):
            self.alerts[m[1]] = {"sql": m[2], "notify": m[3], "active": True}
            return self.listed([m[1]], "created")
        if m := re.fullmatch(VERB, statement, flags):
            self.views[m[1]], self.queries[m[1]] = m[2], {"sql": m[2], "active": True}
            self.sql(m[2], time_column).createOrReplaceTempView(m[1])
            self.version += 1
            return self.listed([m[1]], "created")
        if m := re.fullmatch(DECLARED, statement, flags):
            if m[1] not in self.topics:
                columns = [c.split() for c in re.split(r",(?![^(]*\))", m[2])]
                kinds = {"VARCHAR": "STRING", "BYTES": "BINARY", "INTEGER": "INT"}
                empty = self.spark.createDataFrame([], ", ".join(f"{c[0]} {kinds.get(c[1].upper(), c[1])}" for c in columns))
                self.write(m[1], empty)
            return self.listed([m[1]], "created")
        if m := re.fullmatch(r"\s*(PAUSE|RESUME)\s+(?:VIEW\s+|ALERT\s+|QUERY\s+)?(\w+)", statement, flags):
            held = self.queries.get(m[2]) or self.alerts.get(m[2])
            if held is None:
                raise dialect.DialectError(f"no query or alert {m[2]}")
            held["active"] = m[1].upper() == "RESUME"
            return self.listed([m[2]], m[1].lower() + "d")
        if m := re.fullmatch(r"\s*(?:DROP|TERMINATE)\s+(?:VIEW\s+|TABLE\s+|STREAM\s+|ALERT\s+|QUERY\s+)?(?:IF\s+EXISTS\s+)?(\w+)", statement, flags):
            held = [d for d in (self.views, self.queries, self.alerts, self.sinks) if m[1] in d]
            if not held:
                raise dialect.DialectError(f"no view {m[1]}")
            for d in held:
                del d[m[1]]
            self.topics.pop(m[1], None)
            self.spark.catalog.dropTempView(m[1])
            self.version += 1
            return self.listed([m[1]], "dropped")
        if m := re.fullmatch(r"\s*INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\)\s*)?((?:SELECT|VALUES)\b.*)", statement, flags):
            source = self.spark.sql(m[3]) if m[3][:6].upper() == "VALUES" else self.sql(m[3], time_column)
            return self.write(m[1], source, [c.strip() for c in m[2].split(",")] if m[2] else None)
        if m := re.fullmatch(r"(.*)\bEMIT\s+TO\s+'?(\w+)'?\s*", statement, flags):
            return self.write(m[2], self.sql(m[1], time_column))
        return self.spark.sql(dialect.translate(statement, self.topics, time_column or self.time_column))

    def refresh(self, name: str) -> DataFrame | None:
        """A view's rows as of now, nothing while it is paused."""
        return self.sql(self.queries[name]["sql"]) if self.queries[name]["active"] else None

    def firing(self) -> DataFrame:
        """alert, notify, matches: active alerts whose statement has rows now."""
        rows = [(n, a["notify"], self.sql(a["sql"]).count()) for n, a in sorted(self.alerts.items()) if a["active"]]
        return self.spark.createDataFrame([r for r in rows if r[2]], "alert string, notify string, matches long")

    def page(self, statement: str, size: int, cursor: str | None = None) -> tuple[list[dict], str | None]:
        """Rows of one page and the cursor of the next; the statement should order its rows."""
        key = (statement, size, cursor, self.version)
        if key not in self.cache:
            offset = json.loads(base64.b64decode(cursor))["offset"] if cursor else 0
            rows = [r.asDict() for r in self.sql(statement).offset(offset).limit(size + 1).collect()]
            nxt = base64.b64encode(json.dumps({"offset": offset + size}).encode()).decode() if len(rows) > size else None
            self.cache[key] = (rows[:size], nxt)
            while len(self.cache) > self.pages:
                self.cache.popitem(last=False)
        return self.cache[key]
