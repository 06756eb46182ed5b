"""Every query against its DuckDB SQL over the smallest tables, by rows."""

import datetime as dt

import duckdb
import pytest

from tidemill.queries import ORACLE, QUERIES, TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 4) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in x] == pytest.approx([float(v) if not isinstance(v, (str, bool, type(None), list)) else v for v in y], abs=2e-4)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name, column", [("knn", "query_id"), ("similarity_subscription", "subscription")])
def test_exact_search_answers_every_stated_query(spark, sf, name, column):
    stated = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert len(stated) > 10 and {r[0] for r in QUERIES[name](spark, sf).select(column).distinct().collect()} == stated
