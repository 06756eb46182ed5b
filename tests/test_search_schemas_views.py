"""Cells, embeddings, schemas, user functions, questions, views and JSON edits on small inputs."""

import graphlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import scalar
from tidemill.functions.registry import Functions
from tidemill.operators import anomaly, cells, embedding, observe, schemas, transforms, vector
from tidemill.plans import questions
from tidemill.plans.views import View, Views, apply_deltas, counted
from tidemill.queries import ORACLE, QUERIES


def test_cells_reach_the_recall(spark, sf):
    got = {(r.query_id, r.id) for r in QUERIES["knn_cells"](spark, sf).collect()}
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = {(r.query_id, r.id) for r in vector.nearest(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, 5).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_cells_of_ties_nulls_and_zeros(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 2.0])], "id long, v array<double>")
    c = cells.centres(cells.sample(rows, "id", "v"), 8)
    got = {r.id: r.cell for r in cells.partition(rows, "v", c).collect()}
    assert got[1] == got[2] != got[5] and got[4] is None and got[3] == 0
    assert cells.updated(rows.where("id <> 3"), "v", c, 1.0).shape == c.shape
    with pytest.raises(ValueError):
        cells.centres(np.zeros((0, 2)), 4)


def test_cells_of_copies_blocks_and_rows_without_direction(spark):
    dice = np.random.default_rng(1)
    lone = dice.normal(size=(300, 6)).astype(np.float32)
    many = np.concatenate([lone, np.repeat(lone[:4], 150, axis=0), np.zeros((2, 6), np.float32)])  # large groups of copies tie
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(dice.permutation(len(many)), many)] + [(5_000, None)]
    v = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    asked = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    s = vector.cosine(F.col("vector"), F.col("query"))
    ranks = asked.where("query IS NOT NULL").join(v.where("vector IS NOT NULL")).select("query_id", "id", F.round(s, 9).alias("s"))
    want = {}
    for r in sorted(ranks.collect(), key=lambda r: (r.query_id, -r.s, r.id)):
        want.setdefault(r.query_id, []).append((r.id, r.s))
    c = cells.centres(cells.sample(v, "id", "vector"), 4)
    once = cells.nearest(v, asked, 5, c, 4)
    blocks = cells.nearest(v, asked, 5, c, 4, most_queries=7, in_blocks=True)
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()  # no row a pair
    for got in (once.collect(), blocks.collect()):
        found = {q: [(r.id, round(r.similarity, 9)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in want}
        assert len(got) == 5 * len(want) and found == {q: w[:5] for q, w in want.items()}
    with pytest.raises(ValueError):
        cells.nearest(v, asked, 5, c, 4, most_queries=7)
    assert cells.nearest(v.where("id < 0"), asked, 5, c, 4).count() == cells.nearest(v, asked.where("query_id < 0"), 5, c, 4).count() == 0
    named = cells.nearest(v.withColumn("id", F.col("id").cast("string")), asked, 3, c, 4)
    assert named.count() == 3 * len(want) and dict(named.dtypes)["id"] == "string"


def test_equal_queries_of_a_cell_search_are_searched_once(spark, monkeypatch):
    lone = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    asked = spark.createDataFrame([(i, lone[i % 3]) for i in range(60)], "query_id long, query array<double>")
    c = cells.centres(np.array(lone), 2)
    step, sizes = cells.best_in_cells(asked, 1, 0, 2, c, 2), []
    monkeypatch.setattr(cells, "Rows", lambda v: sizes.append(len(v)) or vector.Rows(v))
    base = pa.RecordBatch.from_arrays([pa.array([7, 5, 6]), pa.array([[0.0, 2.0], [2.0, 0.0], [4.0, 4.0]])], ["id", "vector"])
    got = [r for b in step(iter([base])) for r in b.to_pylist()]
    assert sizes[0] == 3  # not 60
    best = {q: [r["id"] for r in sorted(got, key=lambda r: (-r["similarity"], r["id"])) if r["query_id"] == q] for q in range(60)}
    assert best == {q: [[5, 6], [7, 6], [6, 5]][q % 3] for q in range(60)}


def test_cell_search_equals_its_sql_on_copies(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    n = v.agg(F.max("vec_id")).first()[0] + 1
    v.where("vec_id < 120").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("vec_id", F.col("vec_id") + F.col("i") * n).drop("i").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql("SELECT query_id, id, similarity, rank FROM (" + ORACLE["knn_all_cells"] + ")").fetchall()
    assert sorted(want) == sorted(map(tuple, QUERIES["knn_all_cells"](spark, str(tmp_path)).select("query_id", "id", "similarity", "rank").collect()))


@pytest.mark.parametrize("name", ["knn_cells", "knn_all_cells", "similarity_subscription"])
def test_searches_make_no_row_a_pair_of_vectors(spark, sf, name):
    assert "Join" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_subscriptions_equal_their_definition_without_a_row_a_pair(spark):
    dice = np.random.default_rng(2)
    lone = [[float(x) for x in v] for v in dice.normal(size=(200, 4)).astype(np.float32)]
    rows = list(enumerate(lone + lone[:3] * 40 + [[0.0] * 4, None, [1.0, 2.0], [2.0, 4.0]]))
    v = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    standing = v.where("id % 9 = 0 OR id >= 320").select(F.concat(F.lit("s"), "id").alias("subscription"), F.col("vector").alias("query"))
    s = vector.cosine(F.col("vector"), F.col("query"))
    pairs = v.where("vector IS NOT NULL").join(standing.where("query IS NOT NULL")).select("id", "subscription", F.round(s, 9).alias("s"))
    for least in (0.5, 0.0):
        want = sorted(map(tuple, pairs.where(F.col("s") >= least).collect()))
        once, blocks = embedding.subscribe(v, standing, least), embedding.subscribe(v, standing, least, most_standing=6, in_blocks=True)
        for got in (once, blocks):
            assert sorted((r.id, r.subscription, round(r.similarity, 9) + 0.0) for r in got.collect()) == want
    assert any(i == 322 and q == "s323" for i, q, _ in want) and "Join" not in once._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        embedding.subscribe(v, standing, 0.5, most_standing=6)
    assert embedding.subscribe(v.where("id < 0"), standing).count() == embedding.subscribe(v, standing.where("subscription = ''")).count() == 0


def test_semantic_partitions_cover_every_row(spark, sf):
    got = QUERIES["semantic_partitions"](spark, sf)
    assert got.where("cell IS NULL").count() == 0
    assert got.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_hashed_embeddings():
    assert embedding.place(b"a") == 5381 * 33 + 97
    assert embedding.hashed("Abc, abc", 64).sum() == 3.0 and embedding.hashed("", 8).sum() == 0
    assert embedding.frequencies("a b a_c", 1 << 20).max() == 0.5


@pytest.mark.parametrize("how", ["recursive", "semantic"])
def test_chunks_are_pieces_of_the_text(spark, sf, how):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in embedding.chunk(docs, "doc_id", "text", 300, 1, how=how).collect():
        assert 0 < len(r.text) <= 300 and texts[r.id][r.start : r.start + len(r.text)] == r.text


def test_chunks_lose_only_separators():
    text = "one two. three four five\n\nsix " + "x" * 50
    bare = lambda t: t.replace("\n\n", "").replace(". ", "").replace(" ", "")
    parts = embedding.split(text, ["\n\n", ". ", " "], 10, 1)
    assert bare("".join(c for _, c in parts)) == bare(text) and all(len(c) <= 10 and text[s : s + len(c)] == c for s, c in parts)
    assert [c for _, c in embedding.gather("a b c d", [" "], 3, 1)] == ["a b", "c d"]
    assert embedding.gather("", [" "], 3, 1) == []


def test_schema_levels():
    s = lambda *f: T.StructType([T.StructField(n, t, null) for n, t, null in f])
    old = s(("id", T.IntegerType(), False))
    wider, optional, required, other = s(("id", T.LongType(), False)), s(("id", T.IntegerType(), False), ("x", T.StringType(), True)), s(("id", T.IntegerType(), False), ("x", T.StringType(), False)), s(("id", T.StringType(), False))
    assert schemas.compatible(old, wider) and not schemas.compatible(old, wider, "FORWARD")
    assert schemas.compatible(old, optional, "FULL") and not schemas.compatible(old, required) and schemas.compatible(old, required, "FORWARD")
    assert not schemas.compatible(old, other) and schemas.compatible(old, other, "NONE")
    assert [schemas.diff(old, x).risk for x in (old, wider, optional, other)] == ["safe", "low", "safe", "high"]
    assert schemas.diff(optional, old).risk == "medium" and schemas.diff(optional, old).breaking and schemas.diff(optional, wider).risk == "critical"
    r = schemas.Registry()
    assert [r.register("t", x) for x in (old, old, optional)] == [1, 1, 2] and r.get("t", 1) == old
    with pytest.raises(ValueError):
        r.register("t", other)
    with pytest.raises(ValueError):
        schemas.compatible(old, old, "SIDEWAYS")


def test_schema_summary_of_mixed_messages(spark):
    rows = [('{"a": 1, "b": "x", "c": null, "d": [1], "e": {"f": 1}}',), ('{"a": "2", "b": "y", "g": true}',), ("not json",), ("[1]",), (None,)]
    got = {r.field: (r.type, r.occurrences, r.share) for r in schemas.summary(spark.createDataFrame(rows, "v string"), "v").collect()}
    assert got == {"a": ("mixed", 2, 40.0), "b": ("string", 2, 40.0), "c": ("null", 1, 20.0), "d": ("array", 1, 20.0), "e": ("object", 1, 20.0), "g": ("boolean", 1, 20.0)}


def test_functions_by_name(spark):
    f = Functions(spark)
    f.scalar("plus_one", lambda x: None if x is None else x + 1, ["long"], "long")
    assert [r[0] for r in spark.sql("SELECT plus_one(x) FROM VALUES (1L), (NULL), (3L) AS t(x)").collect()] == [2, None, 4]
    for taken in ("plus_one", "upper"):
        with pytest.raises(ValueError):
            f.scalar(taken, lambda x: x, ["long"], "long")
    f.aggregate("total_of", lambda: 0.0, lambda s, x: s + (x or 0), lambda s: s, ["double"], "double")
    assert [x.name for x in f.list()] == ["plus_one", "total_of"]
    assert spark.sql("SELECT total_of(x) FROM VALUES (1.5D), (NULL), (3D) AS t(x)").first()[0] == 4.5
    f.remove("plus_one")
    f.remove("total_of")
    assert not f.list() and not spark.catalog.functionExists("plus_one")


@pytest.mark.parametrize(
    ("question", "sql"),
    [
        ("How many records are in orders?", "SELECT COUNT(*) AS n FROM topic('orders')"),
        ("show the last 5 from orders", "SELECT * FROM topic('orders') ORDER BY timestamp DESC LIMIT 5"),
        ("average amount in orders", "SELECT AVG(amount) AS average FROM topic('orders')"),
        ("orders where amount greater than 10?", "SELECT * FROM topic('orders') WHERE amount > 10"),
        ("orders where status is o'pen", "SELECT * FROM topic('orders') WHERE status = 'o''pen'"),
        ("schema of orders", "DESCRIBE orders"),
        ("orders please", "SELECT * FROM topic('orders') LIMIT 10"),
        ("hello", ""),
    ],
)
def test_questions(question, sql):
    assert questions.translate(question, {"orders": ["amount", "status"]}).sql == sql


def test_views_refresh_in_order_and_keep_versions(spark, tmp_path):
    v = Views(spark, f"file://{tmp_path}")
    v.source("t", spark.createDataFrame([(1, 2.0), (1, 3.0), (2, -1.0)], "k int, x double"))
    v.define("top", View("sums").order_by(F.desc("s")).limit(1))
    v.define("sums", View("t").group_by("k").aggregate(s=F.sum("x")))
    assert v.order() == ["sums", "top"] and v.refresh() == {"sums": 1, "top": 1}
    v.source("t", spark.createDataFrame([(3, 9.0)], "k int, x double"))
    assert v.refresh("sums") == {"sums": 2, "top": 1}
    assert v.read("top").first().k == 1 and v.read("sums").first().k == 3 and v.read("sums", 1).count() == 2
    v.define("sums", lambda f: f["top"], ["top"])
    with pytest.raises(graphlib.CycleError):
        v.order()


def test_deltas_drop_empty_keys(spark):
    state = counted(spark.createDataFrame([("a", 1), ("b", 2)], "k string, x long"), ["k"], "x")
    changes = spark.createDataFrame([("a", 1, -1), ("b", 5, 1), ("c", 7, 1)], "k string, x long, sign int")
    assert sorted(map(tuple, apply_deltas(state, changes, ["k"], "x").collect())) == [("b", 2, 7), ("c", 1, 7)]


def test_json_edits(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,{"c":2}],"d":{}},"e":null}',), ("oops",), ("[1]",), (None,), ("{}",)], "v string")
    assert [r.v for r in transforms.json_flatten("v")(df).collect()] == ['{"a.b.0":1,"a.b.1.c":2,"a.d":{},"e":null}', None, None, None, "{}"]
    assert transforms.json_edit("v", ("a",), {"e": "f"}, {"g": "é"})(df).first().v == '{"f":null,"g":"é"}'


def test_headers_and_times(spark):
    df = spark.createDataFrame([('{"t":"2024-01-01T00:00:01Z"}', {"x": "1"}), ('{"t":"soon"}', None)], "v string, headers map<string,string>")
    got = [r.headers for r in transforms.chain(df, transforms.timestamp_header("v", "t", "iso8601"), transforms.without_header("x")).collect()]
    assert got == [{"x-extracted-timestamp": "1704067201000"}, {"x-extracted-timestamp": None}]


def test_folded_wraps_at_64_bits(spark):
    texts = ["", "a", "é", "a long enough text to wrap around many times"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts] + [(None,)], "s string").select(scalar.folded(F.col("s"))).collect()]
    want = []
    for t in texts:
        h = 0
        for b in t.encode():
            h = (h * 31 + b) % (1 << 64)
        want.append(f"masked_{h:016x}")
    assert got == [*want, None]


def test_fit_of_a_parabola(spark):
    df = spark.range(1000).selectExpr("1e6 + id AS x", "3 - 2 * (1e6 + id) + 0.5 * (1e6 + id) * (1e6 + id) AS y")
    assert observe.polynomial(df, F.col("x"), F.col("y"), 2)[2] == pytest.approx(0.5, rel=1e-6)
    with pytest.raises(ValueError):
        observe.polynomial(df.limit(0), F.col("x"), F.col("y"))


def test_ewma_flags_the_spike(spark):
    df = spark.createDataFrame([("k", i, 100.0 if i == 30 else 10.0 + i % 2) for i in range(40)], "k string, i int, v double")
    got = {r.i: r.is_anomaly for r in anomaly.ewma(df, "k", ["i"], "v").collect()}
    assert got[30] and not any(got[i] for i in range(30))
