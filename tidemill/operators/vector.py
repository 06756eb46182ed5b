"""Vectors and text search: distances, exact kNN, quantising, keyword and hybrid search, chunking."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def quantise_i8(a: Column) -> Column:
    """Scaled by the greatest magnitude to -127..127."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, F.transform(a, lambda x: F.round(x.cast("double") / top * 127).cast("tinyint"))).otherwise(F.transform(a, lambda x: F.lit(0).cast("tinyint")))


def clamped(a: Column, most: int) -> Column:
    """Values of -1 to 1 (others are moved there) as whole numbers of -most to most: 127 for 8 bits, 7 for 4."""
    return F.transform(a, lambda x: F.round(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * most).cast("int"))


def quantise_i4(a: Column) -> Column:
    """Two values a byte, the first in the low half, each plus 8; an odd last one stands with a zero."""
    four = F.transform(clamped(a, 7), lambda x: x + 8)
    pairs = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: (F.get(four, i * 2) + F.coalesce(F.get(four, i * 2 + 1), F.lit(8)) * 16).cast("int"))


def quantise_f16(a: Column) -> Column:
    """The nearest half-precision values."""

    @F.pandas_udf("array<float>")
    def of(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: np.asarray(x, np.float32).astype(np.float16).astype(np.float32), na_action="ignore")

    return of(a)


def quantise_binary(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0).cast("tinyint"))


def packed(column, size: int) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors; zero for nulls and other lengths."""
    out = np.zeros((len(column), size))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(np.diff(np.asarray(column.offsets)) * column.is_valid().to_numpy(zero_copy_only=False))
    lengths = np.diff(np.concatenate([[0], ends]))
    rows = np.flatnonzero(lengths == size)
    if len(rows):
        out[rows] = flat[(ends[rows] - size)[:, None] + np.arange(size)]
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


NEAR = 1e-9  # products of a matrix are off by far less, but differ in their last bits between copies of a vector


def raw(column, size: int) -> np.ndarray:
    """Rows of an Arrow list column; zero for nulls and other lengths."""
    out = np.zeros((len(column), size))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    lengths = np.diff(np.asarray(column.offsets)) * column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == size)
    if len(rows):
        out[rows] = flat[(np.cumsum(lengths)[rows] - size)[:, None] + np.arange(size)]
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of row with row, added one by one: equal rows give equal bits wherever they lie."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


class Rows:
    """Vectors with their norms: units for products of matrices, and exact cosines of chosen pairs (0 for a zero vector)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.squares = vectors, dots(vectors, vectors)
        n = np.sqrt(self.squares)[:, None]
        self.units = np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)

    def cosines(self, mine: np.ndarray, other: Rows, theirs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mine))
        for i in range(0, len(mine), 16_384):
            a, b = mine[i : i + 16_384], theirs[i : i + 16_384]
            n = np.sqrt(self.squares[a] * other.squares[b])
            found = np.divide(dots(self.vectors[a], other.vectors[b]), n, out=np.zeros(len(a)), where=n != 0)
            out[i : i + 16_384] = np.clip(found, -1, 1)
        return out


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores: reading splits no row group of a file, and each row costs a pass over the queries."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def asked_rows(queries: DataFrame, ident: str, blocks: int, number: int):
    """Names and vectors of one block of (ident, query) as Arrow arrays, without null queries."""
    rows = queries.where(F.col("query").isNotNull() & (F.pmod(F.xxhash64(ident), F.lit(blocks)) == number)).select(ident, "query").toArrow()
    return rows.column(ident).combine_chunks(), rows.column("query").combine_chunks()


def nearest(base: DataFrame, queries: DataFrame, k: int, most_queries: int = 10_000, in_blocks: bool = False) -> DataFrame:
    """query_id, id, similarity, rank: exact cosine top k of (id, vector) for each of (query_id, query).

    Queries go to every task, so more than `most_queries` are refused, or with `in_blocks` sent in blocks of about that many,
    each with a pass over the base. Vectors are normalised once and multiplied batch by batch; a task keeps its k best of
    each query, so k rows a task and query are shuffled, not pairs.
    """
    n = queries.count()
    if n > most_queries and not in_blocks:
        raise ValueError(f"{n} queries, more than {most_queries}; ask for blocks")
    blocks = max(1, -(-n // most_queries))
    kinds = {"id": dict(base.dtypes)["id"], "query_id": dict(queries.dtypes)["query_id"]}
    parts = [base.mapInArrow(best_of(queries, blocks, b, k), f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double") for b in range(blocks)]
    local = parts[0]
    for p in parts[1:]:
        local = local.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")


def best_of(queries: DataFrame, blocks: int, number: int, k: int):
    """A step over Arrow batches of (id, vector) that gives the k best of each query of one block."""
    rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).select("query_id", "query").toArrow()
    asked = rows.column("query").combine_chunks()
    size = max(np.diff(np.asarray(asked.offsets)).max(initial=0), 1)
    sent = queries.sparkSession.sparkContext.broadcast((rows.column("query_id").to_numpy(), packed(asked, size), size))

    def run(batches):
        names, wanted, size = sent.value
        held, ids = np.full((len(wanted), 0), 0.0), np.zeros((len(wanted), 0), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 2_048):
                part = batch.slice(i, 2_048)
                own = part.column(part.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
                found = wanted @ packed(part.column(part.schema.get_field_index("vector")), size).T
                held, ids = np.concatenate([held, found], axis=1), np.concatenate([ids, np.broadcast_to(own, found.shape)], axis=1)
                first = np.lexsort((ids, -held), axis=1)[:, :k]
                held, ids = np.take_along_axis(held, first, axis=1), np.take_along_axis(ids, first, axis=1)
        if held.shape[1] and len(names):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, held.shape[1])), pa.array(ids.ravel()), pa.array(held.ravel())], ["query_id", "id", "similarity"])

    return run


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def keyword_search(df: DataFrame, ident: str, text: str, query: str) -> DataFrame:
    """id, score: sum of ln(1 + N / df) of matched query words, over the best.

    A row's matched words are bits of one number: words that a text doesn't hold as a part aren't looked for as words. One
    pass counts the rows of each number (at most 2 to the query's words), which gives every score; a second one names the
    rows, without a shuffle.
    """
    words = sorted({w for w in query.lower().split() if w})
    low = F.lower(text)
    bits = [F.when(F.contains(low, F.lit(w)) & low.rlike(f"(?:^|[^a-z0-9]){re.escape(w)}(?:$|[^a-z0-9])"), 1 << i).otherwise(0) for i, w in enumerate(words)]
    marked = df.select(F.col(ident).alias("id"), F.coalesce(sum(bits, F.lit(0)), F.lit(0)).alias("_words"))
    counts = {r["_words"]: r["n"] for r in marked.groupBy("_words").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    idf = [math.log(1 + rows / n) if (n := sum(c for m, c in counts.items() if m >> i & 1)) else 0.0 for i in range(len(words))]
    sums = {m: sum(x for i, x in enumerate(idf) if m >> i & 1) for m in counts if m}
    if not sums:
        return marked.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    best = max(sums.values())
    score = F.element_at(F.create_map(*[F.lit(x) for m, s in sorted(sums.items()) for x in (m, s / best)]), F.col("_words"))
    return marked.where("_words > 0").select("id", score.alias("score"))


def hybrid(semantic: DataFrame, keyword: DataFrame, weight: float = 0.7) -> DataFrame:
    """id, score of two scored sets (id, score); what one lacks counts as 0."""
    a, b = semantic.withColumnRenamed("score", "_s"), keyword.withColumnRenamed("score", "_k")
    return a.join(b, "id", "full").select("id", (F.lit(weight) * F.coalesce("_s", F.lit(0.0)) + F.lit(1 - weight) * F.coalesce("_k", F.lit(0.0))).alias("score"))


def chunk_fixed(df: DataFrame, ident: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """id, chunk, text: pieces of `size` characters, each `size - overlap` after the last."""
    step = size - overlap
    at = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0)).cast("int"))
    return df.where(F.length(text) > 0).select(F.col(ident).alias("id"), F.col(text).alias("_t"), F.explode(at).alias("chunk")).select("id", F.col("chunk").cast("long"), F.substring("_t", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def chunk_sentences(df: DataFrame, ident: str, text: str) -> DataFrame:
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(F.col(ident).alias("id"), F.posexplode(parts).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))


def route(df: DataFrame, ident: str, text: str, rules: dict[str, list[str]], least: float = 0.3, others: int = 3) -> DataFrame:
    """id, route, score, alternatives: the rule with the greatest share of its words in the text, if it is `least` or more,
    and the next ones by score."""
    have = tokens(F.col(text))
    scores = [F.struct((F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in ws]))) / len(ws)).alias("score"), F.lit(name).alias("route")) for name, ws in sorted(rules.items())]
    return routed(df.select(F.col(ident).alias("id"), F.array(*scores).alias("_s")), least, others)


def route_near(df: DataFrame, ident: str, vector: str, rules: dict[str, list[float]], least: float = 0.3, others: int = 3) -> DataFrame:
    """As route(), by the cosine of the row's vector and each rule's."""
    scores = [F.struct(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in v])).alias("score"), F.lit(name).alias("route")) for name, v in sorted(rules.items())]
    return routed(df.select(F.col(ident).alias("id"), F.array(*scores).alias("_s")), least, others)


def routed(df: DataFrame, least: float, others: int) -> DataFrame:
    ranked = df.withColumn("_s", F.sort_array("_s", asc=False))
    first, ok = F.col("_s")[0], F.col("_s")[0]["score"] >= least
    rest = F.when(ok, F.slice("_s", 2, others)).otherwise(F.slice("_s", 1, others))
    return ranked.select("id", F.when(ok, first["route"]).otherwise("default").alias("route"), first["score"].alias("score"), F.transform(rest, lambda x: x["route"]).alias("alternatives"))
