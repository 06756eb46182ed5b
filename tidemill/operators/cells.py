"""Approximate nearest neighbours and semantic partitions over k-means cells.

A proximity graph is walked one node after another, which doesn't distribute. Here vectors belong to the cell of their
nearest centre, and a query meets the vectors of its nearest cells only. Centres come from a bounded sample; every row is
in a cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import NEAR, Rows, asked_rows, dealt, raw


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def sample(df: DataFrame, ident: str, vector: str, most: int = 20_000) -> np.ndarray:
    """At most `most` vectors (documented bound), the same ones on each run: those with the least hashed ids."""
    rows = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(ident), ident).limit(most).select(vector).toArrow().column(0).combine_chunks()
    return unit(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1))


def centres(vectors: np.ndarray, cells: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """k-means++ seeds, then Lloyd's rounds on unit vectors; an empty cell keeps its centre."""
    if not len(vectors):
        raise ValueError("no vectors to take centres from")
    random = np.random.default_rng(seed)
    chosen = [vectors[random.integers(len(vectors))]]
    far = ((vectors - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(cells, len(vectors)) and far.sum() > 0:
        chosen.append(vectors[random.choice(len(vectors), p=far / far.sum())])
        far = np.minimum(far, ((vectors - chosen[-1]) ** 2).sum(axis=1))
    c = unit(np.array(chosen))
    for _ in range(rounds):
        near = (vectors @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, vectors)
        moved = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, unit(total), c)
        if np.allclose(moved, c):
            break
        c = moved
    return c


def nearest_cells(vector: Column, centres_: np.ndarray, probes: int = 1) -> Column:
    """The `probes` nearest cells, nearest first; cell 0 first for a zero vector, null for null."""

    @F.pandas_udf("array<int>")
    def of(v: pd.Series) -> pd.Series:
        out = [None] * len(v)
        have = np.flatnonzero(v.notna().to_numpy())
        if len(have):
            near = np.argsort(-(unit(np.stack(v.iloc[have].to_list()).astype(np.float64)) @ centres_.T), axis=1, kind="stable")[:, :probes]
            for i, cells in zip(have, near):
                out[i] = cells.tolist()
        return pd.Series(out, dtype=object)

    return of(vector)


def partition(df: DataFrame, vector: str, centres_: np.ndarray) -> DataFrame:
    """Adds `cell`, the semantic partition of a row."""
    return df.withColumn("cell", nearest_cells(F.col(vector), centres_)[0])


def updated(df: DataFrame, vector: str, centres_: np.ndarray, rate: float = 0.1) -> np.ndarray:
    """Centres moved towards the means of new rows by `rate`; one row a cell comes back to the driver."""
    means = partition(df.where(F.col(vector).isNotNull()), vector, centres_).groupBy("cell").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("m"))
    out = centres_.copy()
    for row in means.collect():
        out[row["cell"]] += rate * (np.array(row["m"]) - out[row["cell"]])
    return unit(out)


def nearest(base: DataFrame, queries: DataFrame, k: int, centres_: np.ndarray, probes: int, most_queries: int = 10_000, in_blocks: bool = False) -> DataFrame:
    """query_id, id, similarity, rank: top k by cosine of (id, vector) among the cells that each (query_id, query) probes.

    Queries go to every task, so more than `most_queries` are refused, or with `in_blocks` sent in blocks of about that many,
    each with a pass over the base; equal queries of a block are searched once. Rows are dealt evenly whatever their cell. A task multiplies the rows of a
    cell with the queries that probe it and keeps its k best of each query. With as many probes as cells the result is exact.
    """
    n = queries.count()
    if n > most_queries and not in_blocks:
        raise ValueError(f"{n} queries, more than {most_queries}; ask for blocks")
    blocks = max(1, -(-n // most_queries))
    kinds = {"id": dict(base.dtypes)["id"], "query_id": dict(queries.dtypes)["query_id"]}
    rows = dealt(base.where("vector IS NOT NULL").select("id", "vector"))
    parts = [rows.mapInArrow(best_in_cells(queries, blocks, b, k, centres_, probes), f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double") for b in range(blocks)]
    local = parts[0]
    for p in parts[1:]:
        local = local.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")


def best_in_cells(queries: DataFrame, blocks: int, number: int, k: int, centres_: np.ndarray, probes: int):
    """A step over Arrow batches of (id, vector) that gives the k best of each query of one block in the cells it probes."""
    names, asked = asked_rows(queries, "query_id", blocks, number)
    vectors, of = distinct(raw(asked, centres_.shape[1]))
    near = np.argsort(-(unit(vectors) @ centres_.T), axis=1, kind="stable")[:, :probes] if len(names) else np.zeros((0, 1), int)
    sent = queries.sparkSession.sparkContext.broadcast((names, of, vectors, near))

    def run(batches):
        names, of, vectors, near = sent.value
        wanted, probing = Rows(vectors), [np.flatnonzero((near == c).any(axis=1)) for c in range(len(centres_))]
        held, least = None, np.full(len(vectors), -np.inf)  # the k best so far by query, and the least of them
        for batch in batches:
            own, found = batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("vector"))
            for i in range(0, batch.num_rows if len(names) else 0, 4_096):
                have, ids = raw(found.slice(i, 4_096), vectors.shape[1]), own.slice(i, 4_096)
                first = first_copies(have, ids, k)
                have, ids = Rows(have[first]), ids.take(pa.array(first))
                q, rows = candidates(wanted, have, probing, (have.units @ centres_.T).argmax(axis=1), least, k)
                held, least = best_kept(held, (q, wanted.cosines(q, have, rows), ids.take(pa.array(rows))), least, k)
        if held:
            order, counts = np.argsort(of, kind="stable"), np.bincount(of)
            starts, step = np.cumsum(counts) - counts, max(1, (1 << 20) // counts.max())
            for i in range(0, len(held[0]), step):  # a row for each query of that vector
                q = held[0][i : i + step]
                row = np.repeat(np.arange(len(q)), counts[q])
                who = order[starts[q[row]] + place_in(row)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), held[2].take(pa.array(i + row)), pa.array(held[1][i + row])], ["query_id", "id", "similarity"])

    return run


def place_in(groups: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 0, of rows sorted by group."""
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(starts, append=len(groups)))


def distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that differ, and the place among them of each one given."""
    _, first, of = np.unique(np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    return vectors[first], of


def first_copies(vectors: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Rows without those that have k copies of less id beside them: as all copies are equally near, these can't be among k."""
    _, group = np.unique(np.ascontiguousarray(vectors + 0.0).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.lexsort((pc.rank(ids).to_numpy(), group))
    return order[place_in(group[order]) < k]


def candidates(wanted: Rows, have: Rows, probing: list[np.ndarray], cell: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of a cell that a query probes which may be among the query's k best; NaN counts as nearest."""
    out = [(np.zeros(0, int), np.zeros(0, int))]
    for c in np.unique(cell):
        asked, rows = probing[c], np.flatnonzero(cell == c)
        for i in range(0, len(asked), step := max(1, (1 << 22) // len(rows))):  # products of 32 MB at most
            some = asked[i : i + step]
            product, floor = wanted.units[some] @ have.units[rows].T, least[some]
            fresh = np.flatnonzero(np.isneginf(floor))
            if len(rows) >= k and len(fresh):
                own = np.partition(product[fresh], -k, axis=1)[:, -k]
                floor[fresh] = np.where(np.isnan(own), np.inf, own)
            a, b = np.nonzero(~(product < floor[:, None] - NEAR))
            out.append((some[a], rows[b]))
    q, rows = zip(*out)
    return np.concatenate(q), np.concatenate(rows)


def best_kept(held, new, least: np.ndarray, k: int):
    """The k best of each query among held and new (queries, similarities, ids), and the least similarity where there are k."""
    q, s, ids = new if held is None else (np.concatenate([held[0], new[0]]), np.concatenate([held[1], new[1]]), pa.concat_arrays([held[2], new[2]]))
    order = np.lexsort((pc.rank(ids, tiebreaker="first").to_numpy(), np.where(np.isnan(s), -np.inf, -s), q))
    place = place_in(q[order])
    order, last = order[place < k], order[place == k - 1]
    least[q[last]] = np.where(np.isnan(s[last]), np.inf, s[last])
    return (q[order], s[order], ids.take(pa.array(order))), least
