"""Near-duplicates: MinHash signatures joined by a multi-index Hamming join, links confirmed on whole shingle sets.

Signatures have CHUNKS x SLOTS symbols of 8 bits. If two signatures differ in at most 2 * CHUNKS - 1 symbols, some chunk
differs in at most one (pigeonhole), so they meet under one of the chunk's keys, each of which leaves one symbol out:
all pairs under that signature distance meet. Pairs further apart still meet if any chunk has at most one difference; at
a similarity of 0.85, 1 pair in a million does not, at 0.8 1 in 4,000 (18 chunks).

Sets are sets of 64-bit hashes of shingles: that two different shingles of a corpus of n have one hash has a chance of
about n^2 / 2^65 in all, and changes one set by one.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, text_bytes, trim
from .components import components
from .shingles import shingles

CHUNKS, SLOTS = 18, 10
SIGNATURE = CHUNKS * SLOTS
_random = np.random.default_rng(7_919)
TURN = _random.integers(0, 1 << 32, (SIGNATURE, 1), dtype=np.uint64).astype(np.uint32)
TIMES = _random.integers(0, 1 << 32, (SIGNATURE, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SYMBOL = _random.integers(0, 1 << 63, (CHUNKS, SLOTS, 256), dtype=np.uint64)
LEFT_OUT = _random.integers(0, 1 << 63, (CHUNKS, SLOTS), dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """8 bits of each of SIGNATURE minima over a set, in blocks that bound memory."""
    x = (hashes >> np.uint64(17)).astype(np.uint32)
    low = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, ((x[None, i : i + 4096] ^ TURN) * TIMES).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each chunk and each symbol left out of it: signatures x (CHUNKS * SLOTS)."""
    out = np.empty((len(signatures), SIGNATURE), np.uint64)
    for c in range(CHUNKS):
        part = np.stack([SYMBOL[c, s][signatures[:, c * SLOTS + s]] for s in range(SLOTS)], axis=1)
        out[:, c * SLOTS : (c + 1) * SLOTS] = part.sum(axis=1, dtype=np.uint64)[:, None] - part + LEFT_OUT[c]
    return out


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """id, n_shingles, digest of the set, signature (null without words): one row a document, written."""
    names = ["id", "n_shingles", "digest", "signature"]

    def of(batches):
        for batch in batches:
            sets = [shingles(raw, width) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names,
            )
            del sets
            trim()

    return scratch(docs.mapInArrow(of, "id long, n_shingles long, digest binary, signature binary"), "sketches")


def fewest_equal(percent: int) -> int:
    """Equal symbols that a pair of the similarity asked for has, but for one in 10^9 (six standard deviations)."""
    p = percent / 100
    return max(0, math.floor(SIGNATURE * p - 6 * math.sqrt(SIGNATURE * p * (1 - p))))


def last_block(n: str, block: int) -> Column:
    """Number of the last block of a group of n rows: groups of up to `block` rows stay whole, the largest have blocks of
    2,000 rows, so that every block is small and few pairs of blocks are met."""
    rows = F.greatest(F.lit(block), F.least(F.lit(2_000), 4 * F.sqrt(F.col(n))))
    return F.floor(F.col(n) / rows).cast("int")


def dealt(n: str, node: str, block: int) -> Column:
    """The block of a node in a group of n."""
    return F.pmod(F.xxhash64(node), 1 + last_block(n, block)).cast("int")


def runs(batches, names: list[str]):
    """Tables of rows that are equal in the columns named, from sorted batches; at most one run is held."""
    held = []
    for batch in itertools.chain(batches, [None]):
        rows = pa.Table.from_batches(held + [batch] if batch is not None else held) if held or batch is not None else None
        if rows is None or not len(rows):
            continue
        of = np.stack([rows.column(c).to_numpy() for c in names])
        edge = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), len(rows)]
        last = len(edge) - (1 if batch is None else 2)
        for i, j in zip(edge[:last], edge[1 : last + 1]):
            yield rows.slice(i, j - i)
        held = rows.slice(edge[last]).to_batches() if batch is not None else []


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE)


def buckets(reps: DataFrame) -> DataFrame:
    """node, lead, bucket: the members of each key, but for the least of them, which leads them; keys with the same
    members are one bucket. Only numbers travel, one a symbol, and a key's members are read in order with spills."""

    def expand(batches):
        for batch in batches:
            nodes, signs = batch.column(0).to_numpy(zero_copy_only=False), signatures(batch.column(1))
            for i in range(0, len(nodes), 2_000):
                k = keys(signs[i : i + 2_000]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(nodes[i : i + 2_000], SIGNATURE))], ["key", "node"])
        trim()

    rows = reps.select("node", "signature").mapInArrow(expand, "key long, node long")
    key = Window.partitionBy("key")
    met = rows.select("node", F.min("node").over(key).alias("lead"), F.bit_xor(F.xxhash64("node")).over(key).alias("bucket"))
    return scratch(met.where("node <> lead").distinct(), "buckets")


def near_leads(found: DataFrame, reps: DataFrame, fewest: int) -> DataFrame:
    """node, lead: members that agree with the lead of a bucket in `fewest` symbols or more."""

    @F.pandas_udf("int")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SIGNATURE) for s in (a, b))
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    signs = reps.select(F.col("node").alias("lead"), F.col("signature").alias("other"))
    pairs = found.select("node", "lead").distinct().join(reps.select("node", "signature"), "node").join(signs, "lead")
    return scratch(pairs.where(agreement("signature", "other") >= fewest).select("node", "lead"), "near")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (node, lead) with 100 * intersection >= percent * union. A lead's members are dealt to blocks, and each block
    gets the lead's set."""
    sizes = pairs.groupBy("lead").agg(F.count("*").alias("n"))
    placed = pairs.join(sizes, "lead").select("lead", "node", dealt("n", "node", block).alias("block"))
    heads = placed.select("lead", F.col("lead").alias("node"), "block").distinct()
    rows = placed.unionByName(heads).join(sets, "node").repartition(partitions(pairs.sparkSession), "lead", "block")
    rows = rows.sortWithinPartitions("lead", "block", F.col("node") != F.col("lead"))

    def test(batches):
        lead, own = None, None
        for batch in batches:
            out = []
            for of, node, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                held = np.frombuffer(raw, np.uint64)
                if of == node:
                    lead, own = of, held
                elif of == lead:
                    both = int((own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held).sum())
                    if 100 * both >= percent * (len(own) + len(held) - both):
                        out.append((node, of))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        trim()

    return scratch(rows.select("lead", "node", "block", "set").mapInArrow(test, "a long, b long"), "links")


def facing(mains: DataFrame, others: DataFrame, by: list[str], block: int) -> DataFrame:
    """Deals two sets of rows (by, home, node) to blocks, every block of one meeting every block of the other: by, kind 0,
    one, two, side (1 and 0), home, node."""
    sizes = mains.groupBy(*by).agg(F.count("*").alias("mains")).join(others.groupBy(*by).agg(F.count("*").alias("rest")), by)
    names = [*by, F.lit(0).alias("kind")]
    a = mains.join(sizes, by).withColumn("other", F.explode(F.sequence(F.lit(0), last_block("rest", block))))
    b = others.join(sizes, by).withColumn("other", F.explode(F.sequence(F.lit(0), last_block("mains", block))))
    a = a.select(*names, dealt("mains", "node", block).alias("one"), F.col("other").alias("two"), F.lit(1).alias("side"), "home", "node")
    return a.unionByName(b.select(*names, F.col("other").alias("one"), dealt("rest", "node", block).alias("two"), F.lit(0).alias("side"), "home", "node"))


def among(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """As facing(), for the blocks of one set of rows: kind 1, sides are the blocks. Groups of one home go."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("home").alias("a"), F.max("home").alias("b")).where("a <> b").select(*by, "n")
    rows = rows.join(sizes, by).withColumn("side", dealt("n", "node", block)).withColumn("other", F.explode(F.sequence(F.lit(0), last_block("n", block))))
    return rows.select(*by, F.lit(1).alias("kind"), F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "home", "node")


def largest(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, main: the home that most rows (by, home, node) of a group have; groups of one home go."""
    sizes = rows.groupBy(*by, "home").agg(F.count("*").alias("n"))
    most = sizes.groupBy(*by).agg(F.max(F.struct("n", "home")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
    return most.select(*by, F.col("top.home").alias("main"))


def sides(rows: pa.Table) -> np.ndarray | None:
    """Sides of the rows of one pair of blocks, if only different ones meet."""
    return rows.column("side").to_numpy() if rows.column("kind")[0].as_py() != 1 or rows.column("one")[0] != rows.column("two")[0] else None


def open_pairs(found: DataFrame, of: DataFrame, reps: DataFrame, fewest: int, block: int) -> tuple[DataFrame, DataFrame]:
    """What is still to be compared, where homes are components and single nodes:

    node, home, target: nodes against all of another home, which most members of a bucket of theirs have;
    a, b: pairs of homes that near members of a bucket connect, beyond that home.
    """
    rows = found.join(of, "node", "left").select("lead", "bucket", "node", F.coalesce("component", "node").alias("home"))
    others = scratch(rows.join(largest(rows, ["lead", "bucket"]), ["lead", "bucket"]).where("home <> main"), "others")
    ahead = others.select("node", "home", F.col("main").alias("target")).distinct()
    group = ["lead", "bucket", "kind", "one", "two"]
    rest = among(others.drop("main"), ["lead", "bucket"], 16 * block).join(reps.select("node", "signature"), "node")
    rest = rest.repartition(partitions(reps.sparkSession), *group).sortWithinPartitions(*group)

    def compare(batches):
        for rows in runs(batches, group):
            homes, signs, side = rows.column("home").to_numpy(), signatures(rows.column("signature")), sides(rows)
            up, out = homes.copy(), []
            for i in range(len(homes) - 1):
                ok = up != up[i] if side is None else (up != up[i]) & (side != side[i])
                ok[: i + 1] = False
                other = np.flatnonzero(ok)
                for j in other[(signs[other] == signs[i]).sum(axis=1) >= fewest]:
                    if up[j] != up[i]:
                        out.append((homes[i], homes[j]))
                        up[up == up[j]] = up[i]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    more = rest.select(*group, "side", "home", "signature").mapInArrow(compare, "a long, b long")
    return scratch(ahead, "ahead"), scratch(more.distinct(), "open")


def linked(sets: list[np.ndarray], signs: np.ndarray, homes: np.ndarray, side: np.ndarray | None, percent: int, fewest: int) -> list[tuple[int, int]]:
    """Places (i, j) of links that connect what 100 * intersection >= percent * union connects, beyond what is of one
    home; with a side each, only pairs of different sides are looked at."""
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(sizes)])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(dense.max() + 1, np.int64)
    up, links = homes.copy(), []
    for i in range(len(sizes)):
        ok = (up != up[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        ok[: i + 1] = False
        if side is not None:
            ok &= side != side[i]
        rest = np.flatnonzero(ok)
        rest = rest[(signs[rest] == signs[i]).sum(axis=1) >= fewest]
        if not len(rest):
            continue
        mark[dense[first[i] : first[i + 1]]] = 1
        both = np.array([mark[dense[first[j] : first[j + 1]]].sum() for j in rest])
        mark[dense[first[i] : first[i + 1]]] = 0
        for j in rest[100 * both >= percent * (sizes[i] + sizes[rest] - both)]:
            if up[i] != up[j]:
                links.append((i, int(j)))
                up[up == up[j]] = up[i]
    return links


def settled(ahead: DataFrame, pairs: DataFrame, of: DataFrame, sets, reps: DataFrame, percent: int, fewest: int, block: int) -> DataFrame:
    """Links that whole sets confirm: of nodes against a home, and between the homes that pairs connect. A cluster's
    largest home is compared with the others only, block by block."""

    def members(homes: DataFrame) -> DataFrame:
        return homes.join(of.withColumnRenamed("component", "home"), "home", "left").select("cluster", "home", F.coalesce("node", "home").alias("node"))

    targets = members(ahead.select(F.col("target").alias("cluster"), F.col("target").alias("home")).distinct())
    first = facing(targets, ahead.select(F.col("target").alias("cluster"), "home", "node"), ["cluster"], block)
    rows = scratch(members(components(pairs).withColumnsRenamed({"node": "home", "component": "cluster"})), "cluster-members")
    both = rows.join(largest(rows, ["cluster"]), "cluster")
    mains, others = both.where("home = main").drop("main"), both.where("home <> main").drop("main")
    second = facing(mains, others, ["cluster"], block).withColumn("kind", F.lit(2))
    dealt_ = scratch(first.unionByName(second).unionByName(among(others, ["cluster"], block)), "dealt")
    group = ["cluster", "kind", "one", "two"]
    every = dealt_.join(sets(dealt_.select("node")), "node").join(reps.select("node", "signature"), "node")
    every = every.repartition(partitions(reps.sparkSession), *group).sortWithinPartitions(*group)

    def compare(batches):
        for rows in runs(batches, group):
            nodes, homes, side = rows.column("node").to_numpy(), rows.column("home").to_numpy(), sides(rows)
            found = []
            if side is None or len(np.unique(side)) > 1:
                found = linked([np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()], signatures(rows.column("signature")), homes, side, percent, fewest)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        trim()

    return scratch(every.select(*group, "side", "home", "node", "signature", "set").mapInArrow(compare, "a long, b long"), "links")


def links(reps: DataFrame, sets, percent: int, block: int = 128) -> DataFrame:
    """Links (a, b) whose components are those of 100 * intersection >= percent * union over pairs that meet in a key.

    reps: node, signature. sets(nodes): node, set (sorted hashes). Each member is tested against each lead that it is near
    to; buckets that this leaves in several components are compared in full, but for pairs of one component.
    """
    fewest = fewest_equal(percent)
    found = buckets(reps)
    near = near_leads(found, reps, fewest)
    some = confirmed(near, sets(near.select("node").union(near.select("lead"))), percent, block)
    of = components(some)
    ahead, pairs = open_pairs(found, of, reps, fewest, block)
    if ahead.isEmpty() and pairs.isEmpty():
        return some
    return some.unionByName(settled(ahead, pairs, of, sets, reps, percent, fewest, block))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, block: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of the links 100 * intersection >= percent * union.

    Documents with equal sets are one class, and only classes are compared. Candidate pairs come from the signatures'
    keys; a component's links are confirmed on whole sets. Groups of more than `block` rows are dealt to blocks, none is cut short.

    No words (or null text): n_shingles 0, linked with nothing. Null doc_id: a row with a null component, linked with
    nothing and kept. Repeated doc_ids: one document, linked by the set of each of its rows. No rows: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("raw"))
    held = sketch(rows, width)
    reps = held.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))
    reps = scratch(reps.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = reps.join(nodes.distinct(), "node", "left_semi").select("id", "digest", "node")

        def of(batches):
            for batch in batches:
                out = []
                for node, digest, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    s = shingles(raw, width)
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:  # a doc_id may come with other texts too
                        out.append((node, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "set"])
            trim()

        return scratch(rows.join(wanted, "id").select("node", "digest", "raw").mapInArrow(of, "node long, set binary").dropDuplicates(["node"]), "sets")

    same = held.where("digest IS NOT NULL AND id IS NOT NULL").select("id", "digest").distinct()
    found = links(reps, sets, percent, block)
    several = same.groupBy("id").agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1").select("id", "first")
    tied = same.join(several, "id").where(F.col("digest") != F.col("first"))  # a doc_id's different sets are one document
    tied = tied.join(reps.select("digest", F.col("node").alias("a")), "digest").join(reps.select(F.col("digest").alias("first"), F.col("node").alias("b")), "first").select("a", "b")
    joined = components(found.unionByName(tied))
    named = reps.join(joined, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("of"))
    named = named.join(named.groupBy("of").agg(F.min("id").alias("component")), "of").select("digest", "component")
    known = held.where("id IS NOT NULL").join(named, "digest", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    every = known.unionByName(held.where("id IS NULL").select("id", "n_shingles", F.col("id").alias("component")))
    return every.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-copies, with its columns: the least doc_id, nulls last, of equal ones any one.

    Every row counts as a document of its own, repeated and null doc_ids too. Rows without words stay. No rows: no rows.
    """
    held = scratch(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")), "copies-docs")
    own = held.select(F.col("_row").alias("doc_id"), "doc.text")
    found = near_duplicates(own, width, percent).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("of"))
    place = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", "_row").alias("place")
    first = found.join(held.select("_row", place), "_row").groupBy("of").agg(F.min_by("_row", "place").alias("_row"))
    return held.join(first, "_row", "left_semi").select("doc.*")
