"""Document fingerprints from prefix polynomial hashes: modular prefix arrays answer span equality and extensions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

P = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 1_610_612_741)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_start long, same_start_next long"


def mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for x under 2^62, by folding."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


class Powers:
    """Powers of the bases and of their inverses, grown to the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones((2, 1), np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while self.up.shape[1] < n:
            size, up, down = self.up.shape[1], [], []
            for k, b in enumerate(BASES):
                for rows, into, base in ((self.up, up, b), (self.down, down, pow(b, -1, int(P)))):
                    into.append(np.concatenate([rows[k], mod(rows[k] * np.uint64(pow(base, size, int(P))))]))
            self.up, self.down = np.stack(up), np.stack(down)
        return self.up[:, :n], self.down[:, :n]


POWERS = Powers()


class Prefix:
    """Prefix arrays of one text (code points): sums of code times base^place, modulo 2^31 - 1, for two bases."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        self.up, self.down = POWERS.get(self.n + 1)
        term = mod((codes.astype(np.uint64) + np.uint64(1)) * self.up[:, : self.n])
        self.sums = np.zeros((2, self.n + 1), np.uint64)
        self.sums[:, 1:] = mod(np.cumsum(term, axis=1))

    def spans(self, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the spans of that width: at the given places, or at all."""
        if at is None:
            a, b, down = self.sums[:, : self.n + 1 - width], self.sums[:, width:], self.down[:, : self.n + 1 - width]
        else:
            a, b, down = self.sums[:, at], self.sums[:, at + width], self.down[:, at]
        h = mod((b + P - a) * down if width else (b - a))
        return (h[0] << np.uint64(31)) | h[1]

    def span(self, at: int, width: int) -> int:
        """Hash of one span, as spans() gives it."""
        p, sums, down = int(P), self.sums, self.down
        one, two = ((sums.item(k, at + width) - sums.item(k, at)) * down.item(k, at) % p for k in (0, 1))
        return one << 31 | two

    def whole(self) -> int:
        return self.span(0, self.n)


def equal(x: Prefix, i: int, y: Prefix, j: int, width: int) -> bool:
    return x.span(i, width) == y.span(j, width)


def extension(x: Prefix, i: int, y: Prefix, j: int) -> int:
    """Length of the longest common extension of x from i and y from j, by binary search."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal(x, i, y, j, mid) else (low, mid - 1)
    return low


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Fingerprint:
    """Length, hash of the whole text, and the `keep` smallest mixed hashes of all its spans of `width` characters.

    A shorter text has one span, itself; the empty text has none.
    """

    def __init__(self, codes: np.ndarray, width: int = 16, keep: int = 64) -> None:
        self.prefix = prefix = Prefix(codes)
        self.n, self.hash, self.keep = prefix.n, prefix.whole() if prefix.n else 0, keep
        h = mix(prefix.spans(min(width, self.n))) >> np.uint64(24) if self.n else np.zeros(0, np.uint64)
        few = h
        if len(h) > 16 * keep:
            few = h[h < np.uint64(int((1 << 40) * 4 * keep / len(h)))]
        low = np.unique(few)[:keep]
        self.low = low if len(low) == keep or len(few) == len(h) else np.unique(h)[:keep]

    def __str__(self) -> str:
        return f"{self.n:x}.{self.hash:x}." + "".join(f"{x:010x}" for x in self.low.tolist())


def same_start(x: Fingerprint, y: Fingerprint) -> int:
    """Characters that two texts share from their start; all of them if the whole spans are equal."""
    return x.n if x.n == y.n and x.hash == y.hash else extension(x.prefix, 0, y.prefix, 0)


def likeness(x: Fingerprint, y: Fingerprint) -> float:
    """Jaccard similarity of the span sets: the share of both among the smallest of their union (1 if both are empty)."""
    if not x.n and not y.n:
        return 1.0
    both = np.concatenate([x.low, y.low])
    seen, times = np.unique(both, return_counts=True)
    return float((times[: x.keep] == 2).sum() / len(seen[: x.keep]))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, width: int = 16, keep: int = 64) -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last third is the start of the next document; how like they
    are, and how many characters they share from the start (the longest common extension, by binary search over the
    prefix arrays).

    Next: the next lower doc_id, after the lowest the highest; equal doc_ids go by a hash of the text. Null text: empty.
    Null doc_id: below all others. One document alone is its own next. No rows: no rows.

    Ranges of doc_id are dealt to tasks by approximate quantiles (one shuffle of the texts). Each range's first row is
    sent a second time, to the range before it; these are as many as there are ranges.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(lowest)).alias("k"), F.xxhash64("text").alias("h"))
    cuts = keyed.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(np.int64), side="right").astype(np.int32))

    heads = keyed.select(part("k").alias("part"), "k", "h").groupBy("part").agg(F.max(F.struct("k", "h")).alias("top")).orderBy("part").collect()  # a row a range
    if not heads:
        return spark.createDataFrame([], OUT)
    # ranges in reading order run from the highest part down; a head also goes to the part read before it
    parts = [r["part"] for r in heads]
    sent = spark.createDataFrame([(r["top"]["k"], r["top"]["h"], parts[(i + 1) % len(parts)]) for i, r in enumerate(heads)], "k long, h long, part int")
    again = keyed.join(F.broadcast(sent), ["k", "h"]).dropDuplicates(["k", "h"]).select("doc_id", "text", "k", "h", "part", F.lit(True).alias("ahead"))
    own = keyed.select("doc_id", "text", "k", "h", part("k").alias("part"), F.lit(False).alias("ahead"))
    dealt = own.unionByName(again).repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int"))
    dealt = dealt.sortWithinPartitions("part", "ahead", F.desc("k"), F.desc("h")).select("doc_id", "text", "part", "ahead")
    names = [f.split()[0] for f in OUT.split(", ")]

    def walk(batches):
        held = None  # the document whose next one is still to come
        for batch in batches:
            out = []
            for doc, text, of, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                code = codes(text)
                own = Fingerprint(code, width, keep)
                if held is not None and held[2] == of:
                    was, words, _, mine = held
                    change = edited(words, text)
                    made = Fingerprint(codes(change), width, keep)
                    out.append((was, len(words), hashlib.sha256(change.encode()).hexdigest(), str(mine), str(made), likeness(mine, made), likeness(mine, own), same_start(mine, made), same_start(mine, own)))
                held = None if ahead else (doc, text, of, own)
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return dealt.mapInArrow(walk, OUT)
