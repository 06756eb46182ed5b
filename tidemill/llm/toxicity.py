"""Counterfactual-regularised toxicity classifier: logistic regression over word and word-start features, with a penalty
on how far a swap of identity terms moves a labelled text's score."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_bytes, trim
from .shingles import ODD, STEPS, TABLE, mix

#: Terms that name groups of people; a term is swapped for others of its line.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "european", "american", "arab", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "chicas", "chicos"),
)
SWAPS = {term: [x for x in line if x != term] for line in IDENTITY for term in line}
TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(SWAPS, key=lambda x: (-len(x), x))) + r")(?!\w)", re.IGNORECASE)
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True
BITS = 20
#: Word starts that are features, in bytes.
STARTS = (4, 5, 6, 7, 8)


def swapped(text: str, turn: int) -> str | None:
    """The text with each identity term replaced by another of its line; None if it has none."""
    out, n = TERM.subn(lambda m: (line := SWAPS[m[0].lower()])[turn % len(line)], text)
    return out if n else None


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of texts, and each one's text: its words (runs of letters), their starts, and word pairs."""
    x = np.frombuffer((b"\n".join(raws) + b"\n").lower(), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], LETTER[x], [False]])))
    start, end = edge[::2], edge[1::2]
    of = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), start, side="right").astype(np.int32)
    up, down = STEPS.get(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(TABLE[x] * up[: len(x)], out=total[1:])
    word = mix((total[end] - total[start]) * down[start])
    same = of[1:] == of[:-1]
    found, texts = [word, mix(word[:-1][same] * ODD[3] + word[1:][same] * ODD[4])], [of, of[1:][same]]
    for n in STARTS:
        long = end - start > n
        s = start[long]
        found.append(mix((total[s + n] - total[s]) * down[s] + np.uint64(n)))
        texts.append(of[long])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(texts)


def distinct(raws: list[bytes]) -> list[np.ndarray]:
    """The distinct features of each text, sorted."""
    if not raws:
        return []
    f, of = features(raws)
    both = np.unique(of.astype(np.int64) << BITS | f)
    return np.split((both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(1, len(raws))))


@dataclass
class Model:
    """Sorted features and their weights: no more than the bounded sample of `fit` has, so its size is bounded."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, raws: list[bytes], size: int = 1 << 19) -> np.ndarray:
        """Scores of texts, about `size` bytes of them at a time."""
        table = np.full(1 << BITS, -1, np.int32)
        table[self.features] = np.arange(len(self.features))
        z, group, n = np.full(len(raws), float(self.bias)), [], 0
        for i, raw in enumerate(raws):
            group.append(raw)
            n += len(raw)
            if n >= size or i + 1 == len(raws):
                f, of = features(group)
                at = table[f]
                hit = np.flatnonzero(at >= 0)
                both = np.unique(of[hit].astype(np.int64) << BITS | at[hit])  # a feature counts once a text
                z[i + 1 - len(group) : i + 1] += np.bincount(both >> BITS, self.weights[both & ((1 << BITS) - 1)], len(group))
                group, n = [], 0
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def score(self, raw: bytes) -> float:
        return float(self.scores([raw])[0])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def descend(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], width: int, decay: float, fair: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the weighted log loss, decay on the weights, and fair times the mean squared score change."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    n = max(1, len(pairs))
    prow = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(pairs)] or [np.zeros(0, np.int64)]).astype(np.int64)
    pcol = np.concatenate([np.concatenate(p) for p in pairs] or [np.zeros(0, np.int64)]).astype(np.int64)
    sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs] or [np.zeros(0)])
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + w[-1]
        g = weight * (1 / (1 + np.exp(-z)) - target)
        grad = np.bincount(col, g[row], width + 1) + decay * w
        grad[-1] = g.sum()
        if len(pairs):
            move = np.bincount(prow, sign * w[pcol], len(pairs))
            grad += 2 * fair / n * np.bincount(pcol, sign * move[prow], width + 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, each: int = 6_000, least_gain: float = 16.0, decay: float = 3e-5, fair: float = 1.0, swaps: int = 2, steps: int = 500, folds: int = 5) -> Model:
    """Learns from labelled rows outside the held-out fold: at most `each` of either label, those first by a hash of
    doc_id (a documented bound on a sample; every text of it is whole). Features are those of enough log-likelihood gain
    over the sample, so texts reach the driver as a few feature numbers. The bias is set back to the labels' rates.

    A doc_id labelled more than once is toxic if any row says so. Null labels are left out. With no labels of either
    kind the score is the rate of toxic labels (0.5 / (rows + 1) at least).
    """
    named = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id"), folds))
    )
    rates = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    positive, negative = rates.get(1, 0), rates.get(0, 0)
    prior = (positive + 0.5) / (positive + negative + 1) if positive + negative else 0.0
    if not positive or not negative:
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    first = F.xxhash64("doc_id")
    sample = named.where("toxic = 1").orderBy(first, "doc_id").limit(each).unionByName(named.where("toxic = 0").orderBy(first, "doc_id").limit(each))
    sample = scratch(sample, "tox-sample")

    def of(batches):
        for batch in batches:
            raws = batch.column(2).to_pylist()
            own = distinct(raws)
            changed = [[t.encode() for k in range(swaps) if (t := swapped(raw.decode("utf-8", "replace"), k)) is not None] for raw in raws]
            flat, at = distinct([t for ts in changed for t in ts]), np.cumsum([0, *map(len, changed)])
            other = [flat[i:j] for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "own", "other"])
            del raws, own, changed, flat, other
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw")).join(F.broadcast(sample), "doc_id")  # at most 2 * each ids
    held = scratch(rows.select("doc_id", "toxic", "raw").mapInArrow(of, "doc_id long, toxic int, own array<int>, other array<array<int>>"), "tox-features")
    seen = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    n1, n0 = seen.get(1, 0), seen.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(prior / (1 - prior))))
    counts = held.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))

    def part(k, n, share):
        return F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (n1 + n0)
    gain = 2 * (part(a, n1, share) + part(b, n0, share) + part(n1 - a, n1, 1 - share) + part(n0 - b, n0, 1 - share))
    chosen = counts.where((a + b >= 4) & (a + b < n1 + n0)).withColumn("gain", gain).where(F.col("gain") >= least_gain)
    picked = np.sort(np.array([r["f"] for r in chosen.select("f").collect()], np.int32))
    if not len(picked):
        return Model(picked, np.zeros(0), float(np.log(prior / (1 - prior))))

    def narrow(batches):
        def cut(x):
            x = np.asarray(x, np.int32)
            at = np.minimum(np.searchsorted(picked, x), len(picked) - 1)
            return at[picked[at] == x].astype(np.int32)

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([cut(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int32())), pa.array([[cut(x) for x in xs] for xs in batch.column(3).to_pylist()], pa.list_(pa.list_(pa.int32())))], ["toxic", "own", "other"])

    got = held.mapInArrow(narrow, "toxic int, own array<int>, other array<array<int>>").toArrow().to_pydict()  # a few numbers a row
    own = [np.array(x, np.int64) for x in got["own"]]
    target = np.array(got["toxic"], float)
    pairs = [(x, np.array(y, np.int64)) for x, ys in zip(own, got["other"]) for y in ys]
    weight = np.where(target == 1, positive / n1, negative / n0)  # the sample's rates back to the labels'
    w, bias = descend(own, target, weight, pairs, len(picked), decay, fair, steps)
    return Model(picked, w, bias)


def score(model: Model, raw: Column) -> Column:
    sent = model  # weights of the sample's features, sent with the function

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        found = sent.scores(texts.tolist())
        trim()
        return pd.Series(found, dtype=float)

    return of(raw)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null or empty text: the bias alone. Null doc_id counts as the
    empty string in the fold. Repeated rows: a row each. No rows: no rows."""
    model = fit(docs, labels, folds=folds, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(model, text_bytes()).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns. Null and empty texts stay, and so do texts
    that show nothing: a text is rejected if its own features bring its score to 0.5 or more."""
    model = fit(docs, labels, **options)
    found, bare = score(model, text_bytes()), float(model.scores([b""])[0])
    return docs.withColumn("_toxicity", found).where((F.octet_length(text_bytes()) == 0) | (F.col("_toxicity") < 0.5) | (F.col("_toxicity") <= bare)).select(*docs.columns)
