"""Hashed text embeddings, chunking by separators, and standing similarity queries."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import NEAR, Rows, asked_rows, dealt, raw

WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def place(part: bytes) -> int:
    """32-bit hash: 5381, then times 33 plus each byte."""
    h = 5381
    for b in part:
        h = (h * 33 + b) & 0xFFFFFFFF
    return h


def hashed(text: str, size: int) -> np.ndarray:
    """1 at the place of each word, and a half at that of each three bytes of it."""
    out = np.zeros(size, np.float32)
    for w in WORD.findall(text.lower()):
        raw = w.encode()
        out[place(raw) % size] += 1
        for i in range(len(raw) - 2):
            out[place(raw[i : i + 3]) % size] += 0.5
    return out


def frequencies(text: str, size: int) -> np.ndarray:
    """Share of the text's words at each word's place."""
    out = np.zeros(size, np.float64)
    words = WORD.findall(text.lower())
    for w in words:
        out[place(w.encode()) % size] += 1
    return (out / max(len(words), 1)).astype(np.float32)


def embed(text: Column, size: int = 128, how: str = "hash") -> Column:
    """array<float> of hashed words and three-grams (hash) or word shares (tf); zeros for text without words, null for null."""
    one = {"hash": hashed, "tf": frequencies}[how]

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t, size), na_action="ignore")

    return of(text)


def split(text: str, separators: list[str], most: int, least: int, at: int = 0) -> list[tuple[int, str]]:
    """(start, text): what fits stays; else split at the first separator, its parts at the next, then by length."""
    if len(text) <= most:
        return [(at, text)] if len(text) >= least else []
    if not separators:
        return [(at + i, text[i : i + most]) for i in range(0, len(text), most) if len(text[i : i + most]) >= least]
    out = []
    for part in text.split(separators[0]):
        out += split(part, separators[1:], most, least, at)
        at += len(part) + len(separators[0])
    return out


def gather(text: str, separators: list[str], most: int, least: int) -> list[tuple[int, str]]:
    """Neighbouring parts of the first separator that occurs, joined while they fit; parts that don't fit are cut."""
    by = next((s for s in separators if s in text), None)
    if by is None:
        return split(text, [], most, least)
    out, held, start, at = [], "", 0, 0
    for part in text.split(by):
        if held and len(held) + len(by) + len(part) > most:
            out += split(held, [], most, least, start)
            held, start = part, at
        else:
            held = held + by + part if held else part
            start = start if held != part else at
        at += len(part) + len(by)
    return out + split(held, [], most, least, start)


def chunk(df: DataFrame, ident: str, text: str, most: int = 512, least: int = 1, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " "), how: str = "recursive") -> DataFrame:
    """id, chunk, start, text (characters): recursive splits, or semantic ones that join neighbours. Null: no chunk."""
    one = {"recursive": split, "semantic": gather}[how]

    @F.pandas_udf("array<struct<start: long, text: string>>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": s, "text": c} for s, c in one(t, list(separators), most, least)], na_action="ignore")

    rows = df.select(F.col(ident).alias("id"), F.posexplode(of(F.col(text))).alias("chunk", "c"))
    return rows.select("id", F.col("chunk").cast("long"), "c.start", "c.text")


def subscribe(records: DataFrame, standing: DataFrame, least: float = 0.8, most_standing: int = 10_000, in_blocks: bool = False) -> DataFrame:
    """id, subscription, similarity: records (id, vector) near standing queries (subscription, query).

    For batches and, through foreachBatch, streams. Standing queries go to every task, so more than `most_standing` are
    refused, or with `in_blocks` sent in blocks of about that many, each with a pass over the records. Records are dealt
    evenly and multiplied with the queries batch by batch; pairs that reach `least` are confirmed one by one.
    """
    n = standing.count()
    if n > most_standing and not in_blocks:
        raise ValueError(f"{n} standing queries, more than {most_standing}; ask for blocks")
    blocks = max(1, -(-n // most_standing))
    kinds = {"id": dict(records.dtypes)["id"], "subscription": dict(standing.dtypes)["subscription"]}
    rows = dealt(records.where("vector IS NOT NULL").select("id", "vector"))
    parts = [rows.mapInArrow(matches(standing, blocks, b, least), f"id {kinds['id']}, subscription {kinds['subscription']}, similarity double") for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matches(standing: DataFrame, blocks: int, number: int, least: float):
    """A step over Arrow batches of (id, vector) that gives the pairs of a similarity of `least` or more with one block."""
    names, asked = asked_rows(standing, "subscription", blocks, number)
    lengths = np.diff(np.asarray(asked.offsets))
    groups = [(names.filter(pa.array(lengths == n)), raw(asked.filter(pa.array(lengths == n)), max(n, 1))) for n in np.unique(lengths)]
    sent = standing.sparkSession.sparkContext.broadcast(groups)  # by length, as vectors of other lengths aren't alike

    def run(batches):
        groups = [(names, Rows(vectors)) for names, vectors in sent.value]
        for batch in batches:
            own, found = batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("vector"))
            for names, wanted in groups:
                step = max(1, min(2_048, (1 << 22) // len(names)))  # products of 32 MB at most
                for i in range(0, batch.num_rows, step):
                    have, ids = Rows(raw(found.slice(i, step), wanted.vectors.shape[1])), own.slice(i, step)
                    near = np.flatnonzero(~(wanted.units @ have.units.T < least - NEAR))
                    for j in range(0, len(near), 1 << 18):
                        q, r = np.divmod(near[j : j + (1 << 18)], len(ids))
                        s = wanted.cosines(q, have, r)
                        ok = ~(s < least)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r[ok])), names.take(pa.array(q[ok])), pa.array(s[ok])], ["id", "subscription", "similarity"])

    return run
