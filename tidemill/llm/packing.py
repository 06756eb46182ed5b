"""Vector best-fit packing: token, document-count and attention-cost capacities choose the bin."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .tokens import chunks, default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fit(lengths: np.ndarray, tokens: int = 2048, documents: int = 2048, attention: float | None = None, weights=(1.0, 1e-4, 1e-4), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first.

    A piece's demand is (length, 1, length squared); a bin takes it only if all three capacities hold. Of these bins,
    rule "norm" takes the one whose weighted residual vector is shortest afterwards, "dot" the one whose weighted
    residual has the smallest product with the demand (the tightest along what the piece needs). Lower bins win ties.
    """
    attention = float(tokens) ** 2 if attention is None else attention
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.max() > tokens or lengths.max() ** 2 > attention or documents < 1 or lengths.min() < 1):
        raise ValueError("a piece fits no bin")
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.zeros((3, 1024))  # residuals of the bins that can still take something
    ids, live, made = np.zeros(1024, np.int64), 0, 0
    scale, wide = np.array([tokens, documents, attention], float), np.asarray(weights, float)
    least = lengths[order[-1]] if len(order) else 0
    for i in order:
        n = int(lengths[i])
        need = np.array([n, 1, n * n], float)
        if live:
            left = room[:, :live]
            ok = np.flatnonzero((left[0] >= n) & (left[1] >= 1) & (left[2] >= need[2]))
        if live and len(ok):
            after = left[:, ok] - need[:, None] if rule == "norm" else left[:, ok]
            after = after / scale[:, None]
            cost = (wide[:, None] * after**2).sum(axis=0) if rule == "norm" else (wide * need / scale) @ after
            k = ok[int(np.argmin(cost))]
        else:
            if live == room.shape[1]:
                keep = np.flatnonzero((room[0, :live] >= least) & (room[1, :live] >= 1) & (room[2, :live] >= least * least))
                room[:, : len(keep)], ids[: len(keep)], live = room[:, keep], ids[keep], len(keep)
                if live > room.shape[1] // 2:
                    room, ids = np.concatenate([room, np.zeros_like(room)], axis=1), np.concatenate([ids, np.zeros_like(ids)])
            k, live = live, live + 1
            room[:, k], ids[k], made = scale, made, made + 1
        bins[i], offsets[i] = ids[k], tokens - int(room[0, k])
        room[:, k] -= need
        if room[0, k] < least or room[1, k] < 1 or room[2, k] < least * least:  # full: the last bin takes its place
            live -= 1
            room[:, k], ids[k] = room[:, live], ids[live]
    return bins, offsets


def pieces(docs: DataFrame, tokens: int = 2048, tokenizer: str | None = None, separator: int = 0, pieces_kept: int = 800_000) -> DataFrame:
    """A document's ids and the separator; only longer ones are cut, from the end, into full pieces."""
    path, names = tokenizer or default_path(), [f.split()[0] for f in PIECES.split(", ")]

    def cut(batches):
        last = np.array([separator], "<u4").tobytes()
        for batch in batches:
            for rows in chunks(batch):
                out = []
                for doc, raw in zip(rows.column(0).to_pylist(), encoder(path, pieces_kept).encode(rows.column(1).to_pylist())):
                    raw, at = raw + last, 0
                    n = len(raw) // 4
                    end = n if n <= tokens else n % tokens or tokens
                    for k in range(-(-n // tokens)):
                        out.append((doc, k, at, end - at, zlib.crc32(raw[4 * at : 4 * end])))
                        at, end = end, end + tokens
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).mapInArrow(cut, PIECES)


def pack(sized: DataFrame, tokens: int = 2048, documents: int = 2048, attention: float | None = None, group_tokens: int = 4_000_000, group_rows: int = 16_000, full: float = 0.98, **options) -> DataFrame:
    """Adds sequence_id and offset to a table with a column `length` (1 to `tokens`).

    Pieces are dealt by a hash of their place in the table to groups of about group_tokens or group_rows, which bounds a
    task's memory and bins at every size. The pieces of bins that a group leaves open, by tokens under the share `full`,
    are packed again, with those of other groups.
    """
    held = scratch(sized.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)

    def groups(df: DataFrame) -> int:
        total = df.agg(F.sum("length").alias("tokens"), F.count("*").alias("rows")).first()
        return 1 + max((total["tokens"] or 0) // group_tokens, total["rows"] // group_rows)

    def placed(df: DataFrame, n: int, turn: int) -> DataFrame:
        def place(key, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_row", ignore_index=True)
            bins, offsets = fit(rows["length"].to_numpy(), tokens, documents, attention, **options)
            fill = np.bincount(bins, rows["length"].to_numpy())[bins]
            return rows.drop(columns=["_group"]).assign(sequence_id=(turn << 60) + (int(key[0]) << 24) + bins, offset=offsets, _open=fill < full * tokens)

        return df.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(n))).groupBy("_group").applyInPandas(place, f"{schema}, _row long, sequence_id long, offset long, _open boolean")

    n = groups(held)
    first = placed(held, n, 0)
    if n > 1:
        first = scratch(first, "packed")
        rest = first.where("_open").select(*held.columns)
        first = first.where("NOT _open").unionByName(placed(rest, groups(rest), 1))
    return first.drop("_row", "_open")


def packed(docs: DataFrame, tokens: int = 2048, tokenizer: str | None = None, separator: int = 0, pieces_kept: int = 800_000, **options) -> DataFrame:
    """Null or empty text: the separator alone. Null and repeated doc_ids are packed each. No rows: no rows.

    pieces_kept trades a worker's memory (some 300 bytes a piece) for time; results are the same.
    """
    return pack(pieces(docs, tokens, tokenizer, separator, pieces_kept), tokens, **options)
