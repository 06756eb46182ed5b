"""Removes bytes that a string of `length` bytes covers which also starts in a document with a smaller doc_id.

Suffix order by column-wise multi-document construction: every string of a collection gets one more symbol on its left
each round; a stable sort of the round's symbols (the transform's symbols, read in the order of the last round) gives the
order of the longer suffixes, and range minima carry the common prefixes along. Collections, transforms, records and
masks are sequential files and blobs that each step writes or reads from front to back.

Whole documents would take as many rounds as the longest has bytes, each over the whole collection. So the strings are
pieces: each window of `length` bytes belongs to the anchor (least hashed `MARK`-gram) in it, equal windows have equal
anchors at equal places, and all windows of an anchor lie in a piece of 2 * length - MARK bytes. Pieces are aligned at
their anchors, dealt to buckets by the anchor's hash, and built in 2 * length - MARK rounds.

1. collect: a task writes its documents to a collection file and deals its anchors' hashes to buckets.
2. shared:  a bucket finds the anchors that two documents have (others can't repeat) and tells the tasks.
3. records: a task deals the pieces of shared anchors; equal pieces of a task travel once, for its least doc_id.
4. build:   a bucket inserts columns from the right, one symbol of each string a round. The transform's symbols and the
            common prefixes of the round follow those of the round before in the bucket's transform file, from which the
            strings can be restored. Equal windows are runs whose common prefix is long enough, and a window is repeated
            if its run has a smaller doc_id. A bit for each place of the window goes back.
5. remove:  a task marks the bytes and reads what is left from its collection file.
"""

from __future__ import annotations

import hashlib
import io
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt, filesystem, partitions, scratch, scratch_path, text_bytes, trim
from .shingles import STEPS, TABLE, mix

MARK = 26
PIECE = 1 << 18  # longer documents are read in pieces that overlap
LAST = (1 << 63) - 1


def squeeze(raw, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def put(folder: str, name: str, arrays: list[np.ndarray], level: int = 3) -> None:
    """Writes arrays to a file of that name; a second attempt writes the same and takes the first one's place."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{attempt()[1]}-{name}"
    with fs.open_output_stream(part) as out:
        for a in arrays:
            raw = squeeze(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"", level)
            out.write(struct.pack("<q4s", len(raw), a.dtype.str.encode()) + raw)
    fs.move(part, f"{root}/{name}")


def get(folder: str, name: str) -> list[np.ndarray]:
    fs, root = filesystem(folder)
    out = []
    with fs.open_input_stream(f"{root}/{name}") as f:
        while head := f.read(12):
            n, kind = struct.unpack("<q4s", head)
            out.append(np.frombuffer(expand(f.read(n)), kind.rstrip(b"\0").decode()))
    return out


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences."""
    return squeeze(np.diff(sorted_values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def anchors(x: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts one after the other (each ends at ends): anchor places, how far before them the last and the first of
    their windows start, hash of the anchor, hash of all that its windows cover."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint8, np.uint8, np.uint64, np.uint64))
    n = len(x)
    if n < length:
        return none
    up, down = STEPS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[x] * up[:n], out=total[1:])
    h = mix((total[MARK:] - total[:-MARK]) * down[: n + 1 - MARK])
    low = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    width, reach = length - MARK + 1, 1
    while reach * 2 <= width:  # least of 2, 4, 8 ... neighbours
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if rest := width - reach:
        low = np.minimum(low[:-rest], low[rest:])
    starts = np.concatenate([[0], ends[:-1]])
    room = ends - starts - length + 1
    fits = room > 0
    idx = np.repeat(starts[fits] - np.concatenate([[0], np.cumsum(room[fits])[:-1]]), room[fits]) + np.arange(room[fits].sum())
    if not len(idx):
        return none
    at = (low[idx] & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (idx[1:] != idx[:-1] + 1)]))
    a, lo, hi = at[first], idx[first], idx[np.append(first[1:], len(idx)) - 1]
    whole = mix((total[hi + length] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return a, (a - hi).astype(np.uint8), (a - lo).astype(np.uint8), h[a], whole


def parts(sizes: np.ndarray, length: int, limit: int = PIECE):
    """Runs of documents of about `limit` bytes: lists of (document, from, to); a longer document is cut with overlaps."""
    run, n, base = [], 0, 0
    for d, size in enumerate(sizes.tolist()):
        at = 0
        while True:
            end = min(size, at + limit)
            run.append((d, base + at, base + end))
            n += end - at
            if n >= limit:
                yield run
                run, n = [], 0
            if end == size:
                break
            at = end - length + 1
        base += size
    if run:
        yield run


def found(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """anchors() of all documents of a collection, places counted from its start, and each one's document."""
    out = []
    for run in parts(sizes, length):
        doc, begin, end = (np.array(v, np.int64) for v in zip(*run))
        piece = np.concatenate([text[b:e] for b, e in zip(begin, end)])
        ends = np.cumsum(end - begin)
        a, low, high, h, whole = anchors(piece, ends, length)
        k = np.searchsorted(ends, a, side="right")
        move = (begin - (ends - (end - begin)))[k]
        out.append((a + move, low, high, h, whole, doc[k].astype(np.int32)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint8, np.uint8, np.uint64, np.uint64, np.int32))
    return tuple(np.concatenate(v) for v in zip(*out))


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(23) << np.uint64(1)


class Transform:
    """A sequential file of the rounds: for each, its symbols in the order of the round before, and how many leading
    columns each string of the new order differs after from the string before it."""

    def __init__(self, sink) -> None:
        self.sink = sink

    def add(self, symbols: np.ndarray, same: np.ndarray) -> None:
        for a in (symbols, same):
            raw = squeeze(a.tobytes(), 1)
            self.sink.write(struct.pack("<q", len(raw)) + raw)


def rounds(source):
    """Symbols and common prefixes of each round of a transform file."""
    parts = []
    while head := source.read(8):
        parts.append(np.frombuffer(expand(source.read(struct.unpack("<q", head)[0])), np.uint8))
        if len(parts) == 2:
            yield tuple(parts)
            parts = []


def restore(source) -> np.ndarray:
    """The strings (columns x strings) of a transform file."""
    order, columns = None, []
    for symbols, _ in rounds(source):
        order = np.arange(len(symbols)) if order is None else order
        column = np.empty(len(symbols), np.uint8)
        column[order] = symbols
        columns.append(column)
        order = order[np.argsort(symbols, kind="stable")]
    return np.stack(columns[::-1])


def build(columns: np.ndarray, keys: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, transform: Transform | None = None) -> np.ndarray:
    """Column-wise construction over aligned strings (columns x strings). Bit o of a string's mask: its window that
    begins o columns before the anchor's also begins a string with a smaller key. first, last: its windows' range of o."""
    wide, n = columns.shape
    pad = length - MARK
    order = np.arange(n)
    same = np.full(n + 1, wide, np.uint8)  # first column in which a string differs from the one before it in the order
    same[0] = same[n] = 0
    mask = np.zeros(n, np.uint32)
    for c in range(wide - 1, -1, -1):
        symbols = columns[c][order]  # the transform's symbols of this round
        move = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[move]
        grown = np.full(n + 1, c, np.uint8)
        if n > 1:
            least = np.minimum.reduceat(same, move + 1)  # over what lay between neighbours with equal symbols
            equal = sorted_symbols[1:] == sorted_symbols[:-1]
            grown[1:n][equal] = least[:-1][equal]
        order, same = order[move], grown
        same[0] = 0
        if transform:
            transform.add(symbols, same[:n])
        if c <= pad:
            o = pad - c
            own = (first[order] <= o) & (o <= last[order])
            key = np.where(own, keys[order], LAST)
            run = np.flatnonzero(np.concatenate([[True], same[1:n] < c + length]))
            low = np.repeat(np.minimum.reduceat(key, run), np.diff(np.append(run, n)))
            mask[order[own & (low < key)]] |= np.uint32(1 << o)
    return mask


BLOB = "task int, bucket int, raw binary"


def together(df: DataFrame, column: str, n: int, step, schema: str) -> DataFrame:
    """Runs step over all rows of each number in a column (0 to n - 1): one partition for each, however small it is."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from step(pa.Table.from_batches(held))
            del held
            trim()

    return df.repartitionById(n, F.col(column)).mapInArrow(run, schema)


def blob(task: int, bucket: int, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([bucket], pa.int32()), pa.array([raw], pa.binary())], ["task", "bucket", "raw"])


def repeats(docs: DataFrame, length: int = 50, keep_text: bool = False, row: str | None = None, bucket_bytes: int = 256 << 20) -> DataFrame:
    """row (null unless a column is named), doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null unless asked
    for), span_starts, span_ends.

    Null text: empty, nothing to remove. Null doc_id: larger than every other one. Equal doc_ids: none is smaller, so
    repeated rows keep what no smaller doc_id has. Texts shorter than `length`: kept. No rows: no rows.

    A bucket gets the pieces of about bucket_bytes of text or less, so that buckets grow in number and not in size.
    """
    if not MARK < length <= MARK + 32:
        raise ValueError(f"strings of {MARK + 1} to {MARK + 32} bytes are supported")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_bytes()))).first()[0] or 0
    folder, buckets, pad = scratch_path(spark, "collections"), max(partitions(spark), size // bucket_bytes), length - MARK
    ident = F.col(row).cast("long") if row else F.lit(None).cast("long")
    rows = docs.select(ident.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))

    def collect(batches):
        task, _ = attempt()
        raws, meta = [], []
        for batch in batches:
            meta.append(pa.RecordBatch.from_arrays([pa.array(batch.column(i).to_pylist(), pa.int64()) for i in (0, 1)], ["row", "doc_id"]))  # a view would hold the texts
            raws += batch.column(2).to_pylist()
        if not raws:
            return
        text, sizes = np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws], np.int64)
        del raws
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, meta[0].schema) as out:
            for m in meta:
                out.write_batch(m)
        put(folder, f"collection-{task}", [np.frombuffer(sink.getvalue(), np.uint8), sizes, text])
        keys = pa.concat_arrays([m.column(1) for m in meta]).fill_null(LAST).to_numpy()
        _, _, _, h, _, doc = found(text, sizes, length)
        h = short(h)
        order = np.argsort(h, kind="stable")
        h, key = h[order], keys[doc[order]] if len(doc) else keys[:0]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        several = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) if len(h) else np.zeros(0, bool)
        h = h[first] | several.astype(np.uint64)
        where = (h >> np.uint64(1)) % np.uint64(buckets)
        for b in np.unique(where).tolist() or [task % buckets]:  # a task without anchors is known to one bucket
            yield blob(task, int(b), pack(h[where == b]))
        del text, sizes, h, key, where
        trim()

    def shared(group: pa.Table):
        names, sets = group.column("task").to_pylist(), [unpack(r) for r in group.column("raw").to_pylist()]
        h = np.concatenate(sets)
        u, inverse, n = np.unique(h >> np.uint64(1), return_inverse=True, return_counts=True)
        many = n > 1
        many[inverse[(h & np.uint64(1)) == 1]] = True
        flags, at = many[inverse], 0
        for task, s in zip(names, sets):
            yield blob(task, group.column("bucket")[0].as_py(), pack((s >> np.uint64(1))[flags[at : at + len(s)]]))
            at += len(s)

    def records(group: pa.Table):
        task = int(group.column("task")[0].as_py())
        wanted = np.sort(np.concatenate([unpack(r) for r in group.column("raw").to_pylist()]))
        meta, sizes, text = get(folder, f"collection-{task}")
        keys = pa.ipc.open_stream(meta.tobytes()).read_all().column("doc_id").combine_chunks().fill_null(LAST).to_numpy()
        a, low, high, h, whole, doc = found(text, sizes, length)
        value = short(h) >> np.uint64(1)
        hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value) if len(wanted) and len(value) else np.zeros(0, np.int64)
        a, low, high, whole, doc, value = (v[hit] for v in (a, low, high, whole, doc, value))
        key, where = keys[doc], (value % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((key, whole, where))  # equal pieces together, the least doc_id first
        a, low, high, whole, key, where = (v[order] for v in (a, low, high, whole, key, where))
        new = np.concatenate([[True], whole[1:] != whole[:-1]]) if len(a) else np.zeros(0, bool)
        slot, lead = np.cumsum(new) - 1, np.flatnonzero(new)
        put(folder, f"places-{task}", [a, low, high, slot.astype(np.int32), (key == key[lead][slot]) if len(a) else new], 1)
        padded = np.concatenate([np.zeros(pad, np.uint8), text, np.zeros(pad, np.uint8)])
        at = where[lead]
        for b in np.unique(at).tolist():
            k = lead[at == b]
            place = np.arange(2 * length - MARK)
            strings = padded[a[k][:, None] + place]
            strings[(place < pad - high[k].astype(int)[:, None]) | (place >= pad + length - low[k].astype(int)[:, None])] = 0
            yield blob(task, b, struct.pack("<q", len(k)) + squeeze(b"".join([key[k].tobytes(), low[k].tobytes(), high[k].tobytes(), strings.tobytes()])))

    def construct(group: pa.Table):
        names, raws, wide = group.column("task").to_pylist(), group.column("raw").to_pylist(), 2 * length - MARK
        sizes = [struct.unpack_from("<q", r)[0] for r in raws]
        at, total = np.concatenate([[0], np.cumsum(sizes)]), sum(sizes)
        columns, keys = np.empty((wide, total), np.uint8), np.empty(total, np.int64)
        low, high = np.empty(total, np.uint8), np.empty(total, np.uint8)
        for i, (raw, n) in enumerate(zip(raws, sizes)):
            flat, to = np.frombuffer(expand(raw[8:]), np.uint8), slice(at[i], at[i + 1])
            keys[to], low[to], high[to] = flat[: 8 * n].view(np.int64), flat[8 * n : 9 * n], flat[9 * n : 10 * n]
            columns[:, to] = flat[10 * n :].reshape(n, wide).T
        bucket = group.column("bucket")[0].as_py()
        fs, root = filesystem(folder)
        part = f"{root}/.{attempt()[1]}-transform-{bucket}"
        with fs.open_output_stream(part) as out:
            mask = build(columns, keys, low, high, length, Transform(out))
        fs.move(part, f"{root}/transform-{bucket}")
        cut = np.split(mask, np.cumsum(sizes)[:-1])
        for t, m in zip(names, cut):
            yield blob(t, bucket, squeeze(m.tobytes(), 1))

    def remove(group: pa.Table):
        task = int(group.column("task")[0].as_py())
        got = sorted((b, r) for b, r in zip(group.column("bucket").to_pylist(), group.column("raw").to_pylist()) if b >= 0)
        mask = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(expand(r), np.uint32) for _, r in got)])
        head, sizes, text = get(folder, f"collection-{task}")
        a, low, high, slot, same = get(folder, f"places-{task}")
        gone = np.zeros(len(text), bool)  # first the starts of repeated windows, then all that they cover
        if len(a):
            bits = np.where(same, mask[slot], np.uint32(0xFFFFFFFF))
            for o in range(pad + 1):
                gone[a[(bits >> np.uint32(o) & np.uint32(1) == 1) & (low <= o) & (o <= high)] - o] = True
        reach = 1
        while reach < length:
            step = min(reach, length - reach)
            gone[step:] |= gone[:-step].copy()
            reach += step
        meta = pa.ipc.open_stream(head.tobytes()).read_all()
        at, out = 0, {c: [] for c in ("n_removed", "n_spans", "kept_sha256", "kept", "span_starts", "span_ends")}
        for n in sizes.tolist():
            g = gone[at : at + n]
            kept = text[at : at + n][~g].tobytes()
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
            for c, v in zip(out, (n - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest(), kept if keep_text else None, edge[::2], edge[1::2])):
                out[c].append(v)
            at += n
        longs = pa.list_(pa.int64())
        types = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "span_starts": longs, "span_ends": longs}
        done = pa.table({"row": meta.column("row"), "doc_id": meta.column("doc_id"), "n_bytes": pa.array(sizes), **{c: pa.array(v, types[c]) for c, v in out.items()}})
        yield from done.to_batches(max_chunksize=4096)

    flags = scratch(together(rows.mapInArrow(collect, BLOB), "bucket", buckets, shared, BLOB), "shared-anchors")
    tasks = 1 + (flags.agg(F.max("task")).first()[0] or 0)
    masks = scratch(together(together(flags, "task", tasks, records, BLOB), "bucket", buckets, construct, BLOB), "masks")
    each = flags.select("task").distinct().select("task", F.lit(-1).alias("bucket"), F.lit(b"").alias("raw"))
    schema = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, span_starts array<long>, span_ends array<long>"
    return together(each.unionByName(masks), "task", tasks, remove, schema)


def removed(docs: DataFrame, **options) -> DataFrame:
    return repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with what is left of each text, in their own columns; n_chars, if there is one, is set anew.

    A character goes only if all its bytes do, so texts stay valid UTF-8. Texts that lose nothing stay as they are.
    """

    def rest(text: str | None, starts, ends) -> str | None:
        if text is None or starts is None:
            return text
        raw, out, at = text.encode(), [], 0
        for s, e in zip(starts, ends):
            while s < e and raw[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            out.append(raw[at:s])
            at = e
        return b"".join([*out, raw[at:]]).decode()

    @F.pandas_udf("string")
    def left(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([rest(*x) for x in zip(text, starts, ends)], dtype=object)

    held = scratch(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")), "dedup-docs")
    cut = repeats(held.select("doc.doc_id", "doc.text", "_row"), row="_row", **options).where("n_spans > 0").select(F.col("row").alias("_row"), "span_starts", "span_ends")
    both = held.join(cut, "_row", "left").withColumn("_text", left("doc.text", "span_starts", "span_ends"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return both.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])
