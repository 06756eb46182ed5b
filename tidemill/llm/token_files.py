"""Token-id files: fixed-size id blocks as byte or bit planes, each compressed with zstandard, and a chunk index.

A file is: the planes of its blocks; the index, five unsigned 32-bit numbers a block (ids, then bytes of each of four
planes); and 16 bytes: magic, number of blocks, ids in a full block, plane kind. Only the last block may hold fewer ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attempt, filesystem, partitions, scratch, scratch_path
from .tokens import chunks, default_path, encoder

MAGIC, TAIL = b"TMID", struct.Struct("<4sIII")
KINDS = ("byte", "bit")
INDEX = "doc_id long, part int, file string, first long, n_tokens long"


class Writer:
    """Ids go in as bytes of little-endian unsigned 32-bit numbers; at most one block is held."""

    def __init__(self, sink, block: int = 32_768, planes: str = "byte", level: int = 1) -> None:
        import zstandard

        self.sink, self.block, self.kind = sink, block, KINDS.index(planes)
        self.zip = zstandard.ZstdCompressor(level=level)
        self.wait, self.index, self.ids = bytearray(), [], 0

    def add(self, raw: bytes) -> None:
        self.wait += raw
        self.ids += len(raw) // 4
        full, at = 4 * self.block, 0
        while len(self.wait) - at >= full:
            self.put(bytes(self.wait[at : at + full]))
            at += full
        del self.wait[:at]

    def put(self, raw: bytes) -> None:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, 4).T
        if self.kind:
            planes = [np.packbits(np.unpackbits(p[:, None], axis=1).T, axis=1) for p in planes]
        packed = [self.zip.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
        for p in packed:
            self.sink.write(p)
        self.index.append((len(raw) // 4, *map(len, packed)))

    def close(self) -> None:
        if self.wait:
            self.put(bytes(self.wait))
        self.sink.write(np.array(self.index, "<u4").tobytes())
        self.sink.write(TAIL.pack(MAGIC, len(self.index), self.block, self.kind))
        self.sink.close()


class Reader:
    """Reads any run of ids by the index; keeps the block it read last."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.zip, self.held = source, zstandard.ZstdDecompressor(), (-1, b"")
        end = source.size()
        magic, blocks, self.block, self.kind = TAIL.unpack(self.at(end - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        index = np.frombuffer(self.at(end - TAIL.size - 20 * blocks, 20 * blocks), "<u4").reshape(-1, 5).astype(np.int64)
        self.counts, self.lengths = index[:, 0], index[:, 1:]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths.sum(axis=1))])
        self.ids = int(self.counts.sum())

    def at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def chunk(self, k: int) -> bytes:
        if self.held[0] != k:
            raw, planes, at = self.at(int(self.starts[k]), int(self.lengths[k].sum())), [], 0
            for n in self.lengths[k].tolist():
                plane = np.frombuffer(self.zip.decompress(raw[at : at + n]), np.uint8)
                if self.kind:
                    plane = np.packbits(np.unpackbits(plane.reshape(8, -1), axis=1)[:, : self.counts[k]].T, axis=1)[:, 0]
                planes.append(plane)
                at += n
            self.held = (k, np.stack(planes, axis=1).tobytes())
        return self.held[1]

    def runs(self, first: int, n: int) -> Iterator[bytes]:
        while n:
            k, at = divmod(first, self.block)
            got = self.chunk(k)[4 * at : 4 * (at + n)]
            yield got
            first, n = first + len(got) // 4, n - len(got) // 4

    def close(self) -> None:
        self.source.close()


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, block: int = 32_768, planes: str = "byte") -> DataFrame:
    """Writes all documents' ids, each with end_id after it, in ascending doc_id (nulls first, ties by text): a file a
    partition, file names ascending. Returns where each document's ids are: doc_id, part, file, first, n_tokens.

    A retried task writes a new file, and only the rows of the attempt that counts name it.
    """
    path, names = tokenizer or default_path(), [f.split()[0] for f in INDEX.split(", ")]

    def encode(batches):
        part, name = attempt()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        file, out = f"{root}/{name}.ids", None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in chunks(batch):
                if out is None:
                    out = Writer(fs.open_output_stream(file), block, planes)
                first, sizes = [], []
                for raw in encoder(path).encode(rows.column(1).to_pylist()):
                    first.append(out.ids)
                    out.add(raw + end)
                    sizes.append(out.ids - first[-1])
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * n, pa.int32()), pa.array([file] * n), pa.array(first, pa.int64()), pa.array(sizes, pa.int64())], names)
        if out:
            out.close()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return scratch(dealt.mapInArrow(encode, INDEX), "token-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files that the index names."""

    def back(batches):
        fs, _ = filesystem(folder)
        name, file = None, None
        for batch in batches:
            sums = []
            for path, first, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, Reader(fs.open_input_file(path))
                sums.append(0)
                for raw in file.runs(first, n):
                    sums[-1] = zlib.crc32(raw, sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "ids_crc32"])
        if file:
            file.close()

    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))  # a row a file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return index.mapInArrow(back, INDEX + ", ids_crc32 long").join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("first")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Null text: the end id alone. Null or repeated doc_id: written each, in the order above. No rows: no files."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read(write(docs, folder, **options), folder)
