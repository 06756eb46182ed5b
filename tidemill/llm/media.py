"""Media columns: payloads in tar shards by content address; rows carry digest, offset and length.

A payload is stored as a lossless 8-bit greyscale PNG, WIDTH samples a line. Header-only range reads fill the metadata
columns; whole reads give the samples back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt, filesystem, partitions, scratch, scratch_path, text_bytes

WIDTH = 192
#: Fixed values of the PNG format: signature, and the header's length up to the end of IHDR.
SIGNATURE, HEAD = b"\x89PNG\r\n\x1a\n", 33
STORED = "doc_id long, n_bytes long, media_sha256 binary, shard string, offset long, length long, place long, first boolean"
READ = "width long, height long, bit_depth int, payload_bytes long, payload_sha256 binary, tail_crc32 long, feature string"


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % WIDTH or WIDTH * (not raw))


def png(payload: bytes, level: int = 1) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()  # filter type 0
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEAD bytes."""
    if raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or zlib.crc32(raw[12:29]) != struct.unpack(">I", raw[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", raw[16:25])


def samples(raw: bytes) -> bytes:
    width, height, _ = header(raw[:HEAD])
    at, parts = HEAD, []
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IDAT":
            parts.append(raw[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Perceptual hash of the samples: mean, deviation, and 64 bits, a bit for each 64th part above their median mean."""
    x = np.frombuffer(payload, np.uint8)
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    edge = np.arange(65, dtype=np.int64) * len(x) // 64
    means = np.diff(total[edge]) / np.diff(edge)
    bits = np.packbits(means > np.median(means)).tobytes().hex()
    return f"{x.mean():.3f}:{x.std():.3f}:{bits}"


def store(docs: DataFrame, folder: str, shard_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Writes each partition's distinct payloads to its own tar shards, members named by digest; a row a document.

    A shard holds a payload once; copies in one partition share its offset and its place, a number of its own. A retried
    task writes new shards, and only rows of the attempt that counts name them.
    """
    names = [f.split()[0] for f in STORED.split(", ")]

    def write(batches):
        task, name = attempt()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, at, shard, number, held, place = None, 0, "", 0, {}, task << 40
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = hashlib.blake2b(raw, digest_size=16).digest()
                if new := source not in held:
                    if out is not None and at >= shard_bytes:
                        out.write(b"\0" * 1024)
                        out.close()
                        out, at, number, held = None, 0, number + 1, {}
                    if out is None:
                        shard = f"{root}/{name}-{number:04d}.tar"
                        out = fs.open_output_stream(shard)
                    media = png(padded(raw), level)
                    digest = hashlib.sha256(media)
                    member = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                    member.size = len(media)
                    head = member.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + media + b"\0" * (-len(media) % 512))
                    held[source] = (digest.digest(), shard, at + len(head), len(media), place)
                    place += 1
                    at += len(head) + len(media) + -len(media) % 512
                rows.append((doc, len(raw), *held[source], new))
            if rows:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return scratch(docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(write, STORED), "media-index")


def describe(index: DataFrame, folder: str, whole: bool = True) -> DataFrame:
    """Adds metadata columns to rows with shard, offset and length, by a range read of each header; with `whole`, also what
    the samples themselves give."""
    added = [f.split()[0] for f in READ.split(", ")]

    def read(batches):
        fs, _ = filesystem(folder)
        open_, file = None, None
        last: OrderedDict = OrderedDict()  # copies lie side by side; few payloads need keeping
        for batch in batches:
            rows = []
            for shard, at, n in zip(*(batch.column(k).to_pylist() for k in ("shard", "offset", "length"))):
                if shard != open_:
                    if file:
                        file.close()
                    open_, file = shard, fs.open_input_file(shard)
                    last.clear()
                if at not in last:
                    file.seek(at)
                    shape = header(file.read(HEAD))
                    got = (None,) * 4
                    if whole:
                        file.seek(at)
                        payload = samples(file.read(n))
                        got = (len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), feature(payload))
                    last[at] = (*shape, *got)
                    if len(last) > 64:
                        last.popitem(last=False)
                rows.append(last[at])
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(zip(*rows), types))], [*batch.schema.names, *added])

    near = index.repartition(partitions(index.sparkSession), "shard", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("shard", "offset")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return near.mapInArrow(read, f"{fields}, {READ}")


def addresses(index: DataFrame) -> DataFrame:
    """media_sha256, shard, offset, length, places: one address a payload, the first of those that tasks have stored, and
    the places that rows name it by, at most one a shard."""
    stored = index.where("first").groupBy("media_sha256").agg(F.min(F.struct("place", "shard", "offset", "length")).alias("at"), F.collect_list("place").alias("places"))
    return stored.select("media_sha256", "at.shard", "at.offset", "at.length", "places")


def columns(docs: DataFrame) -> DataFrame:
    """Null or empty text: one line of spaces. Equal texts: equal values. Null and repeated doc_ids: a row each.

    Rows refer to one address for each payload, which is read once; copies in other tasks' shards are referred to by none.
    A payload's columns reach its rows by place, so that a text with many copies is spread as its rows were.
    """
    folder = scratch_path(docs.sparkSession, "media")
    index = store(docs, folder)
    known = describe(addresses(index), folder).withColumn("place", F.explode("places"))
    digest = lambda c: F.lower(F.hex(c)).alias(c)
    return index.select("doc_id", "n_bytes", "place").join(known, "place").select(
        "doc_id", "n_bytes", "payload_bytes", digest("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), digest("media_sha256"), "feature", "width", "height", "bit_depth", "offset"
    )
