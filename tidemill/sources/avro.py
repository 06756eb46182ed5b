"""Avro object container files, written and read by the format's public specification; no jar is needed.

Times travel as microseconds: `timestamp` as timestamp-micros, `timestamp_ntz` as local-timestamp-micros in the session's
zone, which the library sets to UTC. Every field is a union with null.
"""

from __future__ import annotations

import decimal
import io
import json
import re
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
MAGIC = b"Obj\x01"
PLAIN = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string", "binary": "bytes"}
LOGICAL = {"date": ("int", "date"), "timestamp": ("long", "timestamp-micros"), "timestamp_ntz": ("long", "local-timestamp-micros")}
SYNC = 16
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
BLOCK = 64 << 10


def avro_type(t: T.DataType, name: str = "row", inner: bool = False):
    kind = t.simpleString()
    if kind in PLAIN:
        return PLAIN[kind]
    if kind in LOGICAL and not inner:
        return {"type": LOGICAL[kind][0], "logicalType": LOGICAL[kind][1]}
    if isinstance(t, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": t.precision, "scale": t.scale}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": ["null", avro_type(t.elementType, f"{name}_item", True)]}
    if isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
        return {"type": "map", "values": ["null", avro_type(t.valueType, f"{name}_value", True)]}
    if isinstance(t, T.StructType):
        if bad := [f.name for f in t if not NAME.match(f.name)]:
            raise ValueError(f"no Avro names: {bad}")
        deeper = inner or name != "row"
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_type(f.dataType, f"{name}_{f.name}", deeper)]} for f in t]}
    raise ValueError(f"no Avro form of {kind}{' inside another column' if inner else ''}")


def spark_type(a) -> T.DataType:
    if isinstance(a, list):
        return spark_type(next(x for x in a if x != "null"))
    if isinstance(a, str):
        return {"boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "bytes": T.BinaryType}[a]()
    if a.get("logicalType") == "decimal":
        return T.DecimalType(a["precision"], a["scale"])
    for (_, logical), kind in zip(LOGICAL.values(), (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if a.get("logicalType") == logical:
            return kind()
    if a["type"] == "array":
        return T.ArrayType(spark_type(a["items"]))
    if a["type"] == "map":
        return T.MapType(T.StringType(), spark_type(a["values"]))
    if a["type"] == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in a["fields"]])
    return spark_type(a["type"])


def long(n: int) -> bytes:
    """Zigzag, then seven bits a byte, lowest first."""
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_long(f) -> int:
    n = shift = 0
    while True:
        b = f.read(1)[0]
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return (n >> 1) ^ -(n & 1)


def sized(raw: bytes) -> bytes:
    return long(len(raw)) + raw


def put(a):
    """A function from a value to its bytes, for an Avro type."""
    if isinstance(a, list):
        inner = put(a[1])
        return lambda v: b"\x00" if v is None else b"\x02" + inner(v)
    kind = a if isinstance(a, str) else a["type"]
    if kind == "record":
        fields = [put(f["type"]) for f in a["fields"]]
        return lambda v: b"".join([p(x) for p, x in zip(fields, v)])
    if kind == "array":
        item = put(a["items"])
        return lambda v: (long(len(v)) + b"".join(map(item, v)) if len(v) else b"") + b"\x00"
    if kind == "map":
        value = put(a["values"])
        return lambda v: (long(len(v)) + b"".join(sized(k.encode()) + value(x) for k, x in v.items()) if v else b"") + b"\x00"
    if kind == "bytes" and not isinstance(a, str):

        def unscaled(v: decimal.Decimal) -> bytes:
            n = int(v.scaleb(a["scale"], decimal.Context(prec=60)))
            return sized(n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))

        return unscaled
    return {
        "boolean": lambda v: b"\x01" if v else b"\x00",
        "int": long,
        "long": long,
        "float": struct.Struct("<f").pack,
        "double": struct.Struct("<d").pack,
        "string": lambda v: sized(v.encode()),
        "bytes": lambda v: sized(bytes(v)),
    }[kind]


def get(a):
    """A function from a stream to the next value, for an Avro type."""
    if isinstance(a, list):
        inner = [get(x) if x != "null" else lambda f: None for x in a]
        return lambda f: inner[read_long(f)](f)
    kind = a if isinstance(a, str) else a["type"]
    if kind == "record":
        fields = [get(f["type"]) for f in a["fields"]]
        return lambda f: tuple([g(f) for g in fields])
    if kind in ("array", "map"):
        value = get(a["items" if kind == "array" else "values"])
        one = value if kind == "array" else lambda f: (f.read(read_long(f)).decode(), value(f))

        def several(f):
            out = []
            while n := read_long(f):
                if n < 0:  # a block that also gives its size
                    n, _ = -n, read_long(f)
                out += [one(f) for _ in range(n)]
            return out if kind == "array" else dict(out)

        return several
    if kind == "bytes" and not isinstance(a, str):
        return lambda f: decimal.Decimal(int.from_bytes(f.read(read_long(f)), "big", signed=True)).scaleb(-a["scale"], decimal.Context(prec=60))
    return {
        "boolean": lambda f: f.read(1) == b"\x01",
        "int": read_long,
        "long": read_long,
        "float": lambda f: struct.unpack("<f", f.read(4))[0],
        "double": lambda f: struct.unpack("<d", f.read(8))[0],
        "string": lambda f: f.read(read_long(f)).decode(),
        "bytes": lambda f: f.read(read_long(f)),
    }[kind]


def squeeze(raw: bytes, codec: str) -> bytes:
    if codec == "deflate":
        work = zlib.compressobj(wbits=-15)
        return work.compress(raw) + work.flush()
    return raw


def place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def header(f) -> tuple[dict, bytes]:
    """Metadata and sync mark of a file that stands at its start."""
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    return get({"type": "map", "values": "bytes"})(f), f.read(SYNC)


class Made(WriterCommitMessage):
    def __init__(self, file: str) -> None:
        self.file = file


class AvroWriter(DataSourceWriter):
    """A file a task, under a name of its own; only the files of tasks that count get their last names. Overwriting drops the
    old files first and isn't one step: a driver lost in between leaves some of the new ones."""

    def __init__(self, path: str, schema: dict, codec: str, overwrite: bool) -> None:
        self.path, self.schema, self.codec, self.overwrite = path, schema, codec, overwrite

    def write(self, rows) -> Made:
        fs, root = place(self.path)
        fs.create_dir(f"{root}/_held", recursive=True)
        name, encode, sync = uuid.uuid4().hex, put(self.schema), uuid.uuid4().bytes
        meta = {"avro.schema": json.dumps(self.schema).encode(), "avro.codec": self.codec.encode()}
        with fs.open_output_stream(f"{root}/_held/{name}") as f:
            f.write(MAGIC + put({"type": "map", "values": "bytes"})(meta) + sync)
            held, n, size = [], 0, 0

            def block() -> None:
                raw = squeeze(b"".join(held), self.codec)
                f.write(long(n) + sized(raw) + sync)

            for row in rows:
                held.append(encode(row))
                n, size = n + 1, size + len(held[-1])
                if size >= BLOCK:
                    block()
                    held, n, size = [], 0, 0
            if n:
                block()
        return Made(name)

    def commit(self, messages) -> None:
        fs, root = place(self.path)
        for old in files(self.path) if self.overwrite else []:
            fs.delete_file(old)
        for m in messages:
            if m:
                fs.move(f"{root}/_held/{m.file}", f"{root}/part-{m.file}.avro")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        fs, root = place(self.path)
        if fs.get_file_info(f"{root}/_held").type == FileType.Directory:
            fs.delete_dir(f"{root}/_held")


def files(path: str) -> list[str]:
    from pyarrow.fs import FileSelector

    fs, root = place(path)
    return sorted(x.path for x in fs.get_file_info(FileSelector(root, allow_not_found=True)) if x.base_name.endswith(".avro"))


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class AvroReader(DataSourceReader):
    """Files are read in ranges of `split` bytes; a range has the blocks whose preceding sync mark begins in it."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self):
        fs, _ = place(self.path)
        sizes = {x.path: x.size for x in fs.get_file_info(files(self.path))}
        return [Range(f, i, min(i + self.split, n)) for f, n in sizes.items() for i in range(0, n, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.file:
            return
        fs, _ = place(self.path)
        with fs.open_input_file(part.file) as f:
            meta, sync = header(f)
            codec = (meta.get("avro.codec") or b"null").decode()
            if codec not in ("null", "deflate"):
                raise ValueError(f"no codec {codec}")
            decode, total = get(json.loads(meta["avro.schema"])), f.size()
            first = f.tell() - SYNC
            at = first if part.start <= first else mark(f, sync, part.start, total)
            while at is not None and at < part.end and at + SYNC < total:
                f.seek(at + SYNC)
                n = read_long(f)
                raw = f.read(read_long(f))
                at = f.tell()
                data = io.BytesIO(zlib.decompress(raw, -15) if codec == "deflate" else raw)
                for _ in range(n):
                    yield decode(data)


def mark(f, sync: bytes, start: int, total: int, step: int = 1 << 20) -> int | None:
    """Where the next sync mark at or after start begins."""
    while start < total:
        f.seek(start)
        if (i := f.read(step + SYNC - 1).find(sync)) >= 0:
            return start + i
        start += step
    return None


class Avro(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_avro"

    def schema(self) -> T.StructType:
        found = files(self.options["path"])
        if not found:
            raise ValueError("no Avro files")
        fs, _ = place(self.options["path"])
        with fs.open_input_file(found[0]) as f:
            return raw_form(spark_type(json.loads(header(f)[0]["avro.schema"])))

    def reader(self, schema: T.StructType) -> AvroReader:
        return AvroReader(self.options["path"], int(self.options.get("split", 64 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> AvroWriter:
        return AvroWriter(self.options["path"], json.loads(self.options["row"]), self.options.get("codec", "deflate"), overwrite)


def raw_form(t: T.StructType) -> T.StructType:
    """Times as the numbers that a file holds."""
    kinds = {"date": T.IntegerType(), "timestamp": T.LongType(), "timestamp_ntz": T.LongType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.dataType.simpleString(), f.dataType)) for f in t])


def write(df: DataFrame, path: str, codec: str = "deflate", mode: str = "overwrite") -> None:
    """Files of at least one block a task. Columns without an Avro form, and names that Avro can't hold, raise."""
    row = avro_type(df.schema)
    if codec not in ("null", "deflate"):
        raise ValueError(f"no codec {codec}")
    to = {"date": lambda c: F.unix_date(c), "timestamp": lambda c: F.unix_micros(c), "timestamp_ntz": lambda c: F.unix_micros(c.cast("timestamp"))}
    numbers = df.select(*[to.get(f.dataType.simpleString(), lambda c: c)(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])
    df.sparkSession.dataSource.register(Avro)
    numbers.write.format("tidemill_avro").option("row", json.dumps(row)).option("codec", codec).mode(mode).save(path)


def read(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """Rows of the files of a folder, which have one schema."""
    spark.dataSource.register(Avro)
    found = files(path)
    if not found:
        raise ValueError("no Avro files")
    with place(path)[0].open_input_file(found[0]) as f:
        schema = spark_type(json.loads(header(f)[0]["avro.schema"]))
    back = {"date": lambda c: F.date_from_unix_date(c), "timestamp": lambda c: F.timestamp_micros(c), "timestamp_ntz": lambda c: F.timestamp_micros(c).cast("timestamp_ntz")}
    rows = spark.read.format("tidemill_avro").option("split", str(split)).load(path)
    return rows.select(*[back.get(f.dataType.simpleString(), lambda c: c)(F.col(f"`{f.name}`")).alias(f.name) for f in schema])
