"""Extracts in the PBF format, read and written by Spark: a file is split by its blobs, and written as one file for each partition.

    pbf.register(spark)
    objects = spark.read.format("osm_pbf").load("s3://bucket/extract.osm.pbf")
    objects.write.format("osm_pbf").mode("append").save("s3://bucket/out")

Packed numbers are decoded by numpy, a list at a time. Paths are opened by pyarrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = (
    "objtype string, id long, version int, changeset_id int, created timestamp_ntz, uid int, username string, tags map<string,string>, lon double, lat double, "
    "nodes array<long>, members array<struct<ref:long,role:string,type:string>>"
)
ARROW = pa.schema(
    [
        ("objtype", pa.string()), ("id", pa.int64()), ("version", pa.int32()), ("changeset_id", pa.int32()), ("created", pa.timestamp("us")), ("uid", pa.int32()), ("username", pa.string()),
        ("tags", pa.map_(pa.string(), pa.string())), ("lon", pa.float64()), ("lat", pa.float64()), ("nodes", pa.list_(pa.int64())),
        ("members", pa.list_(pa.struct([("ref", pa.int64()), ("role", pa.string()), ("type", pa.string())]))),
    ]
)
#: Bytes of blobs that one task reads, and objects that are written to one blob.
SPLIT, BLOCK = 32 << 20, 8000
TYPES = "nwr"

# --- fields of a message: number to a list of numbers or bytes


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        match key & 7:
            case 0:
                value, at = varint(data, at)
            case 2:
                n, at = varint(data, at)
                value, at = data[at : at + n], at + n
            case 1:
                value, at = data[at : at + 8], at + 8
            case 5:
                value, at = data[at : at + 4], at + 4
            case kind:
                raise ValueError(f"wire type {kind}")
        out.setdefault(key >> 3, []).append(value)
    return out


def numbers(parts: list | None, signed: bool = False, delta: bool = False) -> np.ndarray:
    """A packed list: zigzag if signed, summed up if delta."""
    data = np.frombuffer(b"".join(parts or []), np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    out, size = np.zeros(len(ends), np.uint64), ends - starts + 1
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        out[own] |= (data[starts[own] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    value = ((out >> np.uint64(1)).astype(np.int64) ^ -(out & np.uint64(1)).astype(np.int64)) if signed else out.astype(np.int64)
    return np.cumsum(value) if delta else value


def zigzag(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


# --- blocks to rows


def inflated(blob: bytes) -> bytes:
    f = fields(blob)
    if 1 in f:
        return f[1][0]
    if 3 in f:
        return zlib.decompress(f[3][0])
    raise ValueError("a blob that isn't raw or zlib")


def moment(ms: int | None) -> datetime | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class Block:
    """Rows of one primitive block."""

    def __init__(self, data: bytes):
        f = fields(data)
        one = lambda n, default: f.get(n, [default])[0]
        self.text = [x.decode() for x in fields(one(1, b"")).get(1, [])]
        self.grain, self.tick = one(17, 100), one(18, 1000)
        wide = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        self.south, self.west = wide(one(19, 0)), wide(one(20, 0))
        self.groups = [fields(g) for g in f.get(2, [])]

    def degrees(self, offset: int, x: int) -> float:
        return round((offset + self.grain * x) * 1e-9, 9)

    def head(self, info: bytes | None) -> dict:
        f = fields(info) if info else {}
        one = lambda n: f[n][0] if n in f else None
        stamp = one(2)
        return {"version": one(1), "created": moment(stamp * self.tick) if stamp is not None else None, "changeset_id": one(3), "uid": one(4), "username": self.text[one(5)] if 5 in f and one(5) < len(self.text) else None}

    def pairs(self, f: dict) -> list[tuple[str, str]]:
        return [(self.text[k], self.text[v]) for k, v in zip(numbers(f.get(2)).tolist(), numbers(f.get(3)).tolist())]

    def rows(self) -> Iterator[dict]:
        for g in self.groups:
            for message in g.get(1, []):
                f = fields(message)
                yield {"objtype": "n", "id": zigzag(f[1][0]), "lat": self.degrees(self.south, zigzag(f[8][0])), "lon": self.degrees(self.west, zigzag(f[9][0])), "tags": self.pairs(f), **self.head(f.get(4, [None])[0])}
            for message in g.get(2, []):
                yield from self.dense(fields(message))
            for message in g.get(3, []):
                f = fields(message)
                yield {"objtype": "w", "id": f[1][0], "tags": self.pairs(f), "nodes": numbers(f.get(8), True, True).tolist(), **self.head(f.get(4, [None])[0])}
            for message in g.get(4, []):
                f = fields(message)
                members = zip(numbers(f.get(9), True, True).tolist(), numbers(f.get(8)).tolist(), numbers(f.get(10)).tolist())
                yield {"objtype": "r", "id": f[1][0], "tags": self.pairs(f), "members": [{"ref": m, "role": self.text[r], "type": TYPES[t]} for m, r, t in members], **self.head(f.get(4, [None])[0])}

    def dense(self, f: dict) -> Iterator[dict]:
        ids, lat, lon = (numbers(f.get(n), True, True).tolist() for n in (1, 8, 9))
        info = fields(f[5][0]) if 5 in f else {}
        none = [None] * len(ids)
        column = lambda n, *how: numbers(info[n], *how).tolist() if n in info else none
        version, stamp, sets, uid, user = column(1), column(2, True, True), column(3, True, True), column(4, True, True), column(5, True, True)
        keys, at = numbers(f.get(10)).tolist(), 0
        for i, id_ in enumerate(ids):
            tags = []
            while at < len(keys) and keys[at]:
                tags.append((self.text[keys[at]], self.text[keys[at + 1]]))
                at += 2
            at += 1
            yield {
                "objtype": "n", "id": id_, "lat": self.degrees(self.south, lat[i]), "lon": self.degrees(self.west, lon[i]), "tags": tags, "version": version[i], "changeset_id": sets[i], "uid": uid[i],
                "created": None if stamp[i] is None else moment(stamp[i] * self.tick), "username": None if user[i] is None else self.text[user[i]],
            }


# --- rows to blocks


def coded(x: int) -> bytes:
    out, x = bytearray(), x & ((1 << 64) - 1)
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def signed(x: int) -> int:
    return (x << 1) ^ (x >> 63)


def number(n: int, x: int) -> bytes:
    return coded(n << 3) + coded(x)


def chunk(n: int, data: bytes) -> bytes:
    return coded(n << 3 | 2) + coded(len(data)) + data


def packed(n: int, xs: list[int]) -> bytes:
    return chunk(n, b"".join(map(coded, xs))) if xs else b""


def deltas(xs: list[int]) -> list[int]:
    return [signed(b - a) for a, b in zip([0, *xs[:-1]], xs)]


def framed(kind: str, data: bytes) -> bytes:
    blob = number(2, len(data)) + chunk(3, zlib.compress(data))
    head = chunk(1, kind.encode()) + number(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def header() -> bytes:
    return framed("OSMHeader", chunk(4, b"OsmSchema-V0.6") + chunk(4, b"DenseNodes"))


def block_of(rows: list[dict]) -> bytes:
    """One blob of rows of one type. Coordinates are kept to 1e-7 degrees, times to seconds."""
    text: dict[str, int] = {"": 0}
    at = lambda s: text.setdefault(s or "", len(text))
    stamp = lambda r: 0 if r["created"] is None else int(r["created"].replace(tzinfo=UTC).timestamp())
    tags = lambda r: sorted(dict(r["tags"] or ()).items())
    none = lambda x: x or 0
    if rows[0]["objtype"] == "n":
        keys = [x for r in rows for x in (*[y for k, v in tags(r) for y in (at(k), at(v))], 0)]
        info = packed(1, [none(r["version"]) for r in rows]) + packed(2, deltas([stamp(r) for r in rows])) + packed(3, deltas([none(r["changeset_id"]) for r in rows]))
        info += packed(4, deltas([none(r["uid"]) for r in rows])) + packed(5, deltas([at(r["username"]) for r in rows]))
        place = lambda n, c: packed(n, deltas([round((r[c] or 0.0) * 1e7) for r in rows]))
        group = chunk(2, packed(1, deltas([r["id"] for r in rows])) + chunk(5, info) + place(8, "lat") + place(9, "lon") + packed(10, keys))
    else:
        parts = []
        for r in rows:
            info = number(1, none(r["version"])) + number(2, stamp(r)) + number(3, none(r["changeset_id"])) + number(4, none(r["uid"])) + number(5, at(r["username"]))
            message = number(1, r["id"]) + packed(2, [at(k) for k, _ in tags(r)]) + packed(3, [at(v) for _, v in tags(r)]) + chunk(4, info)
            if r["objtype"] == "w":
                message += packed(8, deltas(list(r["nodes"] or ())))
            else:
                members = r["members"] or ()
                message += packed(8, [at(m["role"]) for m in members]) + packed(9, deltas([m["ref"] for m in members])) + packed(10, [TYPES.index(m["type"]) for m in members])
            parts.append(chunk(3 if r["objtype"] == "w" else 4, message))
        group = b"".join(parts)
    table = b"".join(chunk(1, s.encode()) for s in text)
    return framed("OSMData", chunk(1, table) + chunk(2, group))


# --- the data source


#: Schemes of Hadoop's file systems that go by another name here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "gcs": "gs"}


def uri_of(path: str) -> str:
    """The address here of a path as Spark takes it."""
    scheme, found, rest = path.partition("://")
    if not found:
        scheme, rest = "file", path
    elif scheme == "file" and not rest.startswith("/"):
        raise ValueError(f"{path}: no absolute path")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def opened(path: str) -> tuple[files.FileSystem, str]:
    """A file system and the path in it."""
    return files.FileSystem.from_uri(uri_of(path))


@dataclass
class Blobs(InputPartition):
    """Data blobs of a file: where each begins and how long it is."""

    path: str
    at: list[tuple[int, int]]


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """Kind, place and length of each blob; only the heads are read."""
    system, where = opened(path)
    with system.open_input_file(where) as f:
        at, end = 0, f.size()
        while at < end:
            (n,) = struct.unpack(">I", f.read_at(4, at))
            head = fields(f.read_at(n, at + 4))
            size = head[3][0]
            yield head[1][0].decode(), at + 4 + n, size
            at += 4 + n + size


def paths_of(path: str) -> list[str]:
    """The file, or the files of a folder in the order of their names."""
    system, where = opened(path)
    if system.get_file_info(where).type != files.FileType.Directory:
        return [path]
    found = system.get_file_info(files.FileSelector(where))
    return [f"{path.rstrip('/')}/{x.base_name}" for x in sorted(found, key=lambda x: x.base_name) if x.base_name.endswith(".osm.pbf")]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Blobs]:
        out = []
        for path in paths_of(self.path):
            held, size = [], 0
            for kind, at, n in blobs(path):
                if kind != "OSMData":
                    continue
                if held and size + n > SPLIT:
                    out.append(Blobs(path, held))
                    held, size = [], 0
                held.append((at, n))
                size += n
            if held:
                out.append(Blobs(path, held))
        return out or [Blobs(self.path, [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        system, where = opened(partition.path)
        if not partition.at:
            return
        with system.open_input_file(where) as f:
            for at, n in partition.at:
                rows = list(Block(inflated(f.read_at(n, at))).rows())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c.name) for r in rows], c.type) for c in ARROW], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceArrowWriter):
    """A file for each task under a name of its own; those of tasks that are committed get their last names."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, where = opened(self.path)
        system.create_dir(where, recursive=True)
        number_, stream, name = TaskContext.get().partitionId(), None, None
        for batch in iterator:
            rows = batch.to_pylist()
            cuts = [0, *[i for i in range(1, len(rows)) if rows[i]["objtype"] != rows[i - 1]["objtype"]], len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                for c in range(a, b, BLOCK):
                    if stream is None:
                        name = f"{self.run}-{number_:06}-{TaskContext.get().taskAttemptId()}"
                        stream = system.open_output_stream(f"{where}/_{name}")
                        stream.write(header())
                    stream.write(block_of(rows[c : min(b, c + BLOCK)]))
        if stream is not None:
            stream.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, where = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.move(f"{where}/_{m.name}", f"{where}/{'-'.join(m.name.split('-')[:2])}.osm.pbf")

    def abort(self, messages: list[Written | None]) -> None:
        system, where = opened(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{where}/_{m.name}")


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OsmPbf)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(objtype, id, ...) of every object of a file, or of the files of a folder."""
    register(spark)
    return spark.read.format("osm_pbf").load(path)


def replication(path: str) -> dict[str, object]:
    """The header's replication state: timestamp, sequence_number and base_url, where it has them."""
    system, where = opened(path)
    kind, at, n = next(blobs(path))
    if kind != "OSMHeader":
        raise ValueError("no header")
    with system.open_input_file(where) as f:
        head = fields(inflated(f.read_at(n, at)))
    found = {"timestamp": head.get(32), "sequence_number": head.get(33), "base_url": head.get(34)}
    return {k: v[0].decode() if isinstance(v[0], bytes) else datetime.fromtimestamp(v[0], UTC) if k == "timestamp" else v[0] for k, v in found.items() if v}


def write(objects: DataFrame, path: str) -> None:
    """All objects as files in the order of type and id, nodes first; each file is whole, and they follow on by their names."""
    register(objects.sparkSession)
    rank = "CASE objtype WHEN 'n' THEN 0 WHEN 'w' THEN 1 ELSE 2 END"
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    ranged = objects.selectExpr(*names, f"{rank} AS __r").repartitionByRange("__r", "id").sortWithinPartitions("__r", "id")
    ranged.select(*names).write.format("osm_pbf").mode("append").save(path)
