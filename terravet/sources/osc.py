"""Change files: XML to rows, and the state files that number them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.operators.ingest import simplify
from terravet.plans.tables import Steps
from terravet.sources.warehouse import typed_change

_TAG = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
_HEAD = [(n, t) for n, t in (("_id", T.LongType()), ("_version", T.IntegerType()), ("_timestamp", T.StringType()), ("_changeset", T.IntegerType()), ("_uid", T.IntegerType()), ("_user", T.StringType()))]
_NODE = T.StructType([T.StructField(n, t) for n, t in [*_HEAD, ("_lat", T.DoubleType()), ("_lon", T.DoubleType()), ("tag", _TAG)]])
_WAY = T.StructType([T.StructField(n, t) for n, t in [*_HEAD, ("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))), ("tag", _TAG)]])
_MEMBER = T.StructType([T.StructField("_type", T.StringType()), T.StructField("_ref", T.LongType()), T.StructField("_role", T.StringType())])
_RELATION = T.StructType([T.StructField(n, t) for n, t in [*_HEAD, ("member", T.ArrayType(_MEMBER)), ("tag", _TAG)]])
#: A block of a change file; given, since a block with one child would be inferred as a struct.
BLOCK = T.StructType([T.StructField("node", T.ArrayType(_NODE)), T.StructField("way", T.ArrayType(_WAY)), T.StructField("relation", T.ArrayType(_RELATION))])


def read_osc(spark: SparkSession, path: str | list[str], name: str | None = None) -> DataFrame:
    """Rows of changes from change files, gzipped or not, in no order; repeated objects stay repeated.

    name: of a column with the file that a row came from. Each file is parsed once for each action. A gzipped file can't be split: it is one task, so give many files of bounded size.
    """
    parts, steps = [], Steps(spark, "osc")
    for action in ("create", "modify", "delete"):
        blocks = spark.read.format("xml").option("rowTag", action).schema(BLOCK).load(path)
        if name:
            blocks = blocks.withColumn(name, F.input_file_name())
        blocks = steps.keep(blocks)
        for tag, t in (("node", "n"), ("way", "w"), ("relation", "r")):
            o = blocks.select(F.explode(tag).alias("o"), *([name] if name else []))
            tags = F.map_from_entries(F.transform("o.tag", lambda x: F.struct(x["_k"].alias("key"), x["_v"].alias("value"))))
            cols = {
                "objtype": F.lit(t), "id": F.col("o._id"), "version": F.col("o._version"), "deleted": F.lit(action == "delete"), "changeset_id": F.col("o._changeset"),
                "created": F.to_timestamp(F.col("o._timestamp")).cast("timestamp_ntz"), "uid": F.col("o._uid"), "username": F.col("o._user"), "tags": tags,
            }
            if t == "n":
                cols |= {"lon": F.col("o._lon"), "lat": F.col("o._lat")}
            if t == "w":
                cols |= {"nodes": F.transform("o.nd", lambda x: x["_ref"])}
            if t == "r":
                cols |= {"members": F.transform("o.member", lambda m: F.struct(m["_ref"].alias("ref"), m["_role"].alias("role"), F.substring(m["_type"], 1, 1).alias("type")))}
            more = [name] if name else []
            parts.append(typed_change(o.select(*[c.alias(k) for k, c in cols.items()], *more), *more))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_diffs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The last state of each object in several change files, later files after earlier ones of the same version."""
    names = {path.rstrip("/").rpartition("/")[2]: n for n, path in enumerate(paths)}
    rows = read_osc(spark, paths, name="__file")
    short = F.substring_index("__file", "/", -1)
    if len(names) < len(paths):  # files of one name in several folders are told apart by all of it
        names, short = {spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath(): n for n, p in enumerate(paths)}, F.regexp_replace("__file", "^[a-zA-Z0-9]+:(//[^/]*)?", "")
    place = spark.createDataFrame(list(names.items()), "__of string, __n int")
    rows = rows.join(F.broadcast(place), short == F.col("__of"))  # a row for each file
    return simplify(rows.drop("__of", "__file"), F.col("__n"), F.col("deleted")).drop("__n")


@dataclass(frozen=True)
class State:
    """A sequence number and when it was reached."""

    sequence: int
    timestamp: datetime

    @staticmethod
    def parse(text: str) -> State:
        found = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
        return State(int(found["sequenceNumber"]), datetime.strptime(found["timestamp"].replace("\\:", ":"), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC))

    def text(self) -> str:
        at = self.timestamp.strftime("%Y-%m-%dT%H:%M:%SZ").replace(":", "\\:")
        return f"sequenceNumber={self.sequence}\ntimestamp={at}\n"

    def next(self, now: datetime) -> State:
        return State(self.sequence + 1, now)

    @property
    def path(self) -> str:
        n = f"{self.sequence:09d}"
        return f"{n[:3]}/{n[3:6]}/{n[6:]}"


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file through Hadoop's file systems; None if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()) if fs.exists(p) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.close()
