"""Schemas of the domain tables. Tags are maps, members arrays of structs; queries never infer a schema."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())
NODES = T.ArrayType(T.LongType())
MEMBER = T.StructType([T.StructField("ref", T.LongType()), T.StructField("role", T.StringType()), T.StructField("type", T.StringType())])
MEMBERS = T.ArrayType(MEMBER)
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: kind: point, line, polygon or collection; parts: vertex lists (a point has one of one vertex).
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(POINT)))])

_COMMON = [
    ("id", T.LongType()),
    ("version", T.IntegerType()),
    ("changeset_id", T.IntegerType()),
    ("created", T.TimestampNTZType()),
    ("uid", T.IntegerType()),
    ("username", T.StringType()),
    ("tags", TAGS),
]


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


NODE = _struct([*_COMMON, ("lon", T.DoubleType()), ("lat", T.DoubleType())])
WAY = _struct([*_COMMON, ("nodes", NODES)])
RELATION = _struct([*_COMMON, ("members", MEMBERS)])
#: Columns of the view over all three, with the type first.
BASE = _struct([("objtype", T.StringType()), *_COMMON, ("lon", T.DoubleType()), ("lat", T.DoubleType()), ("nodes", NODES), ("members", MEMBERS)])
#: A pending change: latest version for each (objtype, id), and what the stages work out about it.
CHANGE = _struct(
    [
        ("objtype", T.StringType()),
        ("id", T.LongType()),
        ("version", T.IntegerType()),
        ("deleted", T.BooleanType()),
        *_COMMON[2:],
        ("lon", T.DoubleType()),
        ("lat", T.DoubleType()),
        ("nodes", NODES),
        ("members", MEMBERS),
        ("targeted", T.BooleanType()),
        ("locha_id", T.LongType()),
        ("cc_id", T.LongType()),
    ]
)
CHANGESET = _struct(
    [
        ("id", T.LongType()),
        ("created_at", T.TimestampNTZType()),
        ("closed_at", T.TimestampNTZType()),
        ("open", T.BooleanType()),
        ("user", T.StringType()),
        ("uid", T.IntegerType()),
        ("min_lat", T.DoubleType()),
        ("min_lon", T.DoubleType()),
        ("max_lat", T.DoubleType()),
        ("max_lon", T.DoubleType()),
        ("comments_count", T.IntegerType()),
        ("changes_count", T.IntegerType()),
        ("tags", TAGS),
        ("updated_at", T.TimestampNTZType()),
    ]
)
ACTION = _struct([("validator_id", T.StringType()), ("action", T.StringType()), ("options", TAGS)])
#: One row for each link of a logical change.
LOG = _struct(
    [
        ("created", T.TimestampNTZType()),
        ("locha_id", T.LongType()),
        ("semantic_group", T.LongType()),
        ("before_object", _struct([("objtype", T.StringType()), ("id", T.LongType()), ("version", T.IntegerType()), ("deleted", T.BooleanType())])),
        ("after_object", _struct([("objtype", T.StringType()), ("id", T.LongType()), ("version", T.IntegerType()), ("deleted", T.BooleanType())])),
        ("matches", T.ArrayType(T.StringType())),
        ("action", T.StringType()),
        ("validator_uid", T.IntegerType()),
        ("diff_attribs", T.MapType(T.StringType(), T.ArrayType(ACTION))),
        ("diff_tags", T.MapType(T.StringType(), T.ArrayType(ACTION))),
        ("conflation", T.StringType()),
    ]
)
OBJECT_KEY = ["objtype", "id"]
VERSION_KEY = ["objtype", "id", "version", "deleted"]
