"""Applying and comparing go over each table once, and a bucket is written by more than one task."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.operators import apply
from terravet.plans.keyed import KeyedTable
from tests import domain as D


def test_difference_counts_rows_and_reads_each_table_once(spark, tmp_path):
    kind = "objtype string, id long, version int"
    saved = lambda name, *rows: (spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}"), spark.read.schema(kind).parquet(f"{tmp_path}/{name}"))[1]
    a = saved("a", ("n", 1, 1), ("n", 1, 1), ("n", 1, 1), ("n", 2, 1), ("w", 3, None), (None, 4, 1))
    b = saved("b", ("n", 1, 1), ("n", 2, 2), ("w", 3, None), ("w", 5, 1), ("w", 5, 1))
    found = apply.difference(a, b)
    want = a.exceptAll(b).withColumn("side", F.lit("expected")).union(b.exceptAll(a).withColumn("side", F.lit("found")))
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() == 7
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert apply.difference(a, a).count() == 0


def test_applied_is_upserted_without_deleted(spark):
    base = D.base(spark, D.nodes(spark, *[(i, {"a": str(i)}, i, i) for i in range(1, 8)]), D.ways(spark, (1, None, [1, 2]), (2, None, [3])))
    rows = [("n", 1, 2, False, {"b": "x"}, 9, 9, None), ("n", 2, 2, True, None, 1, 1, None), ("n", 9, 1, False, None, 1, 1, None), ("n", 10, 1, True, None, 1, 1, None), ("n", 3, 2, None, None, 1, 1, None), ("w", 1, 2, True, None, None, None, None), ("w", 2, 2, False, None, None, None, [4, 5])]
    accepted = D.changes(spark, *rows)
    got, want = apply.applied(base, accepted), apply.without_deleted(apply.upserted(base, accepted), accepted)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert D.ids(got, "objtype", "id") == [("n", i) for i in (1, 3, 4, 5, 6, 7, 9)] + [("w", 2)]


def test_one_bucket_is_written_by_more_than_one_task(spark, tmp_path):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    t = KeyedTable(spark, f"file://{tmp_path}/t", kind, 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put into one task
    try:
        t.replace(spark.range(1024).select("id", F.lit("x").alias("v")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    g = t.manifest().generations[0]
    files = [n for n in t._names(t._at(f"{g['name']}/bucket=0")) if n.endswith(".parquet")]
    assert g["buckets"] == [0] and g["counts"] == [1024] and len(files) > 1
    spans = sorted((r["a"], r["b"]) for n in files for r in spark.read.parquet(f"{t.path}/{g['name']}/bucket=0/{n}").groupBy(F.shiftright("id", 7)).agg(F.min("id").alias("a"), F.max("id").alias("b")).collect())
    assert spans == [(128 * i, 128 * i + 127) for i in range(8)] and t.read().count() == 1024
