"""Parts and numbers of logical changes where keys are null or tiles many."""

from collections import defaultdict

from pyspark.sql import functions as F

from terravet.operators import locha


def test_null_keys_are_numbered_last(spark):
    rows = [(1, "a"), (1, None), (None, "a"), (2, "b"), (None, None), (1, "a"), (None, None)]
    df = spark.createDataFrame(rows, "k int, l string")
    got = sorted(((r["k"], r["l"], r["number"]) for r in locha.renumbered(df, "k", "l").collect()), key=str)
    order = sorted(set(rows), key=lambda r: [(x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r])
    number = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: ((r[0] is None, r[0] or 0), (r[1] is None, r[1] or ""))), 1)}
    assert len(order) == 5 and got == sorted(((*r, number[r]) for r in rows), key=str)


def test_parts_of_a_cut_cluster_keep_their_tile(spark):
    points = spark.range(3000).select("id", F.lit(7).cast("long").alias("cluster"), (F.col("id") % 60 * 1.0).alias("x"), F.floor(F.col("id") / 60).cast("double").alias("y"))
    parts = defaultdict(list)
    for r in locha.split_large(points, 1.0, most=20, at_once=300).collect():
        parts[r["cluster"], r["part"]].append(r["id"])
    tile = {r["id"]: r["tile"] for r in locha.cut(points, 1.0, 300).collect()}
    assert sum(map(len, parts.values())) == 3000 and len({p >> 31 for _, p in parts}) == len(set(tile.values())) > 5
    assert all(len(ids) <= 20 * 2 and len({tile[i] for i in ids}) == 1 for ids in parts.values())
