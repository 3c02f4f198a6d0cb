"""Lines of ways go straight to Python functions; repeats of vertices leave by the same rule as one by one."""

from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions import polygons
from terravet.operators import shapes
from tests import domain as D


def test_lines_of_ways_reach_python(spark):
    n = D.nodes(spark, (1, None, 0, 0), (2, None, 30, 0), (3, None, 30, 20))
    w = D.ways(spark, (7, None, [1, 2, 2, 3]), (8, None, [1]), (9, None, [5]), (10, None, []))
    lines = shapes.way_shapes(w, n)
    cut = lines.select("id", polygons.split_by_grid(F.col("geom"), 25.0).alias("p"))
    assert {r["id"]: None if r["p"] is None else [(p["cx"], p["cy"]) for p in r["p"]] for r in cut.collect()} == {7: [(0, 0), (1, 0)], 8: [(0, 0)], 9: None, 10: None}
    pieces = lines.select("id", F.explode_outer(polygons.split_by_grid(F.col("geom"), 25.0)).alias("p")).select("id", "p.geom.parts")
    assert sorted(r["id"] for r in pieces.collect()) == [7, 7, 8, 9, 10]
    assert {r["id"]: r["ok"] for r in lines.select("id", G.is_valid("geom").alias("ok")).collect()} == {7: True, 8: True, 9: False, 10: False}


def test_repeats_leave_one_by_one(spark):
    lists = [None, [], [None], [None, None, (1.0, 1.0)], [(1.0, 1.0)] * 3, [(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (-0.0, 1.0), (None, 1.0), (None, 1.0), None, (0.0, 1.0)], [(float("nan"), 0.0)] * 2]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, v array<struct<x:double,y:double>>")
    got = {r["id"]: r["c"] for r in df.select("id", G.no_repeats(F.col("v")).alias("c")).collect()}
    for i, v in enumerate(lists):
        same = lambda p, q: (p is None) == (q is None) and (p is None or str(p).replace("-0.0", "0.0") == str(q).replace("-0.0", "0.0"))
        want = None if v is None else [p for k, p in enumerate(v) if k == 0 or not same(p, v[k - 1])]
        assert str(None if v is None else [None if p is None else tuple(p) for p in got[i]]) == str(want)
