from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.operators import shapes
from tests import domain as D


def geoms(df):
    return {(r["objtype"], r["id"]) if "objtype" in r else r["id"]: D.text(r["geom"]) for r in df.collect()}


def test_way_lines(spark):
    w = D.ways(spark, (3, None, [1, 2]))
    assert geoms(shapes.way_shapes(w, D.nodes(spark, (1, None, 1, 1), (2, None, 2, 2)))) == {3: "LINESTRING(1 1,2 2)"}
    moved = D.nodes(spark, (1, None, 3, 3), (2, None, 2, 2))
    assert geoms(shapes.way_shapes(w, moved)) == {3: "LINESTRING(3 3,2 2)"}
    assert geoms(shapes.way_shapes(D.ways(spark, (3, None, [1, 1])), moved)) == {3: "POINT(3 3)"}
    assert geoms(shapes.way_shapes(D.ways(spark, (3, None, [8, 9])), moved)) == {3: None}


def test_overlay(spark):
    n, w = D.nodes(spark, (1, None, 1, 1), (2, None, 2, 2)), D.ways(spark, (3, None, [1, 2]))
    r = D.relations(spark)
    one = shapes.change_shapes(n, w, r, D.changes(spark, ("n", 1, 2, False, None, 3, 3, None)))
    assert geoms(one) == {("n", 1): "POINT(3 3)"}
    two = shapes.change_shapes(n, w, r, D.changes(spark, ("w", 3, 2, False, None, None, None, [1, 1])))
    assert geoms(two) == {("w", 3): "POINT(1 1)"}
    gone = shapes.change_shapes(n, w, r, D.changes(spark, ("w", 3, 2, True, None, None, None, [1, 2])))
    assert geoms(gone) == {("w", 3): None}


def test_relation_shape_is_the_same_before_and_after(spark):
    n = D.nodes(spark, (1, None, 0, 0), (2, None, 1, 0), (3, None, 1, 1), (4, None, 0, 1))
    w = D.ways(spark, (10, None, [1, 2, 3]), (11, None, [3, 4, 1]))
    members = [(10, "outer", "w"), (11, "outer", "w"), (4, "", "n")]
    r = D.relations(spark, (5, {"t": "x"}, members))
    before = shapes.base_shapes(n, w, r).filter("objtype = 'r'").select("id", F.col("geom").alias("b"))
    after = shapes.change_shapes(n, w, r, D.changes(spark, ("r", 5, 2, False, {"t": "y"}, None, None, None, members))).select("id", "geom")
    assert before.join(after, "id").select(G.same(F.col("b"), F.col("geom"))).first()[0] is True
    area = shapes.areas(r, shapes.way_shapes(w, n)).first()
    assert area["geom"]["kind"] == "polygon" and len(area["geom"]["parts"]) == 1


def test_same_geometry_whatever_the_direction(spark):
    line = lambda *p: ("line", [[{"x": float(x), "y": float(y)} for x, y in p]])
    pairs = [
        (line((0, 0), (1, 1), (2, 0)), line((2, 0), (1, 1), (0, 0)), True),
        (line((0, 0), (1, 0), (1, 1), (0, 0)), line((1, 1), (0, 0), (1, 0), (1, 1)), True),
        (line((0, 0), (1, 1)), line((0, 0), (1, 2)), False),
        (None, None, True),
        (None, line((0, 0), (1, 1)), False),
    ]
    g = "struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame([(a, b, e) for a, b, e in pairs], f"a {g}, b {g}, e boolean")
    assert all(r[0] == r[1] for r in df.select(G.same(F.col("a"), F.col("b")), "e").collect())


def test_plain_geometry():
    assert G.merge_lines([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(5, 5), (6, 6)]]) in ([[(0, 0), (1, 0), (2, 0)], [(5, 5), (6, 6)]], [[(2, 0), (1, 0), (0, 0)], [(5, 5), (6, 6)]])
    assert G.simple_ring([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])
    assert not G.simple_ring([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)])
    a, b = [G.np.array([(0.0, 0.0), (4.0, 0.0)])], [G.np.array([(2.0, 3.0)])]
    assert G.distance(a, b) == 3.0
    assert G.distance(a, [G.np.array([(1.0, -1.0), (1.0, 1.0)])]) == 0.0


def test_dirty_reaches_relations_through_ways(spark):
    w = D.ways(spark, (10, None, [1, 2]))
    r = D.relations(spark, (5, None, [(10, "", "w")]), (6, None, [(11, "", "w")]))
    one = spark.createDataFrame([(1,)], "id long")
    none = one.limit(0)
    assert D.ids(shapes.dirty(w, r, one, none, none), "objtype", "id") == [("r", 5), ("w", 10)]


def test_utm_of_a_known_place(spark):
    p = F.struct(F.lit(3.0).alias("x"), F.lit(45.0).alias("y"))
    got = spark.range(1).select(G.Projection(32631).vertex(p).alias("p")).first()["p"]
    assert abs(got["x"] - 500_000) < 1e-3 and abs(got["y"] - 4_982_950.4) < 0.1
