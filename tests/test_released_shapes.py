"""What released_with_geometry takes as the geometry before the changes."""

import pytest
from pyspark.sql import functions as F
from test_catalogue import DATA
from test_line_merge import by_hand

from terravet.operators import shapes
from terravet.plans import catalogue
from tests import domain as D

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


def test_changed_relations_stand_on_all_their_ways(spark, monkeypatch):
    """Before and after of a relation of which nothing changes would else differ."""
    monkeypatch.setattr(catalogue.target, "release_untargeted", lambda base, queue, base_geom, *rest: (None, base_geom.join(queue.select("objtype", "id"), ["objtype", "id"], "left_semi")))
    got = catalogue.QUERIES["released_with_geometry"](spark, str(DATA)).filter("objtype = 'r'")
    got = got.select("id", F.size("geom.parts").alias("lines"), F.size(catalogue.G.vertices(F.col("geom"))).alias("vertices")).collect()
    assert len(got) > 1 and {r["id"]: (r["lines"], r["vertices"]) for r in got} == {k: v for k, v in by_hand().items() if k % 50 == 0}


def test_the_geometry_before_is_that_of_changed_objects(spark, monkeypatch):
    """No object that nothing changes is given a shape, and those that are changed have the whole base's."""
    monkeypatch.setattr(catalogue.target, "release_untargeted", lambda base, queue, base_geom, *rest: (None, base_geom.join(queue.select("objtype", "id"), ["objtype", "id"], "left_anti")))
    assert catalogue.QUERIES["released_with_geometry"](spark, str(DATA)).count() == 0


def test_shapes_of_some_objects_are_those_of_the_whole_base(spark):
    n = D.nodes(spark, (1, None, 0, 0), (2, None, 1, 0), (3, None, 1, 1), (4, None, None, 2))
    w = D.ways(spark, (1, None, [1, 2]), (2, None, [2, 3, 1, 2]), (3, None, [4, 9]), (4, None, []), (5, None, None), (6, None, [3, None, 1]))
    r = D.relations(spark, (1, None, [(1, "", "w"), (2, "", "w"), (3, "", "n")]), (2, None, [(3, "", "w"), (6, "", "w")]), (3, None, None))
    whole = {(x["objtype"], x["id"]): x["geom"] for x in shapes.base_shapes(n, w, r).collect()}
    assert len(whole) == 13 and [whole["w", i] for i in (3, 4, 5)] == [None] * 3
    for own in ({("r", 1)}, {("r", 2), ("r", 3), ("w", 5), ("n", 4)}, {("w", 2), ("w", 4), ("n", 1), ("n", 77)}, set(whole)):
        changes = spark.createDataFrame(sorted(own), "objtype string, id long")
        assert {(x["objtype"], x["id"]): x["geom"] for x in shapes.base_shapes(n, w, r, changes).collect()} == {k: v for k, v in whole.items() if k in own}
