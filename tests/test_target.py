import pytest

from terravet.functions import geometry as G
from terravet.functions.tags import Rule, Rules
from terravet.operators import graph, shapes, target
from terravet.plans.tables import Steps
from terravet.schemas import OBJECT_KEY
from tests import domain as D

A = {"a": "a"}


def released(spark, rules, n, w, queue, distance=1.0, r=None):
    r = r if r is not None else D.relations(spark)
    base = D.base(spark, n, w, r)
    _, out = target.release_untargeted(base, queue, shapes.base_shapes(n, w, r), shapes.change_shapes(n, w, r, queue), rules, Steps(spark, "t"), distance=distance)
    return D.ids(out, "objtype", "id")


def rule(*text):
    return Rules(tuple(Rule.of(t) for t in text))


def test_moved_node_without_interest_is_released(spark):
    n = D.nodes(spark, (1, A, 1, 1))
    assert released(spark, rule("[nothing]"), n, D.ways(spark), D.changes(spark, ("n", 1, 2, False, A, 3, 3, None))) == [("n", 1)]


@pytest.mark.parametrize(("text", "expected"), [("[a]", []), ("[b]", []), ("[z]", [("n", 1)])])
def test_tags_that_switch(spark, text, expected):
    n = D.nodes(spark, (1, A, 1, 1))
    assert released(spark, rule(text), n, D.ways(spark), D.changes(spark, ("n", 1, 2, False, {"b": "b"}, 1, 1, None))) == expected


@pytest.fixture
def transitive(spark):
    n = D.nodes(spark, (1, A, 1, 1), (2, {"b": "b"}, 2, 2), (9, {"z": "z"}, 90, 80))
    return n, D.ways(spark, (100, {"w": "w"}, [1, 2]))


def test_a_far_change_is_released(spark, transitive):
    queue = D.changes(spark, ("n", 1, 2, False, A, 1, 3, None), ("n", 9, 2, False, {"z": "z"}, 91, 81, None))
    assert released(spark, rule("[a]"), *transitive, queue) == [("n", 9)]


def test_a_way_through_a_targeted_node_is_held(spark, transitive):
    queue = D.changes(spark, ("n", 1, 2, False, A, 1, 3, None), ("w", 100, 2, False, {"w": "w"}, None, None, [1, 2]), ("n", 9, 2, False, {"z": "z"}, 91, 81, None))
    assert released(spark, rule("[a]"), *transitive, queue) == [("n", 9)]


def test_a_way_that_drops_a_deleted_node_holds_it(spark, transitive):
    queue = D.changes(spark, ("w", 100, 2, False, {"w": "w"}, None, None, [1, 9]), ("n", 2, 2, True, None, None, None, None), ("n", 9, 2, False, {"z": "z"}, 91, 81, None))
    assert released(spark, rule("[w]"), *transitive, queue) == []


def test_a_near_component_is_held(spark):
    n = D.nodes(spark, (1, A, 0, 0), (2, {"b": "b"}, 10, 0), (3, {"b": "b"}, 0.5, 0))
    queue = D.changes(spark, ("n", 1, 2, False, {"a": "x"}, 0, 0, None), ("n", 2, 2, False, {"b": "x"}, 10, 0, None), ("n", 3, 2, False, {"b": "x"}, 0.5, 0, None))
    assert released(spark, rule("[a]"), n, D.ways(spark), queue) == [("n", 2)]


def test_polygon_area(spark):
    inside = target.inside_polygons([[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]])
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (None, None)], "lon double, lat double").withColumn("geom", G.point(G.F.col("lon"), G.F.col("lat")))
    assert [r[0] for r in df.select(inside(G.F.col("geom"))).collect()] == [True, False, True]


def test_components_of_a_long_chain_in_any_order(spark):
    n = 300
    order = [(i * 7919) % n for i in range(n)]
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (2000, 2000)], "a long, b long")
    got = dict(D.ids(graph.components(links, Steps(spark, "chain")), "v", "component"))
    assert len(got) == n + 3 and all(got[v] == 0 for v in range(n)) and got[1001] == 1000 and got[2000] == 2000


def test_ways_meet_through_an_active_one_alone(spark):
    rows = [("w", 1, [5], True), ("w", 2, [5, 6], False), ("w", 3, [6], False)]
    df = spark.createDataFrame([(t, i, n, [], a, True, True) for t, i, n, a in rows], "objtype string, id long, nodes array<long>, members array<struct<ref:long,role:string,type:string>>, active boolean, eligible boolean, geom_changed boolean")
    got = {i: c for _, i, c in D.ids(graph.change_components(df, Steps(spark, "ways")), *OBJECT_KEY, "cc_id")}
    assert got[1] == got[2] != got[3]
