"""Near shapes by cells of segments, polygons that hold or touch others, clusters cut by grids, numbers in ranges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.operators import locha, nearby
from terravet.plans.tables import Steps

SHAPE = "id long, geom struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"


def shape(kind, *parts):
    return {"kind": kind, "parts": [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts]}


def shapes(rng, n, wide):
    out = []
    for i in range(n):
        x, y, step = rng.uniform(-wide, wide), rng.uniform(-wide, wide), rng.choice([0.1, 1, 10, wide])
        out.append((i, shape("line", [(x + rng.uniform(-step, step), y + rng.uniform(-step, step)) for _ in range(rng.randint(1, 5))])))
    return out


@pytest.mark.parametrize("reach", [0.5, 20.0])
def test_near_shapes_against_all_pairs(spark, reach):
    rng = random.Random(4)
    a, b = shapes(rng, 60, 500), [*shapes(rng, 60, 500), (99, shape("line", [(-1e7, -1e7), (1e7, 1e7)]))]
    steps = Steps(spark, "near")
    near = lambda x, y: G.distance(G.parts_of(x), G.parts_of(y)) <= reach
    got = nearby.near(spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE), [], reach, steps).collect()
    expected = sorted((i, j) for i, x in a for j, y in b if near(x, y))
    assert sorted(tuple(r) for r in got) == expected and expected
    one = spark.createDataFrame(b, SHAPE)
    got = nearby.near(one, one, [], reach, steps, ordered=True).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, j) for i, x in b for j, y in b if i < j and near(x, y))


def test_a_world_wide_shape_gives_few_cells(spark):
    df = spark.createDataFrame([(1, shape("line", [(-2e7, -1e7), (2e7, 1e7)])), (2, shape("point", [(0, 0)]))], SHAPE)
    boxes = nearby.boxes(df, ["id"], 400.0, 100.0)
    assert nearby.tiles(boxes, ["id"], 400.0, 100.0, F.array("__level")).groupBy("id").count().agg(F.max("count")).first()[0] <= 4


def test_polygons_that_hold_or_touch(spark):
    area = G.box_polygon(0, 0, 10, 10)
    rows = [
        (shape("polygon", [(-5, -5), (20, -5), (20, 20), (-5, 20), (-5, -5)]), True), (shape("line", [(-5, -5), (20, -5), (20, 20), (-5, 20), (-5, -5)]), False),
        (shape("line", [(-5, 15), (15, -5)]), True), (shape("line", [(10, 20), (20, 10)]), False), (shape("line", [(5, 20), (20, 0)]), False), (shape("line", [(-10, 10), (20, 10)]), True),
        (shape("line", [(0, 20), (20, 0)]), True), (shape("point", [(3, 3)]), True), (shape("point", [(10, 5)]), True), (shape("point", [(11, 5)]), False),
    ]
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(rows)], SHAPE)
    got = {r["id"]: r["m"] for r in df.select("id", G.intersects_polygons(area)(F.col("geom")).alias("m")).collect()}
    assert got == {i: m for i, (_, m) in enumerate(rows)}


def test_distances_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = [np.cumsum(rng.normal(size=(300, 2)), axis=0)], [np.cumsum(rng.normal(size=(200, 2)), axis=0) + 80]
    whole = G.distance(a, b)
    monkeypatch.setattr(G, "PAIRS", 1000)
    assert math.isclose(G.distance(a, b), whole)
    ring = [np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float), np.array([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], float)]
    assert G._in_rings(np.array([(2, 2), (0.5, 0.5), (4, 2), (1, 2), (5, 5)], float), ring).tolist() == [False, True, True, True, False]


def test_large_clusters_are_cut_first(spark):
    rng = random.Random(1)
    rows = [(i, 7, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(700)] + [(1000 + i, 7, 5.0, 5.0) for i in range(300)] + [(5000 + i, 8, 1.0, 1.0 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, cluster long, x double, y double")
    tiles = locha.cut(df, 10.0, 100)
    sizes = {(r["cluster"], r["tile"]): r["count"] for r in tiles.groupBy("cluster", "tile").count().collect()}
    assert sum(sizes.values()) == len(rows) and all(n <= 130 for n in sizes.values()) and sizes[8, None] == 20
    got = locha.split_large(df, 10.0, most=99, at_once=100).collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    parts = {}
    for r in got:
        parts.setdefault((r["cluster"], r["part"]), []).append(r["id"])
    # Points in one place can't be told apart by k-means: they stay as they were dealt.
    assert max(len(p) for p in parts.values() if not all(1000 <= i < 5000 for i in p)) <= 99


def test_numbers_in_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 500), rng.choice("abc")) for _ in range(3000)]
    got = locha.renumbered(spark.createDataFrame(rows, "k long, s string").repartition(6), "k", "s").distinct().collect()
    assert {(r["k"], r["s"]): r["number"] for r in got} == {k: i for i, k in enumerate(sorted(set(rows)), 1)}
