"""Clusters and nearness of shapes that lie on each other, against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.operators import locha, nearby
from terravet.plans.tables import Steps

SHAPE = "id long, geom struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"


def line(*points):
    return ("line" if len(points) > 1 else "point", [[(float(x), float(y)) for x, y in points]])


def plain_clusters(points, reach):
    up = {i: i for i in points}
    find = lambda x: x if up[x] == x else find(up[x])
    for i, a in points.items():
        for j, b in points.items():
            if i < j and math.dist(a, b) <= reach:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in points}


@pytest.mark.parametrize("reach", [1.0, 2.5])
def test_clusters(spark, reach):
    rng = random.Random(5)
    points = {i * 3: (rng.randint(0, 30), rng.randint(0, 30)) for i in range(150)}
    df = spark.createDataFrame([(i, line(p)) for i, p in points.items()], SHAPE).withColumn("cell", F.lit(0))
    assert dict(locha.linked_clusters(df, reach, Steps(spark, "t")).collect()) == plain_clusters(points, reach)


def test_copies_give_links_not_pairs(spark):
    df = spark.createDataFrame([(i, line((i % 2 * 3, 0))) for i in range(1000)], SHAPE).withColumn("cell", F.lit(0))
    assert nearby.links(df, ["cell"], 5.0, Steps(spark, "t")).count() <= 1000


def test_beside_goes_on_to_the_last_segment(spark):
    """As many shapes as ask for several rounds: all that near finds are found, and no other."""
    rng = random.Random(7)
    spot = lambda: (rng.uniform(0, 300), rng.uniform(0, 300))
    short = lambda p: line(p, (p[0] + rng.uniform(-3, 3), p[1] + rng.uniform(-3, 3)))
    a = [(i, short(spot())) for i in range(1500)]
    b = [(i, short(spot()) if i % 3 else line(spot())) for i in range(600)]
    one, two = spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE)
    steps = Steps(spark, "t")
    got = sorted(r[0] for r in nearby.beside(one, two, 2.0, steps).distinct().collect())
    want = sorted({r["o_id"] for r in nearby.near(one, two, [], 2.0, steps).collect()})
    assert got == want and 0 < len(got) < 600
    assert nearby.beside(one.limit(0), two, 2.0, steps).count() == 0


def test_merged_lines_over_a_batch(spark):
    """Geometries that no line is joined in go by whole arrays, the others by the walk; in one batch, as each alone."""
    rng = random.Random(9)
    part = lambda: [(float(rng.randint(0, 4)), float(rng.randint(0, 4))) for _ in range(rng.choice([1, 2, 3, 4]))]
    rows = [(i, None if i % 7 == 0 else ("collection", [part() for _ in range(rng.randint(0, 5))])) for i in range(200)]
    got = dict(spark.createDataFrame(rows, SHAPE).select("id", G.merged_lines("geom").alias("geom")).collect())
    for i, g in rows:
        if g is None:
            assert got[i] is None
            continue
        want = G.merge_lines(g[1]) + [p for p in g[1] if len(p) == 1]
        assert [[tuple(v) for v in p] for p in got[i]["parts"]] == want
        assert got[i]["kind"] == ("point" if len(want) == 1 and len(want[0]) == 1 else "line" if len(want) == 1 else "collection")
