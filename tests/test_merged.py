"""Line merge where lines meet and where they don't, by columns, against the merge of each geometry alone."""

import math
import random
import time

from pyspark.sql import functions as F

from terravet.functions import geometry as G

SHAPE = "id long, geom struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"


def test_only_lines_that_meet_are_walked(spark):
    rng = random.Random(11)
    part = lambda wide: [(float(rng.randint(0, wide)), float(rng.choice([-0.0, 0.0, 1.0]))) for _ in range(rng.choice([0, 1, 1, 2, 3, 5]))]
    rows = [(i, None if i % 9 == 0 else ("collection", [part(rng.choice([1, 40])) for _ in range(rng.randint(0, 5))])) for i in range(400)]
    df = spark.createDataFrame(rows, SHAPE)
    got = {r["id"]: r for r in df.select("id", G.merged(F.col("geom")).alias("geom"), G.merged_lines("geom").alias("all"), G.ends_shared(F.col("geom")).alias("meet")).collect()}
    meeting = 0
    for i, g in rows:
        assert got[i]["geom"] == got[i]["all"]
        if g is not None:
            ends = [v for p in g[1] if len(p) > 1 and p[0] != p[-1] for v in (p[0], p[-1])]
            assert got[i]["meet"] == (len(set(ends)) < len(ends))
            meeting += got[i]["meet"]
            want = G.merge_lines(g[1]) + [p for p in g[1] if len(p) == 1]
            assert [[tuple(v) for v in p] for p in got[i]["geom"]["parts"]] == want
    assert 20 < meeting < 300


def test_a_long_way_costs_its_length(spark):
    """Vertices are listed once for a way, not again for each of them."""
    n = 20_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.floor(i / 2).cast("double").alias("x"), F.lit(1.0).alias("y"))).alias("v"))
    start = time.monotonic()
    geom = df.select(G.way_line(F.transform("v", lambda p: p), F.lit(False)).alias("geom")).select(F.size(G.vertices(F.col("geom"))).alias("n"), G.bbox(F.col("geom")).alias("b")).first()
    assert geom["n"] == n // 2 and math.isclose(geom["b"]["max_x"], n // 2 - 1) and time.monotonic() - start < 20


def test_lines_are_put_in_order_by_their_ends():
    assert G.merge_order([("a", "b"), ("c", "b"), ("c", "d"), ("e", "e")]) == [[(0, True), (1, False), (2, True)], [(3, True)]]
    assert G.merge_order([("a", "b"), ("c", "a")]) == [[(1, True), (0, True)]] and G.merge_order([]) == []
    assert G.merge_order([("a", "b"), ("a", "c"), ("a", "d")]) == [[(0, True)], [(1, True)], [(2, True)]]
