"""Unions against a raster of the rings, pieces against lengths and areas, areas in cells against the rings."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions import overpass
from terravet.functions import polygons as P
from terravet.operators import shapes
from tests import domain as D


def square(x, y, n, turn=1):
    return np.array([(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)][::turn], float)


def star(rng, x, y, r, n):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    p = [(x + (d := rng.uniform(0.3, 1) * r) * math.cos(t), y + d * math.sin(t)) for t in at]
    return np.array([*p, p[0]])


def plain_in(points, rings):
    return np.array([[bool(G._in_rings(points[i : i + 1], [r])[0]) for r in rings] for i in range(len(points))]).any(axis=1)


def raster(rings, n=45):
    all_ = np.concatenate(rings)
    low, high = all_.min(axis=0) - 0.1037, all_.max(axis=0) + 0.0911
    return np.array([(x, y) for x in np.linspace(low[0], high[0], n) for y in np.linspace(low[1], high[1], n)])


CASES = {
    "inner": [square(0, 0, 10), square(3, 3, 2)],
    "inner turned": [square(0, 0, 10), square(3, 3, 2, -1)],
    "overlapping": [square(0, 0, 4), square(2, 1, 4)],
    "touching edge": [square(0, 0, 2), square(2, 0, 2), square(0, 2, 2)],
    "part of an edge": [square(0, 0, 4), square(4, 1, 2)],
    "touching corner": [square(0, 0, 2), square(2, 2, 2)],
    "same": [square(0, 0, 2), square(0, 0, 2, -1)],
    "frame": [np.array(r, float) for r in ([(0, 0), (9, 0), (9, 2), (0, 2), (0, 0)], [(0, 7), (9, 7), (9, 9), (0, 9), (0, 7)], [(0, 0), (2, 0), (2, 9), (0, 9), (0, 0)], [(7, 0), (9, 0), (9, 9), (7, 9), (7, 0)])],
    "apart": [square(0, 0, 1), square(5, 5, 1)],
    "inside, on an edge": [square(0, 0, 6), square(0, 2, 2)],
}


@pytest.mark.parametrize("name", CASES)
def test_union_of_cases(name):
    rings = CASES[name]
    out = P.united(rings)
    points = raster(rings)
    assert (G._in_rings(points, out) == plain_in(points, rings)).all()
    assert all((r[0] == r[-1]).all() for r in out)
    expected = {"inner": 1, "inner turned": 1, "overlapping": 1, "touching edge": 1, "part of an edge": 1, "touching corner": 2, "same": 1, "frame": 2, "apart": 2, "inside, on an edge": 1}
    assert len(out) == expected[name]
    assert abs(sum(map(P.area, out))) == pytest.approx({"frame": 81 - 25, "overlapping": 32 - 6, "inner": 100, "touching edge": 12}.get(name, abs(sum(map(P.area, out)))))


@pytest.mark.parametrize("seed", range(12))
def test_union_of_random_rings(seed):
    rng = random.Random(seed)
    rings = [star(rng, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(1, 5), rng.randint(3, 30)) for _ in range(rng.randint(2, 9))]
    if seed % 2:  # whole numbers: shared vertices, edges on each other
        rings = [square(rng.randint(0, 6), rng.randint(0, 6), rng.randint(1, 4)) for _ in range(8)]
    points = raster(rings)
    out = P.united(rings)
    assert (G._in_rings(points, out) == plain_in(points, rings)).all()


def test_union_of_many_vertices():
    t = np.linspace(0, 2 * math.pi, 20_001)
    circle = lambda x: np.column_stack([x + np.cos(t), np.sin(t)])
    rings = [circle(0.0), circle(1.0)]
    for r in rings:
        r[-1] = r[0]
    (out,) = P.united(rings)
    assert P.area(out) == pytest.approx(2 * math.pi - (2 * math.pi / 3 - math.sqrt(3) / 2), abs=1e-4)


@pytest.mark.parametrize("seed", range(6))
def test_pieces_add_up(seed):
    rng = random.Random(seed)
    ring = star(rng, 3, -2, 6, 40)
    line = np.array([(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(60)])
    line = np.concatenate([line, np.array([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (3.0, 3.0), (2.5, 2.0), (2.0, 2.0)])])
    size = [0.5, 1.0, 2.5][seed % 3]
    whole = lambda p: float(np.sqrt((np.diff(p, axis=0) ** 2).sum(axis=1)).sum())
    lines, rings = P.pieces("line", [line], size), P.pieces("polygon", [ring], size)
    assert sum(whole(p) for _, _, own in lines for p in own) == pytest.approx(whole(line))
    assert sum(P.area(p) for _, _, own in rings for p in own) == pytest.approx(P.area(ring))
    for cx, cy, own in (*lines, *rings):
        p = np.concatenate(own)
        assert (p >= np.array([cx, cy]) * size - 1e-9).all() and (p <= np.array([cx + 1, cy + 1]) * size + 1e-9).all()
    assert len({x[:2] for x in lines}) == len(lines)


def test_split_column(spark):
    g = "struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"
    of = lambda *p: [[{"x": float(x), "y": float(y)} for x, y in p]]
    df = spark.createDataFrame([(1, ("line", of((0.5, 0.5), (2.5, 0.5)))), (2, None), (3, ("point", of((-0.5, 3)))), (4, ("polygon", of((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))))], f"id int, geom {g}")
    rows = df.select("id", F.explode_outer(P.split_by_grid(F.col("geom"), 1.0)).alias("p")).select("id", "p.cx", "p.cy", "p.geom.kind").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [(1, 0, 0, "line"), (1, 1, 0, "line"), (1, 2, 0, "line"), (2, None, None, None), (3, -1, 3, "point"), (4, 0, 0, "polygon"), (4, 1, 0, "polygon")]))


@pytest.mark.parametrize("seed", range(5))
def test_cells_of_an_area(seed):
    rng = random.Random(seed)
    rings = P.united([star(rng, rng.uniform(0, 1), rng.uniform(0, 1), 0.4, 200), square(0.25, 0.25, 0.25)])
    found = P.quads(rings)
    side = lambda n: P.FINEST * 2.0**n
    assert all(sum(map(len, e)) <= P.EDGES or n == 0 for n, _, _, _, e in found)
    by = {(n, x, y): (r, e) for n, x, y, r, e in found}
    points = np.concatenate([np.array([(rng.uniform(-0.5, 1.5), rng.uniform(-0.5, 1.5)) for _ in range(300)]), rings[0][:20], np.array([(0.25, 0.25), (0.5, 0.3), (0.25, 0.375)])])
    expected = G._in_rings(points, rings)
    for p, e in zip(points, expected):
        cells = [(n, math.floor(p[0] / side(n)), math.floor(p[1] / side(n))) for n in {k[0] for k in by}]
        got = False
        for c in cells:
            if c in by:
                r, edges = by[c]
                got |= bool(edges and G._crossing(p[None], p[None], *G._segments(edges), touching=True)) or (bool(r) and P.inside_half_open(p, r))
        if not np.isclose(rings[0], p).all(axis=1).any():
            assert got == e


def test_cells_within_a_round_area():
    t = np.linspace(0, 2 * math.pi, 5001)
    ring = np.column_stack([np.cos(t), np.sin(t)])
    ring[-1] = ring[0]
    found = P.quads([ring])
    whole = sum((P.FINEST * 2.0**n) ** 2 for n, *_, e in found if not e)
    cut = sum(P.area(r) for *_, own, e in found if e for r in own)
    assert whole > 1 and whole + cut == pytest.approx(P.area(ring))


def area_world(spark):
    """Relation 1: a ring with an inner ring and one that overlaps it; relation 2: a ring that crosses itself beside a good one."""
    rings = {10: square(0, 0, 10), 11: square(3, 3, 2, -1), 12: square(8, 8, 4), 20: np.array([(20, 0), (22, 2), (22, 0), (20, 2), (20, 0)], float), 21: square(30, 0, 5)}
    nodes, ways, n = [], [], 100
    for w, ring in rings.items():
        ids = []
        for x, y in ring[:-1]:
            nodes.append((n, None, x, y))
            ids.append(n)
            n += 1
        ways.append((w, None, [*ids, ids[0]]))
    members = lambda *ids: [(i, "outer", "w") for i in ids]
    return nodes, ways, D.relations(spark, (1, {"name": "a"}, members(10, 11, 12)), (2, {"name": "b"}, members(20, 21)))


def test_areas_of_relations(spark):
    nodes, ways, relations = area_world(spark)
    lines = shapes.way_shapes(D.ways(spark, *ways), D.nodes(spark, *nodes))
    found = {r["id"]: G.parts_of(r["geom"]) for r in shapes.areas(relations, lines).collect()}
    assert abs(sum(map(P.area, found[1]))) == pytest.approx(100 + 16 - 4) and len(found[1]) == 1
    assert abs(sum(map(P.area, found[2]))) == pytest.approx(25) and len(found[2]) == 1


def test_objects_within_an_area(spark):
    nodes, ways, relations = area_world(spark)
    inside = {1: (4, 4), 2: (9, 9), 3: (1, 9.5), 4: (10, 5), 5: (11.5, 11.5), 6: (0, 0), 7: (12, 12), 8: (32, 1)}
    outside = {11: (10.5, 5), 12: (21, 1.5), 13: (-0.1, 4), 14: (12.0001, 12), 15: (15, 15)}
    more = [(i, {"t": "1"}, *p) for i, p in {**inside, **outside}.items()] + [(50, None, -5, 5), (51, None, 15, 5), (52, None, 11, 1), (53, None, 11, 7), (54, None, 4.2, 4.2), (55, None, 4.4, 4.6)]
    lines = [(60, {"t": "1"}, [50, 51]), (61, {"t": "1"}, [52, 53]), (62, {"t": "1"}, [54, 55])]
    n, w = D.nodes(spark, *nodes, *more), D.ways(spark, *ways, *lines)
    own = shapes.base_shapes(n, w, relations)
    base = D.base(spark, n, w, relations).join(own, ["objtype", "id"], "left")
    areas = shapes.areas(relations, own.filter("objtype = 'w'").select("id", "geom")).join(relations.select("id", "tags"), "id").withColumn("id", overpass.area_id(F.col("id")))
    ids = lambda q: sorted(json.loads(r["j"])["id"] for r in overpass.query(base, q, areas).collect())
    assert ids(f"node[t](area:{3_600_000_001});out ids;") == [1, 2, 3, 4, 5, 6, 7]
    assert ids("area[name=b]->.x;node[t](area.x);out ids;") == [8]
    assert ids(f"way[t](area:{3_600_000_001});out ids;") == [60, 62]
    assert ids("area[name=none]->.x;node[t](area.x);out ids;") == []
