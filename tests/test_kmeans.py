"""The registered query kmeans_split against k-means written out, over all nodes of the smallest tables."""

import math
from collections import defaultdict

import pytest
from test_catalogue import DATA

from terravet.operators import locha
from terravet.plans.catalogue import QUERIES
from terravet.sources.warehouse import Warehouse

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


def mean(points):
    return tuple(math.fsum(p[i] for p in points) / len(points) for i in (0, 1))


def groups_of(points, k, radius):
    """Indexes of each group: begun at the point next to the mean, then at the farthest points; more groups while one is too wide."""
    square = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    least = lambda xs: min(range(len(xs)), key=lambda i: (round(xs[i], 6), i))
    while True:
        middle = mean(points)
        centres = [points[least([square(p, middle) for p in points])]]
        while len(centres) < k:
            far = [min(square(p, c) for c in centres) for p in points]
            centres.append(points[least([-x for x in far])])
        for _ in range(20):
            label = [least([square(p, c) for c in centres]) for p in points]
            new = [mean([p for p, g in zip(points, label) if g == j]) if j in label else centres[j] for j in range(k)]
            if all(math.isclose(a, b, abs_tol=1e-12) for x, y in zip(new, centres) for a, b in zip(x, y)):
                break
            centres = new
        if max(math.sqrt(square(p, centres[g])) for p, g in zip(points, label)) <= radius or k >= len(points):
            out = defaultdict(list)
            for i, g in enumerate(label):
                out[g].append(i)
            return list(out.values())
        k += 1


def split(points):
    """Sets of ids: points (id, x, y) of one cluster."""
    done, todo = [], [(points, 0)]
    while todo:
        own, depth = todo.pop()
        if depth and (len(own) <= locha.MOST or depth >= locha.ROUNDS):
            done.append(frozenset(i for i, _, _ in own))
            continue
        for g in groups_of([(x, y) for _, x, y in own], -(-len(own) // locha.MOST), locha.RADIUS * 10.0):
            todo.append(([own[i] for i in g], depth + 1))
    return done


def test_all_nodes(spark):
    clusters, parts = defaultdict(list), defaultdict(set)
    for r in Warehouse(spark, str(DATA)).nodes.select("id", "lon", "lat").orderBy("id").collect():
        clusters[r["id"] // 700].append((r["id"], r["lon"], r["lat"]))
    got = QUERIES["kmeans_split"](spark, str(DATA)).collect()
    for r in got:
        parts[r["cluster"], r["part"]].add(r["id"])
    assert len(got) == sum(map(len, clusters.values()))
    assert {frozenset(p) for p in parts.values()} == {s for own in clusters.values() for s in split(own)} and max(map(len, parts.values())) <= locha.MOST
