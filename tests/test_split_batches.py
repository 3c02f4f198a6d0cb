"""Pieces of lines over whole Arrow batches are those of each line alone; how much of a line lies in each cell, by a plain walk."""

import math
import random

import numpy as np
import pyarrow as pa

from terravet.functions import geometry as G
from terravet.functions import polygons as P


def walked(line, size):
    """Length in each cell, by the sorted places of all borders on each segment."""
    out = {}
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        cuts = {0.0, 1.0}
        for a, b in ((ax, bx), (ay, by)):
            cuts |= {(k * size - a) / (b - a) for k in range(-20, 20) if a != b and 0 < (k * size - a) / (b - a) < 1}
        cuts = sorted(cuts)
        for s, t in zip(cuts, cuts[1:]):
            m = (s + t) / 2
            cell = (math.floor((ax + m * (bx - ax)) / size), math.floor((ay + m * (by - ay)) / size))
            out[cell] = out.get(cell, 0.0) + (t - s) * math.hypot(bx - ax, by - ay)
    return out


def test_a_batch_is_split_at_once():
    rng = random.Random(3)
    spot = lambda: (float(rng.randint(-9, 9)), float(rng.randint(-9, 9)))
    shapes = [None if i % 11 == 0 else [[spot() for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))] for _ in range(rng.randint(0, 3))] for i in range(300)]
    rows = [None if g is None else {"kind": "collection", "parts": [[{"x": x, "y": y} for x, y in p] for p in g]} for g in shapes]
    whole = pa.array([None, *rows], G.ARROW_GEOMETRY)[1:]
    got = P.split_lines(whole, 2.5).to_pylist()
    for g, row, found in zip(shapes, rows, got):
        if row is None:
            assert found is None
            continue
        want = P.pieces("line", [np.array(p) for p in g if p], 2.5)
        assert [(p["cx"], p["cy"], [[(v["x"], v["y"]) for v in q] for q in p["geom"]["parts"]]) for p in found] == [(x, y, [list(map(tuple, q.tolist())) for q in own]) for x, y, own in want]
        by = {}
        for p in g:
            for cell, n in walked(p, 2.5).items():
                by[cell] = by.get(cell, 0.0) + n
        mine = {(p["cx"], p["cy"]): sum(math.dist((a["x"], a["y"]), (b["x"], b["y"])) for q in p["geom"]["parts"] for a, b in zip(q, q[1:])) for p in found}
        assert all(math.isclose(n, by.get(c, 0.0), abs_tol=1e-9) for c, n in mine.items()) and all(math.isclose(n, mine.get(c, 0.0), abs_tol=1e-9) for c, n in by.items())


def test_nothing_to_split():
    assert P.split_lines(pa.array([], G.ARROW_GEOMETRY), 1.0).to_pylist() == []
    assert P.split_lines(pa.array([None, {"kind": "line", "parts": []}], G.ARROW_GEOMETRY), 1.0).to_pylist() == [None, []]
