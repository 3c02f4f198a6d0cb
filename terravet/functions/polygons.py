"""Polygons of several rings: union by an overlay of their edges, and pieces of shapes by the cells of a grid.

A polygon is a list of closed rings under the even-odd rule. Coordinates are planar.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.functions import geometry as G
from terravet.schemas import GEOMETRY

#: How near the end of an edge counts as the end, as a share of the edge; how near points are one, as a share of all.
END, SAME = 1e-9, 1e-12

Rings = list[np.ndarray]


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def area(ring: np.ndarray) -> float:
    """Signed: positive if the ring turns left."""
    p = ring - ring[0]
    return float(cross(p[:-1], p[1:]).sum()) / 2


# --- union


def together(n: int, pairs: np.ndarray) -> list[list[int]]:
    """Groups of 0 to n - 1 that pairs join."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in pairs.tolist():
        up[find(i)] = find(j)
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def united(rings: Rings) -> Rings:
    """The rings of the union of what simple closed rings enclose: those outside turn left, those of holes that are left turn right.

    A ring whose box meets no other's is left as it is.
    """
    if len(rings) < 2:
        return list(rings)
    low, high = np.array([r.min(axis=0) for r in rings]), np.array([r.max(axis=0) for r in rings])
    out: Rings = []
    for group in together(len(rings), G.overlapping(low, high)):
        own = [rings[i] if area(rings[i]) > 0 else rings[i][::-1] for i in group]
        out += [rings[group[0]]] if len(group) == 1 else overlaid(own)
    return out


def split_points(a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, place along it, point) where edges of different rings have points in common."""
    pairs = G.overlapping(np.minimum(a, b), np.maximum(a, b))
    pairs = pairs[owner[pairs[:, 0]] != owner[pairs[:, 1]]]
    edges, places, points = [], [], []

    def add(edge: np.ndarray, place: np.ndarray, point: np.ndarray) -> None:
        inner = (place > END) & (place < 1 - END)
        edges.append(edge[inner]), places.append(place[inner]), points.append(point[inner])

    for at in range(0, len(pairs), G.PAIRS):
        i, j = pairs[at : at + G.PAIRS].T
        d, e, r = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        turn = cross(d, e)
        scale = np.sqrt((d * d).sum(axis=1) * (e * e).sum(axis=1))
        slanted = np.abs(turn) > 1e-14 * scale
        k = np.flatnonzero(slanted)
        t, u = cross(r[k], e[k]) / turn[k], cross(r[k], d[k]) / turn[k]
        hit = (t > -END) & (t < 1 + END) & (u > -END) & (u < 1 + END)
        k, t, u = k[hit], t[hit], u[hit]
        # An end of either edge is taken as it is, so that both go on from the same point.
        p = a[i[k]] + t[:, None] * d[k]
        for place, ends in ((u, (a[j[k]], b[j[k]])), (t, (a[i[k]], b[i[k]]))):
            p = np.where((place < END)[:, None], ends[0], np.where((place > 1 - END)[:, None], ends[1], p))
        add(i[k], t, p), add(j[k], u, p)
        k = np.flatnonzero(~slanted)
        k = k[np.abs(cross(d[k], r[k])) <= 1e-12 * np.maximum((d[k] ** 2).sum(axis=1), 1e-300) ** 0.5 * np.maximum(np.abs(r[k]).max(axis=1), np.abs(d[k]).max(axis=1))]
        for own, other, first, step in ((i, j, a[i], d), (j, i, a[j], e)):
            for end in (a, b):
                place = ((end[other[k]] - first[k]) * step[k]).sum(axis=1) / (step[k] ** 2).sum(axis=1)
                add(own[k], place, end[other[k]])
    return np.concatenate(edges or [np.zeros(0, int)]), np.concatenate(places or [np.zeros(0)]), np.concatenate(points or [np.zeros((0, 2))])


def overlaid(rings: Rings) -> Rings:
    """The union of rings that turn left: their edges are cut where they meet, those with the union on just one side are kept and linked."""
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    owner = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    some = (a != b).any(axis=1)
    a, b, owner = a[some], b[some], owner[some]
    edge, place, point = split_points(a, b, owner)
    m = len(a)
    of = np.concatenate([np.arange(m), edge, np.arange(m)])
    at = np.concatenate([np.zeros(m), place, np.ones(m)])
    xy = np.concatenate([a, point, b])
    order = np.lexsort((at, of))
    of, xy = of[order], xy[order]
    low = xy.min(axis=0)
    size = max(float((xy.max(axis=0) - low).max()), 1e-300)
    _, first, name = np.unique(np.round((xy - low) / (size * SAME * 1000)).astype(np.int64), axis=0, return_index=True, return_inverse=True)
    name, spot = name.ravel(), xy[first]
    u, v, ring = name[:-1], name[1:], owner[of[:-1]]
    use = (of[:-1] == of[1:]) & (u != v)
    u, v, ring = u[use], v[use], ring[use]
    key, edge = np.unique(np.column_stack([np.minimum(u, v), np.maximum(u, v)]), axis=0, return_inverse=True)
    edge = edge.ravel()
    ahead, back = np.zeros(len(key), bool), np.zeros(len(key), bool)
    ahead[edge[u < v]], back[edge[u > v]] = True, True
    middle, inside = (spot[key[:, 0]] + spot[key[:, 1]]) / 2, np.zeros(len(key), bool)
    for r, shape in enumerate(rings):
        rest = ~inside & (middle >= shape.min(axis=0)).all(axis=1) & (middle <= shape.max(axis=0)).all(axis=1)
        rest[edge[ring == r]] = False
        x = np.flatnonzero(rest)
        inside[x] = G._in_rings(middle[x], [shape])
    keep = ~inside & (ahead != back)
    start = np.where(ahead, key[:, 0], key[:, 1])[keep]
    end = np.where(ahead, key[:, 1], key[:, 0])[keep]
    return linked(start, end, spot)


def linked(start: np.ndarray, end: np.ndarray, spot: np.ndarray) -> Rings:
    """Closed rings of directed edges; where several go on from a point, the one next to the way back, turning right, so that rings only touch."""
    angle = np.arctan2(*(spot[end] - spot[start]).T[::-1])
    order = np.lexsort((angle, start))
    start, end, angle = start[order], end[order], angle[order]
    begin, stop = np.searchsorted(start, end, "left"), np.searchsorted(start, end, "right")
    back = np.arctan2(*(spot[start] - spot[end]).T[::-1])
    onward = np.full(len(start), -1)
    for k, (x, y) in enumerate(zip(begin.tolist(), stop.tolist())):
        if y > x:
            turn = (back[k] - angle[x:y]) % (2 * math.pi)
            turn[turn < 1e-12] = 2 * math.pi
            onward[k] = x + int(turn.argmin())
    out, seen = [], np.zeros(len(start), bool)
    for k in range(len(start)):
        path = []
        while k >= 0 and not seen[k]:
            seen[k] = True
            path.append(k)
            k = onward[k]
        if len(path) > 2 and k == path[0]:
            ring = spot[[*start[path], start[path[0]]]]
            if area(ring) != 0:
                out.append(ring)
    return out


@F.arrow_udf(GEOMETRY)
def area_of(geoms: pa.Array) -> pa.Array:
    """The area that the closed parts of a shape enclose: each ring that is valid fills, as all are united; null without any."""
    out = []
    for g in geoms.to_pylist():
        rings = [r for r in G.parts_of(g) if len(r) >= 4 and G.simple_ring(list(map(tuple, r.tolist())))]
        out.append({"kind": "polygon", "parts": points_of(united(rings))} if rings else None)
    return pa.array(out, G.ARROW_GEOMETRY)


def points_of(parts: Rings) -> list[list[dict]]:
    return [[{"x": x, "y": y} for x, y in p.tolist()] for p in parts]


# --- pieces


def cut_line(line: np.ndarray, axis: int, at: float) -> tuple[np.ndarray, np.ndarray]:
    """The line with a vertex wherever it passes the coordinate `at`, and the vertices' coordinates."""
    c = line[:, axis]
    k = np.flatnonzero((c[:-1] - at) * (c[1:] - at) < 0)
    if len(k):
        t = (at - c[k]) / (c[k + 1] - c[k])
        new = line[k] + t[:, None] * (line[k + 1] - line[k])
        new[:, axis] = at
        line = np.insert(line, k + 1, new, axis=0)
    return line, line[:, axis]


def half_of_line(line: np.ndarray, axis: int, at: float, below: bool) -> Rings:
    """Parts of a line on one side; what lies on the border is above."""
    line, c = cut_line(line, axis, at)
    on = c <= at if below else c >= at
    if len(line) == 1:
        return [line] if (c[0] < at) == below else []
    go = on[:-1] & on[1:]
    if below:
        go &= (c[:-1] < at) | (c[1:] < at)
    alone = on.copy()
    alone[:-1] &= ~go
    alone[1:] &= ~go
    edges = np.flatnonzero(np.diff(np.concatenate([[False], go, [False]]).astype(np.int8)))
    out = [line[x : y + 1] for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]
    return out if below else out + [line[i : i + 1] for i in np.flatnonzero(alone)]


def half_of_ring(ring: np.ndarray, axis: int, at: float, below: bool) -> np.ndarray | None:
    """A ring's part on one side, closed along the border, where edges may lie on each other; None without area."""
    line, c = cut_line(ring, axis, at)
    part = line[c <= at if below else c >= at]
    if len(part) < 3:
        return None
    part = part if (part[0] == part[-1]).all() else np.concatenate([part, part[:1]])
    return part if len(part) >= 4 and area(part) != 0 else None


def halves(kind: str, parts: Rings, axis: int, at: float, below: bool) -> Rings:
    if kind == "polygon":
        return [r for p in parts if (r := half_of_ring(p, axis, at, below)) is not None]
    return [x for p in parts for x in half_of_line(p, axis, at, below)]


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of n numbers each, one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def line_pieces(xy: np.ndarray, at: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, cell, first, last, points): the pieces of lines, the vertices xy[at[i]:at[i + 1]] (one at least), in order; a piece is points[first:last + 1].

    Lines are cut wherever they pass a border, all at once; what runs along one is in the upper cell.
    """
    line = np.repeat(np.arange(len(at) - 1), np.diff(at))
    p = np.flatnonzero(line[1:] == line[:-1])
    vertex, place, point = [np.arange(len(xy))], [np.zeros(len(xy))], [xy]
    for axis in (0, 1):
        a, b = xy[p, axis], xy[p + 1, axis]
        first, last = np.floor(np.minimum(a, b) / size) + 1, np.ceil(np.maximum(a, b) / size) - 1
        n = np.maximum(last - first + 1, 0).astype(int)
        e = np.repeat(np.arange(len(p)), n)
        border = runs(first.astype(int), n) * size
        t = (border - a[e]) / (b[e] - a[e])
        new = xy[p[e]] + t[:, None] * (xy[p[e] + 1] - xy[p[e]])
        new[:, axis] = border
        vertex.append(p[e]), place.append(t), point.append(new)
    of = np.concatenate(vertex)
    order = np.lexsort((np.concatenate(place), of))
    points, line = np.concatenate(point)[order], line[of[order]]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (points[1:] != points[:-1]).any(axis=1)])[: len(line)]
    points, line = points[new], line[new]
    step = np.flatnonzero(line[1:] == line[:-1])
    cell = np.floor((points[step] + points[step + 1]) / 2 / size).astype(int)
    begin = np.flatnonzero(np.concatenate([[True], (line[step[1:]] != line[step[:-1]]) | (cell[1:] != cell[:-1]).any(axis=1)])[: len(step)])
    end = np.concatenate([begin[1:] - 1, [len(step) - 1]])[: len(begin)]
    lone = np.flatnonzero(np.bincount(line, minlength=len(at) - 1)[line] == 1)
    first, last = np.concatenate([step[begin], lone]), np.concatenate([step[end] + 1, lone])
    cells = np.concatenate([cell[begin], np.floor(points[lone] / size).astype(int)])
    order = np.argsort(first, kind="stable")
    return line[first[order]], cells[order], first[order], last[order], points


def pieces(kind: str, parts: Rings, size: float) -> list[tuple[int, int, Rings]]:
    """(cx, cy, parts) of what lies in each cell of side `size`; areas by halves of halves, so that no vertex is met more often than there are halvings."""
    if not parts:
        return []
    if kind != "polygon":
        by: dict[tuple[int, int], Rings] = {}
        _, cells, first, last, points = line_pieces(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), size)
        for cell, x, y in zip(map(tuple, cells.tolist()), first.tolist(), last.tolist()):
            by.setdefault(cell, []).append(points[x : y + 1])
        return sorted(((x, y, own) for (x, y), own in by.items()), key=lambda p: p[:2])
    points = np.concatenate(parts)
    low, high = np.floor(points.min(axis=0) / size).astype(int), np.floor(points.max(axis=0) / size).astype(int)
    todo, out = [(parts, *low.tolist(), *high.tolist())], []
    while todo:
        own, x0, y0, x1, y1 = todo.pop()
        if not own:
            continue
        if (x0, y0) == (x1, y1):
            out.append((x0, y0, own))
            continue
        axis = 0 if x1 - x0 >= y1 - y0 else 1
        middle = ((x0 + x1) if axis == 0 else (y0 + y1)) // 2 + 1
        for below in (True, False):
            box = [x0, y0, x1, y1]
            box[axis + 2 * below] = middle - below
            todo.append((halves(kind, own, axis, middle * size, below), *box))
    return sorted(out, key=lambda p: p[:2])


PIECE = T.StructType([T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("geom", GEOMETRY)])


ARROW_PIECE = pa.struct([("cx", pa.int64()), ("cy", pa.int64()), ("geom", G.ARROW_GEOMETRY)])


def split_lines(geoms: pa.Array, size: float) -> pa.Array:
    """The pieces of shapes without areas, over whole arrays."""
    n, some, kinds = len(geoms), geoms.is_valid().to_numpy(zero_copy_only=False), np.array(geoms.field(0).to_pylist(), object)
    parts = geoms.field(1)
    count = np.where(some, np.diff(parts.offsets.to_numpy()), 0)
    part, owner = runs(parts.offsets.to_numpy()[:-1].astype(np.int64), count), np.repeat(np.arange(n), count)
    lines = parts.values
    at = lines.offsets.to_numpy().astype(np.int64)
    part, owner = part[np.diff(at)[part] > 0], owner[np.diff(at)[part] > 0]
    xy = np.column_stack([c.to_numpy(zero_copy_only=False) for c in lines.values.flatten()])
    n_xy = np.diff(at)[part]
    line, cell, first, last, points = line_pieces(xy[runs(at[part], n_xy)], np.concatenate([[0], np.cumsum(n_xy)]), size)
    own = owner[line]
    order = np.lexsort((cell[:, 1], cell[:, 0], own))
    own, cell, first, last = own[order], cell[order], first[order], last[order]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (cell[1:] != cell[:-1]).any(axis=1)])[: len(own)])
    of_cell = np.diff(np.concatenate([new, [len(own)]]))
    kind = np.where(kinds[own[new]] == "point", "point", np.where(of_cell == 1, "line", "collection"))
    offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    xs, ys = points[runs(first, last - first + 1)].T
    vertices = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xs)), pa.array(np.ascontiguousarray(ys))], fields=list(G.ARROW_POINT))
    rows = pa.ListArray.from_arrays(offsets(of_cell), pa.ListArray.from_arrays(offsets(last - first + 1), vertices))
    shapes = pa.StructArray.from_arrays([pa.array(kind, pa.string()), rows], ["kind", "parts"])
    each = pa.StructArray.from_arrays([pa.array(cell[new, 0], pa.int64()), pa.array(cell[new, 1], pa.int64()), shapes], ["cx", "cy", "geom"])
    return pa.ListArray.from_arrays(offsets(np.bincount(own[new], minlength=n)), each, mask=pa.array(~some)).cast(pa.list_(ARROW_PIECE))


def split_by_grid(geom: Column, size: float) -> Column:
    """array of (cx, cy, geom): the pieces of a shape, each in its cell of side `size`; null for null. Lengths and areas add up.

    What lies on the border of two cells is in the upper; a polygon's piece may run along its cell's border to and fro.
    """

    @F.arrow_udf(T.ArrayType(PIECE))
    def udf(geoms: pa.Array) -> pa.Array:
        if "polygon" not in geoms.field(0).to_pylist():
            return split_lines(geoms, size)
        out = []
        for g in geoms.to_pylist():
            kind = g and ("polygon" if g["kind"] == "polygon" else "line")
            out.append(None if g is None else [{"cx": x, "cy": y, "geom": {"kind": g["kind"] if g["kind"] in ("polygon", "point") else "line" if len(p) == 1 else "collection", "parts": points_of(p)}} for x, y, p in pieces(kind, G.parts_of(g), size)])
        return pa.array(out, pa.list_(ARROW_PIECE))

    return udf(geom)


# --- areas as pieces of cells that grow where the border is far

#: Side of the finest cells, and edges below which a cell isn't cut further.
FINEST, EDGES = 1e-3, 32


def quads(rings: Rings) -> list[tuple[int, int, int, Rings, Rings]]:
    """(level, cx, cy, rings, edges) of the cells of side FINEST * 2^level that hold a polygon, each point of it in one cell; a cell
    that is wholly inside has no edges, and its rings are its border."""
    if not rings:
        return []
    points = np.concatenate(rings)
    low, high = points.min(axis=0), points.max(axis=0)
    level = max(0, math.ceil(math.log2(max(float((high - low).max()), FINEST) / FINEST)))
    side = FINEST * 2.0**level
    x0, y0 = np.floor(low / side).astype(int).tolist()
    out, todo = [], []
    for cx in range(x0, int(math.floor(high[0] / side)) + 1):
        for cy in range(y0, int(math.floor(high[1] / side)) + 1):
            todo.append((level, cx, cy, within("polygon", rings, cx, cy, side), within("line", rings, cx, cy, side)))
    while todo:
        level, cx, cy, own, edges = todo.pop()
        side = FINEST * 2.0**level
        if not edges:
            middle = np.array([[(cx + 0.5) * side, (cy + 0.5) * side]])
            if own and G._in_rings(middle, own)[0]:
                out.append((level, cx, cy, own, []))
            continue
        if level == 0 or sum(map(len, edges)) <= EDGES:
            out.append((level, cx, cy, own, edges))
            continue
        for x in (0, 1):
            a, b = halves("polygon", own, 0, (2 * cx + 1) * side / 2, not x), halves("line", edges, 0, (2 * cx + 1) * side / 2, not x)
            for y in (0, 1):
                at = (2 * cy + 1) * side / 2
                todo.append((level - 1, 2 * cx + x, 2 * cy + y, halves("polygon", a, 1, at, not y), halves("line", b, 1, at, not y)))
    return out


def within(kind: str, parts: Rings, cx: int, cy: int, side: float) -> Rings:
    for axis, c in ((0, cx), (1, cy)):
        parts = halves(kind, halves(kind, parts, axis, c * side, False), axis, (c + 1) * side, True)
    return parts


PARTS = GEOMETRY["parts"].dataType
QUAD = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("rings", PARTS), T.StructField("edges", PARTS)])


@F.arrow_udf(T.ArrayType(QUAD))
def area_quads(geoms: pa.Array) -> pa.Array:
    parts = pa.list_(pa.list_(G.ARROW_POINT))
    kind = pa.list_(pa.struct([("level", pa.int32()), ("cx", pa.int64()), ("cy", pa.int64()), ("rings", parts), ("edges", parts)]))
    found = [[] if g is None else quads(G.parts_of(g)) for g in geoms.to_pylist()]
    return pa.array([[{"level": n, "cx": x, "cy": y, "rings": points_of(r), "edges": points_of(e)} for n, x, y, r, e in f] for f in found], kind)


def clipped(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The part of a segment in a box; None without any."""
    d, t0, t1 = b - a, 0.0, 1.0
    for axis in (0, 1):
        if d[axis] == 0:
            if not low[axis] <= a[axis] <= high[axis]:
                return None
            continue
        x, y = sorted(((low[axis] - a[axis]) / d[axis], (high[axis] - a[axis]) / d[axis]))
        t0, t1 = max(t0, x), min(t1, y)
    return (a + t0 * d if t0 > 0 else a, a + t1 * d if t1 < 1 else b) if t0 <= t1 else None


@F.arrow_udf(T.BooleanType())
def segment_meets(segment: pa.Array, quad: pa.Array) -> pa.Array:
    """Whether a segment (ax, ay, bx, by) has a point in common with the part of an area in a cell."""
    out = []
    for s, q in zip(segment.to_pylist(), quad.to_pylist()):
        side = FINEST * 2.0 ** q["level"]
        low = np.array([q["cx"], q["cy"]]) * side
        part = clipped(np.array([s["ax"], s["ay"]]), np.array([s["bx"], s["by"]]), low, low + side)
        if part is None:
            out.append(False)
            continue
        rings, edges = G.parts_of({"parts": q["rings"]}), G.parts_of({"parts": q["edges"]})
        a, b = part
        # A line that meets no edge is on one side of all: its middle tells which. The borders of two cells belong to the upper.
        middle = (a + b) / 2
        if not edges:
            out.append(bool((middle >= low).all() and (middle < low + side).all()))
        else:
            out.append(G._crossing(a[None], b[None], *G._segments(edges), touching=True) or bool(rings) and inside_half_open(middle, rings))
    return pa.array(out, pa.bool_())


def inside_half_open(p: np.ndarray, rings: Rings) -> bool:
    """Even-odd rule without the edges: a point on a left or lower border is inside, one on a right or upper isn't."""
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    spans = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return int((spans & (p[0] < x)).sum()) % 2 == 1
