"""Planar geometry in struct columns (see schemas.GEOMETRY): native expressions, and Arrow UDFs where they fall short."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.schemas import GEOMETRY
from terravet.schemas import POINT as POINT_TYPE

POINT = "struct<x:double,y:double>"
ARROW_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_GEOMETRY = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(ARROW_POINT)))])


def vertex(lon: Column, lat: Column) -> Column:
    """A vertex; null if a coordinate is."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y")))


def geometry(kind: str | Column, parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), parts.alias("parts"))


def point(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), geometry("point", F.array(F.array(vertex(lon, lat)))))


def no_repeats(vertices: Column) -> Column:
    """Consecutive equal vertices once.

    No lambda refers to another's variable: Spark doesn't hand such an expression to a Python function, but fails.
    """
    before = lambda v: F.concat(F.array(F.lit(None)), F.transform(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda p: F.struct(p.alias("p"))))
    paired = lambda v: F.zip_with(v, before(v), lambda p, b: F.struct(p.alias("p"), (b.isNull() | ~b["p"].eqNullSafe(p)).alias("new")))
    # An empty list is paired with one null before it.
    return bound(vertices, lambda v: F.when(F.size(v) == 0, v).otherwise(F.transform(F.filter(paired(v), lambda s: s["new"]), lambda s: s["p"])))


def bound(c: Column, f) -> Column:
    """f(c) with c computed once for a row, not again for each element that a lambda of f looks at."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def is_ring(nodes: Column) -> Column:
    """Whether a list of references ends where it begins; never null."""
    return F.coalesce((F.size(nodes) > 1) & (F.get(nodes, F.lit(0)) == F.get(nodes, F.size(nodes) - 1)), F.lit(False))


def way_line(vertices: Column, closed: Column) -> Column:
    """Geometry of a way from its known vertices in order: repeats go, one vertex is a point, a ring (closed) stays closed, none is null."""
    clean = no_repeats(vertices)

    def build(c: Column) -> Column:
        ends = F.when(F.size(c) > 0, 1)
        shut = F.when(closed & (F.size(c) > 1) & (F.element_at(c, ends) != F.element_at(c, -ends)), F.concat(c, F.slice(c, 1, 1))).otherwise(c)
        return F.when(F.size(c) == 0, F.lit(None)).when(F.size(c) == 1, geometry("point", F.array(c))).otherwise(geometry("line", F.array(shut)))

    return bound(clean, build)


def vertices(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def bbox(geom: Column) -> Column:
    xs, ys = vertices(geom)["x"], vertices(geom)["y"]
    return F.when(
        F.size(vertices(geom)) > 0,
        F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")),
    )


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def length(part: Column) -> Column:
    """Planar length of one vertex list."""
    start = F.struct(F.lit(0.0).alias("sum"), F.get(part, F.lit(0)).alias("last"))
    step = lambda s, p: F.struct((s["sum"] + F.sqrt(F.pow(p["x"] - s["last"]["x"], F.lit(2)) + F.pow(p["y"] - s["last"]["y"], F.lit(2)))).alias("sum"), p.alias("last"))
    return F.when(F.size(part) > 0, F.aggregate(part, start, step, lambda s: s["sum"])).otherwise(F.lit(0.0))


def is_closed(part: Column) -> Column:
    return (F.size(part) >= 2) & (F.get(part, F.lit(0)) == F.get(part, F.size(part) - 1))


def is_area(nodes: Column) -> Column:
    """Whether a way may stand for an area: a ring of at least four references."""
    return (F.size(nodes) >= 4) & (F.get(nodes, F.lit(0)) == F.get(nodes, F.size(nodes) - 1))


def _turned(ring: Column) -> Column:
    """A closed ring from its least vertex on, in the direction that sorts first."""
    return F.get(F.transform(F.array(F.slice(ring, 1, F.size(ring) - 1)), lambda r: F.least(_from_least(r), _from_least(F.reverse(r)))), F.lit(0))


def _from_least(r: Column) -> Column:
    at = F.array_position(r, F.array_min(r)).cast("int")
    return F.concat(F.slice(r, at, F.size(r)), F.slice(r, F.lit(1), at - 1))


def canonical(geom: Column) -> Column:
    """Parts in an order and direction that equal point sets of the same vertices share."""
    one = lambda p: F.when((F.size(p) > 2) & is_closed(p), _turned(p)).otherwise(F.least(p, F.reverse(p)))
    return F.array_sort(F.transform(geom["parts"], one))


def same(a: Column, b: Column) -> Column:
    """Whether two geometries have the same points, up to vertices in the middle of straight lines; null is the empty one."""
    empty = lambda g: g.isNull() | (F.size(vertices(g)) == 0)
    return F.when(empty(a) | empty(b), empty(a) & empty(b)).otherwise(canonical(a).eqNullSafe(canonical(b)))


def snapped(x: Column, cell: float) -> Column:
    return F.round(x / F.lit(float(cell))) * F.lit(float(cell))


def segments(geom: Column) -> Column:
    """Boxes of the segments of a geometry; a part of one vertex is a box of its own."""

    def of(part: Column) -> Column:
        def box(i: Column) -> Column:
            p, q = F.get(part, i), F.get(part, F.least(i + 1, F.size(part) - 1))
            return F.struct(F.least(p["x"], q["x"]).alias("min_x"), F.least(p["y"], q["y"]).alias("min_y"), F.greatest(p["x"], q["x"]).alias("max_x"), F.greatest(p["y"], q["y"]).alias("max_y"))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(part) - 2, F.lit(0))), box)

    return F.flatten(F.transform(F.filter(geom["parts"], lambda p: F.size(p) > 0), of))


def segment_ends(geom: Column) -> Column:
    """Segments of a geometry by their ends (ax, ay, bx, by); a part of one vertex is a segment of its own."""

    def of(part: Column) -> Column:
        def ends(i: Column) -> Column:
            p, q = F.get(part, i), F.get(part, F.least(i + 1, F.size(part) - 1))
            return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(part) - 2, F.lit(0))), ends)

    return F.flatten(F.transform(F.filter(geom["parts"], lambda p: F.size(p) > 0), of))


def _point_to_segment(px: np.ndarray, py: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
    """Distances of points from segments (ax, ay, bx, by), row by row."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    size = dx * dx + dy * dy
    t = np.clip(((px - s["ax"]) * dx + (py - s["ay"]) * dy) / np.where(size == 0, 1, size), 0, 1)
    x, y = px - (s["ax"] + t * dx), py - (s["ay"] + t * dy)
    return np.sqrt(x * x + y * y)


def segments_within(a: Column, b: Column, reach: float) -> Column:
    """Whether two segments are at most `reach` apart: they cross, or an end of one is so near the other."""
    names = ("ax", "ay", "bx", "by")

    @F.arrow_udf(T.BooleanType())
    def udf(first: pa.Array, second: pa.Array) -> pa.Array:
        p, q = [dict(zip(names, (c.to_numpy(zero_copy_only=False) for c in x.flatten()))) for x in (first, second)]
        turn = lambda s, x, y: (s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"])
        sides = lambda s, o: turn(s, o["ax"], o["ay"]) * turn(s, o["bx"], o["by"]) < 0
        found = sides(p, q) & sides(q, p)
        for o, s in ((p, q), (q, p)):
            for x, y in (("ax", "ay"), ("bx", "by")):
                found |= _point_to_segment(o[x], o[y], s) <= reach
        return pa.array(found, pa.bool_())

    flat = lambda s: F.struct(*[s[c].alias(c) for c in names])
    return udf(flat(a), flat(b))


def segment_boxes_within(a: Column, b: Column, reach: float) -> Column:
    """Whether the boxes of two segments are at most `reach` apart on both axes, up to rounding: what segments_within needs at least."""
    far = reach * (1 + 1e-9)
    gap = lambda x, y: (F.least(b[x], b[y]) - F.greatest(a[x], a[y]) <= far) & (F.least(a[x], a[y]) - F.greatest(b[x], b[y]) <= far)
    return gap("ax", "bx") & gap("ay", "by")


def cells_along(s: Column, side: Column) -> Column:
    """Cells (cx, cy) of a grid that a segment (ax, ay, bx, by) may pass, as many as its length asks for: those of stretches no longer than a cell."""
    n = F.greatest(F.ceil(F.greatest(F.abs(s["bx"] - s["ax"]), F.abs(s["by"] - s["ay"])) / side), F.lit(1)).cast("int")
    low = lambda a, b: F.floor(F.least(a, b) / side)
    high = lambda a, b: F.floor(F.greatest(a, b) / side)

    def stretch(i: Column) -> Column:
        at = lambda p, q, k: p + (q - p) * k / n
        ax, bx = at(s["ax"], s["bx"], i), at(s["ax"], s["bx"], i + 1)
        ay, by = at(s["ay"], s["by"], i), at(s["ay"], s["by"], i + 1)
        return F.flatten(F.transform(F.sequence(low(ax, bx), high(ax, bx)), lambda x: F.transform(F.sequence(low(ay, by), high(ay, by)), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), stretch)))


def level(box: Column, size: float, margin: float) -> Column:
    """The grid whose cells, of size * 2^level, are no smaller than a box widened by the margin."""
    wide = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]) + 2 * margin
    return F.greatest(F.ceil(F.log2(F.greatest(wide, F.lit(size)) / F.lit(size))), F.lit(0)).cast("int")


def cells(box: Column, size: float, margin: float = 0.0, at: Column | None = None) -> Column:
    """Grid cells (struct of whole numbers cx, cy) that a box, widened by the margin, touches; at: a level of coarser grids."""
    side = F.lit(size) if at is None else F.lit(size) * F.pow(F.lit(2.0), at)
    low = lambda c: F.floor((c - F.lit(margin)) / side)
    high = lambda c: F.floor((c + F.lit(margin)) / side)
    xs, ys = F.sequence(low(box["min_x"]), high(box["max_x"])), F.sequence(low(box["min_y"]), high(box["max_y"]))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


# --- projections


class Projection:
    """Longitude and latitude to a plane in metres, or as they are."""

    def __init__(self, srid: int = 4326, origin: tuple[float, float] = (0.0, 0.0)):
        self.srid, self.origin = srid, origin

    def vertex(self, p: Column) -> Column:
        if self.srid == 4326:
            return p
        if 32601 <= self.srid <= 32660 or 32701 <= self.srid <= 32760:
            return self._utm(p)
        x0, y0 = self.origin
        r = 6371008.8
        return F.struct((F.radians(p["x"] - x0) * r * math.cos(math.radians(y0))).alias("x"), (F.radians(p["y"] - y0) * r).alias("y"))

    def geometry(self, geom: Column) -> Column:
        if self.srid == 4326:
            return geom
        return F.when(geom.isNotNull(), geometry(geom["kind"], F.transform(geom["parts"], lambda part: F.transform(part, self.vertex))))

    def _utm(self, p: Column) -> Column:
        """Transverse Mercator on WGS 84 by the series in the third flattening, to the third order."""
        a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
        n = f / (2 - f)
        big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
        e = 2 * math.sqrt(n) / (1 + n)
        phi, lam = F.radians(p["y"]), F.radians(p["x"] - F.lit(float((self.srid % 100) * 6 - 183)))
        t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, c in enumerate(alpha, 1):
            x = x + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        north = 10_000_000.0 if self.srid >= 32700 else 0.0
        return F.struct((F.lit(500_000.0) + F.lit(k0 * big) * x).alias("x"), (F.lit(north) + F.lit(k0 * big) * y).alias("y"))


# --- polygons given by configuration (few, on the driver)


def polygons_of(geojson: str | dict) -> list[list[list[tuple[float, float]]]]:
    """Polygons (lists of rings) of a GeoJSON polygon, multipolygon, feature or collection."""
    data = json.loads(geojson) if isinstance(geojson, str) else geojson
    match data.get("type"):
        case "FeatureCollection":
            return [p for f in data["features"] for p in polygons_of(f)]
        case "Feature":
            return polygons_of(data["geometry"])
        case "GeometryCollection":
            return [p for g in data["geometries"] for p in polygons_of(g)]
        case "Polygon":
            return [[[tuple(map(float, v[:2])) for v in ring] for ring in data["coordinates"]]]
        case "MultiPolygon":
            return [[[tuple(map(float, v[:2])) for v in ring] for ring in p] for p in data["coordinates"]]
    raise ValueError(f"no polygon: {data.get('type')}")


def box_polygon(min_x: float, min_y: float, max_x: float, max_y: float) -> list[list[list[tuple[float, float]]]]:
    return [[[(min_x, min_y), (max_x, min_y), (max_x, max_y), (min_x, max_y), (min_x, min_y)]]]


#: Pairs of vertices and edges that are compared in one array.
PAIRS = 1 << 20


def _in_rings(points: np.ndarray, rings: Sequence[np.ndarray]) -> np.ndarray:
    """Which points lie inside closed rings by the even-odd rule; on an edge counts as inside."""
    rings = [r for r in rings if len(r) > 1]
    if not rings:
        return np.zeros(len(points), bool)
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    out, step = np.zeros(len(points), bool), max(1, PAIRS // len(a))
    for at in range(0, len(points), step):
        x, y = points[at : at + step, 0][:, None], points[at : at + step, 1][:, None]
        turn = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        on = (turn == 0) & (np.minimum(a[:, 0], b[:, 0]) <= x) & (x <= np.maximum(a[:, 0], b[:, 0])) & (np.minimum(a[:, 1], b[:, 1]) <= y) & (y <= np.maximum(a[:, 1], b[:, 1]))
        spans = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        out[at : at + step] = on.any(axis=1) | ((spans & left).sum(axis=1) % 2 == 1)
    return out


def _segment_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points p (n, 2) from segments a-b (m, 2), as (n, m)."""
    d = b - a
    size = (d**2).sum(axis=1)
    t = ((p[:, None, :] - a[None]) * d[None]).sum(axis=2) / np.where(size == 0, 1, size)
    near = a[None] + np.clip(t, 0, 1)[:, :, None] * d[None]
    return np.sqrt(((p[:, None, :] - near) ** 2).sum(axis=2))


def _crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, touching: bool = False) -> bool:
    """Whether any segment a-b crosses any c-d, or with touching has a point in common with it."""
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    step = max(1, PAIRS // len(c))
    for at in range(0, len(a), step):
        p, q, r, t = a[at : at + step, None], b[at : at + step, None], c[None], d[None]
        one, two = turn(p, q, r) * turn(p, q, t), turn(r, t, p) * turn(r, t, q)
        if touching:
            boxes = ((np.minimum(p, q) <= np.maximum(r, t)) & (np.minimum(r, t) <= np.maximum(p, q))).all(axis=-1)
            if ((one <= 0) & (two <= 0) & boxes).any():
                return True
        elif ((one < 0) & (two < 0)).any():
            return True
    return False


def _segments(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = [p[:-1] if len(p) > 1 else p for p in parts]
    ends = [p[1:] if len(p) > 1 else p for p in parts]
    return np.concatenate(starts), np.concatenate(ends)


def _least_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    step = max(1, PAIRS // (4 * len(a)))
    return min(float(_segment_distance(p[at : at + step], a, b).min()) for at in range(0, len(p), step))


def distance(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Least distance between two sets of vertex lists; 0 where they cross. Compared in blocks of PAIRS."""
    (a1, a2), (b1, b2) = _segments(a), _segments(b)
    if _crossing(a1, a2, b1, b2):
        return 0.0
    return min(_least_distance(np.concatenate(a), b1, b2), _least_distance(np.concatenate(b), a1, a2))


def parts_of(geom) -> list[np.ndarray]:
    """Vertex arrays of a geometry as Arrow hands it over."""
    if geom is None:
        return []
    return [np.array([(v["x"], v["y"]) for v in part]) for part in geom["parts"] if len(part)]


def intersects_polygons(polygons: Sequence) -> callable:
    """An Arrow UDF: whether a geometry has a point in common with any of the polygons (closed over; they come from configuration).

    A polygon's inside counts on both sides: one that holds the other meets it.
    """
    rings = [[np.array(r, float) for r in p if len(r) > 1] for p in polygons]
    rings = [p for p in rings if p]
    boxes = [(np.concatenate(p).min(axis=0), np.concatenate(p).max(axis=0)) for p in rings]

    def meets(geom) -> bool:
        parts = parts_of(geom)
        if not parts:
            return False
        points = np.concatenate(parts)
        low, high = points.min(axis=0), points.max(axis=0)
        for own, (least, most) in zip(rings, boxes):
            if (low > most).any() or (high < least).any():
                continue
            if _in_rings(points, own).any() or _crossing(*_segments(parts), *_segments(own), touching=True):
                return True
            if geom["kind"] == "polygon" and _in_rings(own[0][:1], parts).any():
                return True
        return False

    @F.arrow_udf(T.BooleanType())
    def udf(geoms: pa.Array) -> pa.Array:
        return pa.array([None if g is None else meets(g) for g in geoms.to_pylist()], pa.bool_())

    return udf


@F.arrow_udf(T.DoubleType())
def geometry_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Least distance of two geometries; null if one is."""
    return pa.array([None if x is None or y is None else distance(parts_of(x), parts_of(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def surface_point(kind: str, parts: list[np.ndarray]) -> tuple[float, float] | None:
    """A point of the geometry: itself, a line's middle vertex, for a polygon one inside on a scan line."""
    if not parts:
        return None
    if kind != "polygon":
        p = max(parts, key=len)
        return tuple(map(float, p[len(p) // 2] if len(p) > 2 else p[0]))
    ring = max(parts, key=lambda p: float(np.ptp(p[:, 0]) * np.ptp(p[:, 1])))
    y = float(ring[:, 1].min() + ring[:, 1].max()) / 2
    a, b = ring[:-1], ring[1:]
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    xs = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
    if len(xs) < 2:
        return tuple(map(float, ring[0]))
    gaps = xs[1::2] - xs[: len(xs) // 2 * 2 : 2]
    k = int(np.argmax(gaps)) * 2
    return float((xs[k] + xs[k + 1]) / 2), y


@F.arrow_udf(POINT_TYPE)
def point_on_surface(geoms: pa.Array) -> pa.Array:
    found = [None if g is None else surface_point(g["kind"], parts_of(g)) for g in geoms.to_pylist()]
    return pa.array([None if f is None else {"x": f[0], "y": f[1]} for f in found], ARROW_POINT)


def merge_order(ends: list[tuple]) -> list[list[tuple[int, bool]]]:
    """Lines by their (first, last) vertices, stitched at ends that exactly two of them share: lists of lines, each with whether it runs forward."""
    at: dict[tuple, list[int]] = {}
    for i, (a, b) in enumerate(ends):
        if a != b:
            for v in (a, b):
                at.setdefault(v, []).append(i)
    join = {v: ids for v, ids in at.items() if len(ids) == 2 and ids[0] != ids[1]}
    turned = lambda chain: [(j, not forward) for j, forward in reversed(chain)]
    out, used = [], set()
    for i in range(len(ends)):
        if i in used:
            continue
        used.add(i)
        chain = [(i, True)]
        for turn in (False, True):
            if turn:
                chain = turned(chain)
            while (ids := join.get(last := ends[chain[-1][0]][chain[-1][1]])) and (j := next((k for k in ids if k not in used), None)) is not None:
                used.add(j)
                chain.append((j, ends[j][0] == last))
        out.append(turned(chain))
    return out


def merge_lines(parts: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Lines stitched together at ends that exactly two of them share."""
    lines, out = [list(p) for p in parts if len(p) > 1], []
    for chain in merge_order([(p[0], p[-1]) for p in lines]):
        run = [lines[j] if forward else lines[j][::-1] for j, forward in chain]
        out.append([v for k, line in enumerate(run) for v in line[k > 0 :]])
    return out


def _ends_shared(geom: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which geometries have an end (x, y) more than once; geom: that of each end."""
    order = np.lexsort((ends[:, 1], ends[:, 0], geom))
    g, e = geom[order], ends[order]
    again = (g[1:] == g[:-1]) & (e[1:] == e[:-1]).all(axis=1)
    return np.unique(g[1:][again])


@F.arrow_udf(GEOMETRY)
def merged_lines(geoms: pa.Array) -> pa.Array:
    """Line merge of a collection; a single open result is a line, points are kept beside.

    Only geometries in which two open lines share an end are walked; of the others the parts are put in order, lines first, over whole arrays.
    """
    parts = geoms.field(1)
    n, some = len(geoms), geoms.is_valid().to_numpy(zero_copy_only=False)
    first = parts.offsets.to_numpy()
    count = np.where(some, np.diff(first), 0)
    lines = parts.values
    at = lines.offsets.to_numpy()
    size = np.diff(at)
    xy = np.column_stack([c.to_numpy(zero_copy_only=False) for c in lines.values.flatten()]) if len(lines.values) else np.zeros((0, 2))
    part = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner = np.repeat(np.arange(n), count)
    full = size[part] > 1
    p, g = part[full], owner[full]
    a, b = xy[at[p]], xy[at[p + 1] - 1]
    open_ = (a != b).any(axis=1)
    walked = np.zeros(n, bool)
    walked[_ends_shared(np.concatenate([g[open_]] * 2), np.concatenate([a[open_], b[open_]]))] = True
    order = np.lexsort((part, size[part] == 1, owner))
    order = order[(size[part] > 0)[order]]
    numbers = np.bincount(owner[order], minlength=n)
    single = np.bincount(owner[order][size[part[order]] == 1], minlength=n)
    kinds = np.where(numbers == 1, np.where(single == 1, "point", "line"), "collection")
    offsets = np.concatenate([[0], np.cumsum(numbers)]).astype(np.int32)
    plain = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), lines.take(pa.array(part[order], pa.int64())))], ["kind", "parts"], mask=pa.array(~some)).cast(ARROW_GEOMETRY)
    rows = np.flatnonzero(walked)
    if not len(rows):
        return plain
    # Only ends are looked at in Python; the vertices are taken by their numbers.
    tuples = lambda v: list(map(tuple, v.tolist()))
    first_at, last_at = np.searchsorted(g, rows), np.searchsorted(g, rows, "right")
    pieces, in_part, in_row = [], [], []
    for row, i, j in zip(rows.tolist(), first_at.tolist(), last_at.tolist()):
        chains = merge_order(list(zip(tuples(a[i:j]), tuples(b[i:j]))))
        for chain in chains:
            pieces += [(int(p[i + k]), forward, m > 0) for m, (k, forward) in enumerate(chain)]
            in_part.append(len(chain))
        alone = [k for k in range(first[row], first[row + 1]) if size[k] == 1]
        pieces += [(k, True, False) for k in alone]
        in_part += [1] * len(alone)
        in_row.append(len(chains) + len(alone))
    line, forward, skip = (np.array(c, np.int64) for c in zip(*pieces))
    length = size[line] - skip
    begin = np.where(forward == 1, at[line] + skip, at[line + 1] - 1 - skip)
    vertex_ = np.repeat(begin, length) + np.repeat(np.where(forward == 1, 1, -1), length) * (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    ends_of = lambda counts: np.concatenate([[0], np.cumsum(counts)])
    listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
    new = listed(ends_of(in_row), listed(ends_of(length)[ends_of(in_part)], lines.values.take(pa.array(vertex_, pa.int64()))))
    kind = ["line" if k == 1 else "collection" for k in in_row]  # two lines at least met
    done = pa.StructArray.from_arrays([pa.array(kind, pa.string()), new], ["kind", "parts"]).cast(ARROW_GEOMETRY)
    take = np.arange(n)
    take[rows] = n + np.arange(len(rows))
    return pa.concat_arrays([plain, done]).take(pa.array(take))


def ends_shared(geom: Column) -> Column:
    """Whether two ends of a geometry's open lines are one vertex, by hashes; so that is never missed, and false never but by a clash."""
    end = lambda p, i: F.xxhash64(F.element_at(p, i)["x"] + F.lit(0.0), F.element_at(p, i)["y"] + F.lit(0.0))
    lines = F.filter(geom["parts"], lambda p: (F.size(p) > 1) & (F.element_at(p, 1) != F.element_at(p, -1)))
    ends = F.flatten(F.transform(lines, lambda p: F.array(end(p, 1), end(p, -1))))
    return bound(ends, lambda e: F.size(F.array_distinct(e)) < F.size(e))


def merged(geom: Column) -> Column:
    """merged_lines; only geometries in which lines meet go to Python, the parts of others are put in order where they are."""
    meet = F.coalesce(ends_shared(geom), F.lit(False))
    parts = F.concat(F.filter(geom["parts"], lambda p: F.size(p) > 1), F.filter(geom["parts"], lambda p: F.size(p) == 1))
    kind = lambda p: F.when(F.size(p) != 1, "collection").when(F.size(F.get(p, F.lit(0))) == 1, "point").otherwise("line")
    plain = F.when(geom.isNotNull(), bound(parts, lambda p: geometry(kind(p), p)))
    return F.when(meet, merged_lines(F.when(meet, geom))).otherwise(plain)


def overlapping(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of boxes that meet."""
    found = list(overlapping_blocks(low, high))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def overlapping_blocks(low: np.ndarray, high: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (i, j) of boxes that meet, in blocks: a sweep along the axis on which they overlap less, i before j by their lower sides."""
    spread = [float((high[:, k] - low[:, k]).sum()) / max(float(high[:, k].max() - low[:, k].min()), 1e-300) for k in (0, 1)] if len(low) else [0.0, 0.0]
    if spread[1] < spread[0]:
        low, high = low[:, ::-1], high[:, ::-1]
    order = np.argsort(low[:, 0], kind="stable")
    x0, x1 = low[order, 0], high[order, 0]
    ends = np.searchsorted(x0, x1, "right")
    counts = ends - np.arange(len(order)) - 1
    at, sums = 0, np.cumsum(counts)
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
        n = counts[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield np.column_stack([i[meet], j[meet]])
        at = stop


def self_crossing(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether segments a-b cross each other: only those whose boxes meet in a sweep from left to right are compared, in blocks."""
    turn = lambda p, q, r: (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
    for pairs in overlapping_blocks(np.minimum(a, b), np.maximum(a, b)):
        i, j = pairs.T
        p, q, r, t = a[i], b[i], a[j], b[j]
        if ((turn(p, q, r) * turn(p, q, t) < 0) & (turn(r, t, p) * turn(r, t, q) < 0)).any():
            return True
    return False


def simple_ring(ring: list[tuple[float, float]]) -> bool:
    """Whether a ring is closed, has an area and doesn't cross itself."""
    if len(ring) < 4 or ring[0] != ring[-1] or len(set(ring)) < 3:
        return False
    p = np.array(ring)
    if abs(float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum())) == 0:
        return False
    return len(set(ring[:-1])) == len(ring) - 1 and not self_crossing(p[:-1], p[1:])


@F.arrow_udf(T.BooleanType())
def is_valid(geoms: pa.Array) -> pa.Array:
    """Points are valid, lines with two different vertices, polygons with simple rings; null is not."""

    def valid(g: dict) -> bool:
        rows = [[(v["x"], v["y"]) for v in p] for p in g["parts"]]
        if g["kind"] == "polygon":
            return bool(rows) and all(simple_ring(r) for r in rows)
        return bool(rows) and all(len(r) == 1 or len(set(r)) > 1 for r in rows)

    return pa.array([g is not None and valid(g) for g in geoms.to_pylist()], pa.bool_())


def to_geojson(geom: Column) -> Column:
    """GeoJSON text."""
    xy = lambda p: F.array(p["x"], p["y"])
    parts = geom["parts"]
    one = F.get(parts, F.lit(0))
    as_point = F.to_json(F.struct(F.lit("Point").alias("type"), xy(F.get(one, F.lit(0))).alias("coordinates")))
    as_line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(one, xy).alias("coordinates")))
    rings = F.transform(parts, lambda p: F.transform(p, xy))
    as_polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
    as_lines = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), rings.alias("coordinates")))
    k = geom["kind"]
    return F.when(geom.isNull(), F.lit(None)).when(k == "point", as_point).when(k == "line", as_line).when(k == "polygon", as_polygon).otherwise(as_lines)
