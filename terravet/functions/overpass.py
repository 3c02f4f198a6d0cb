"""A query language over the entity views: selectors, boxes, circles, areas, ids, unions, recursion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions import polygons
from terravet.functions.tags import Selector
from terravet.operators.views import AREA_OFFSET
from terravet.plans.tables import Steps

KINDS = ("node", "way", "relation", "nwr", "nw", "nr", "wr", "area")
TYPES = {"node": "n", "way": "w", "relation": "r", "nwr": "nwr", "nw": "nw", "nr": "nr", "wr": "wr"}
_STATEMENT = re.compile(rf"\s*({'|'.join(sorted(KINDS, key=len, reverse=True))})\b")


class QueryError(ValueError):
    """Text that isn't a query."""


@dataclass
class Query:
    """One statement on objects."""

    kind: str
    selector: Selector | None = None
    ids: list[int] = field(default_factory=list)
    box: tuple[float, float, float, float] | None = None
    around: tuple[float, float, float] | None = None
    area: str | None = None
    source: str | None = None
    into: str = "_"


@dataclass
class Union:
    parts: list
    into: str = "_"


@dataclass
class Recurse:
    """> members and nodes of the set, >> the same and what they lead to, < and << what refers to it."""

    sign: str
    source: str = "_"
    into: str = "_"


@dataclass
class Out:
    source: str = "_"
    mode: str = "body"
    limit: int | None = None


def parse(text: str) -> list:
    """The statements of a query; settings in front are skipped. Raises QueryError."""
    text = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def expect(sign: str) -> None:
        nonlocal at
        skip()
        if not text.startswith(sign, at):
            raise QueryError(f"expected {sign!r} at {at}")
        at += len(sign)

    def match(pattern: str) -> re.Match | None:
        nonlocal at
        skip()
        found = re.compile(pattern).match(text, at)
        if found:
            at = found.end()
        return found

    def numbers(inside: str) -> list[float]:
        try:
            return [float(x) for x in inside.split(",")]
        except ValueError as e:
            raise QueryError(f"not numbers: {inside!r}") from e

    def into() -> str:
        found = match(r"->\s*\.(\w+)")
        return found[1] if found else "_"

    def objects() -> Query:
        nonlocal at
        found = match(_STATEMENT.pattern)
        q = Query(found[1])
        if (s := match(r"\.(\w+)")) is not None:
            q.source = s[1]
        filters = ""
        while True:
            skip()
            if text.startswith("[", at):
                end, quote = at, ""
                while end < len(text) and (quote or text[end] != "]"):
                    if quote:
                        end += text[end] == "\\"
                        quote = "" if text[end] == quote else quote
                    elif text[end] in "\"'":
                        quote = text[end]
                    end += 1
                filters += re.sub(r"\s*(!=|!~|=|~)\s*", r"\1", text[at : end + 1]) if '"' not in text[at:end] else text[at : end + 1]
                at = end + 1
            elif text.startswith("(", at):
                end = text.find(")", at)
                if end < 0:
                    raise QueryError(f"expected ) after {at}")
                inside, at = text[at + 1 : end].strip(), end + 1
                if inside.startswith("id:"):
                    q.ids = [int(x) for x in numbers(inside[3:])]
                elif inside.startswith("around"):
                    values = numbers(inside.split(":", 1)[1])
                    if len(values) != 3:
                        raise QueryError("around needs a radius, a latitude and a longitude")
                    q.around = tuple(values)
                elif inside.startswith("area"):
                    q.area = inside[4:].lstrip(".:") or "_"
                elif "," in inside:
                    values = numbers(inside)
                    if len(values) != 4:
                        raise QueryError("a box needs south, west, north and east")
                    q.box = tuple(values)
                else:
                    q.ids = [int(x) for x in numbers(inside)]
            else:
                break
        if filters:
            try:
                q.selector = Selector.parse(filters)
            except ValueError as e:
                raise QueryError(str(e)) from e
        q.into = into()
        return q

    def statement():
        nonlocal at
        skip()
        if text.startswith("(", at):
            at += 1
            parts = []
            while True:
                skip()
                if text.startswith(")", at):
                    at += 1
                    break
                if at >= len(text):
                    raise QueryError("an open union")
                parts.append(statement())
            made = Union(parts, into())
        elif (found := match(r"(\.(\w+)\s+)?out\b([^;]*)")) is not None:
            words = found[3].split()
            count = next((int(w) for w in words if w.isdigit()), None)
            mode = next((w for w in words if w in ("ids", "skel", "body", "tags", "meta", "count", "center", "geom", "bb")), "body")
            made = Out(found[2] or "_", mode, count)
        elif (found := match(r"(\.(\w+)\s*)?(>>|<<|>|<)")) is not None:
            made = Recurse(found[3], found[2] or "_", into())
        elif _STATEMENT.match(text, at):
            made = objects()
        elif (found := match(r"\.(\w+)")) is not None:
            made = Query("nwr", source=found[1], into=into())
        else:
            raise QueryError(f"no statement at {at}: {text[at : at + 20]!r}")
        expect(";")
        return made

    skip()
    while text.startswith("[", at):
        end = text.find(";", at)
        at = (end + 1) if end >= 0 and "]" in text[at:end] else len(text)
        skip()
    out = []
    while True:
        skip()
        if at >= len(text):
            return out
        out.append(statement())


def _in_box(geom: Column, box: tuple[float, float, float, float]) -> Column:
    south, west, north, east = box
    b = G.bbox(geom)
    return (b["min_x"] <= east) & (b["max_x"] >= west) & (b["min_y"] <= north) & (b["max_y"] >= south)


class Interpreter:
    """Runs statements over views: `objects` (BASE columns and geom) and `areas` (id, tags, geom)."""

    def __init__(self, objects: DataFrame, areas: DataFrame | None = None):
        self.objects, self.areas, self.sets = objects, areas, {}
        self.empty = objects.limit(0)

    def get(self, name: str) -> DataFrame:
        return self.sets.get(name, self.empty)

    def run(self, q) -> DataFrame:
        match q:
            case Query():
                rows = self.query(q)
            case Union():
                rows = reduce(lambda a, b: a.unionByName(b), [self.run(p) for p in q.parts]).dropDuplicates(["objtype", "id"]) if q.parts else self.empty
            case Recurse():
                rows = self.recurse(q.sign, self.get(q.source))
            case _:
                raise QueryError(f"can't run {q}")
        self.sets[q.into] = rows
        return rows

    def query(self, q: Query) -> DataFrame:
        rows = self.objects if q.source is None else self.get(q.source)
        if q.kind == "area":
            if self.areas is None:
                return self.empty
            rows = self.areas.withColumn("objtype", F.lit("r")).select(*[F.col(c) if c in ("objtype", "id", "tags", "geom") else F.lit(None).cast(self.objects.schema[c].dataType).alias(c) for c in self.objects.columns])
        elif q.kind != "nwr":
            rows = rows.filter(F.col("objtype").isin(list(TYPES[q.kind])))
        if q.ids:
            rows = rows.filter(F.col("id").isin(q.ids))
        if q.selector is not None:
            rows = rows.filter(q.selector.column(F.col("tags")))
        if q.box:
            rows = rows.filter(_in_box(F.col("geom"), q.box))
        if q.around:
            radius, lat, lon = q.around
            plane = G.Projection(0, (lon, lat))
            here = G.geometry("point", F.array(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))))
            rows = rows.filter("geom IS NOT NULL").filter(G.geometry_distance(plane.geometry(F.col("geom")), here) <= radius)
        if q.area is not None:
            rows = self.inside(rows, q.area)
        return rows

    def inside(self, rows: DataFrame, area: str) -> DataFrame:
        """Rows that meet one of the areas of a set, or the area of a number.

        Areas are cut in cells that are small where their borders are; segments of the rows meet them in the cells of the
        sizes in use, so that no geometry is joined whole.
        """
        found = self.areas.filter(F.col("id") == int(area)) if area.isdigit() else self.get(area)
        quads = found.filter("geom IS NOT NULL").select(F.explode(polygons.area_quads("geom")).alias("quad"))
        quads = Steps(rows.sparkSession, "areas").keep(quads.select("quad.level", "quad.cx", "quad.cy", "quad"))
        levels = sorted(r[0] for r in quads.select("level").distinct().collect())  # a few numbers
        if not levels:
            return rows.limit(0)
        segments = rows.filter("geom IS NOT NULL").select("objtype", "id", F.explode(G.segment_ends(F.col("geom"))).alias("s"))
        every = segments.select("objtype", "id", "s", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
        placed = every.select("objtype", "id", "s", "level", F.explode(G.cells_along(F.col("s"), F.lit(polygons.FINEST) * F.pow(F.lit(2.0), F.col("level")))).alias("cell"))
        met = placed.select("objtype", "id", "s", "level", "cell.cx", "cell.cy").join(quads, ["level", "cx", "cy"])
        hit = met.filter(polygons.segment_meets("s", "quad")).select("objtype", "id").distinct()
        return rows.join(hit, ["objtype", "id"], "left_semi")

    def recurse(self, sign: str, rows: DataFrame) -> DataFrame:
        if sign[0] == ">":
            nodes = rows.filter("objtype = 'w'").select(F.lit("n").alias("objtype"), F.explode("nodes").alias("id"))
            members = rows.filter("objtype = 'r'").select(F.explode("members").alias("m")).select(F.col("m.type").alias("objtype"), F.col("m.ref").alias("id"))
            first = self.objects.join(nodes.union(members).distinct(), ["objtype", "id"], "left_semi")
            ways = first.filter("objtype = 'w'").select(F.lit("n").alias("objtype"), F.explode("nodes").alias("id")).distinct()
            out = first.unionByName(self.objects.join(ways, ["objtype", "id"], "left_semi"))
        else:
            keys = rows.select("objtype", "id").distinct()
            refs = self.objects.filter("objtype = 'w'").select(F.col("id").alias("w"), F.explode("nodes").alias("id"))
            ways = refs.join(keys.filter("objtype = 'n'").select("id"), "id", "left_semi").select(F.lit("w").alias("objtype"), F.col("w").alias("id"))
            members = self.objects.filter("objtype = 'r'").select(F.col("id").alias("r"), F.explode("members").alias("m")).select("r", F.col("m.type").alias("objtype"), F.col("m.ref").alias("id"))
            rels = members.join(keys, ["objtype", "id"], "left_semi").select(F.lit("r").alias("objtype"), F.col("r").alias("id"))
            out = self.objects.join(ways.union(rels).distinct(), ["objtype", "id"], "left_semi")
        return out.dropDuplicates(["objtype", "id"])


def element_json(mode: str = "body") -> Column:
    kind = F.when(F.col("objtype") == "n", "node").when(F.col("objtype") == "w", "way").otherwise("relation")
    cols = [kind.alias("type"), F.col("id")]
    if mode != "ids":
        cols += [F.col("lat"), F.col("lon"), F.col("nodes"), F.col("members")]
    if mode in ("body", "tags", "meta", "center", "geom", "bb"):
        cols += [F.col("tags")]
    if mode == "meta":
        cols += [F.col("version"), F.col("created").alias("timestamp"), F.col("changeset_id").alias("changeset")]
    if mode == "center":
        b = G.bbox(F.col("geom"))
        cols += [F.struct(((b["min_y"] + b["max_y"]) / 2).alias("lat"), ((b["min_x"] + b["max_x"]) / 2).alias("lon")).alias("center")]
    return F.to_json(F.struct(*cols))


def query(objects: DataFrame, text: str, areas: DataFrame | None = None) -> DataFrame:
    """One column j with the JSON of what the query puts out."""
    machine, outs = Interpreter(objects, areas), []
    for s in parse(text):
        if not isinstance(s, Out):
            machine.run(s)
            continue
        rows = machine.get(s.source)
        if s.mode == "count":
            outs.append(rows.agg(F.to_json(F.struct(F.lit("count").alias("type"), F.count(F.lit(1)).alias("total"))).alias("j")))
            continue
        if s.limit is not None:
            rows = rows.orderBy("objtype", "id").limit(s.limit)
        outs.append(rows.select(element_json(s.mode).alias("j")))
    if not outs:
        raise QueryError("nothing is put out")
    return reduce(lambda a, b: a.union(b), outs)


def area_id(relation_id: Column) -> Column:
    return relation_id + F.lit(AREA_OFFSET)
