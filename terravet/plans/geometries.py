"""Geometry of the base's ways and relations as tables of their own, kept up to date by the objects that an update touches.

Ways hang on their nodes, relations on member nodes and ways. After an update only the ways and relations that its nodes, ways
and relations lead to are computed again; all others stay as they were written. The tables note of which state of the base they
are, so that a base put in place otherwise makes them anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravet.functions import geometry as G
from terravet.operators import shapes
from terravet.plans.keyed import KeyedTable
from terravet.plans.tables import Steps, unsent
from terravet.schemas import GEOMETRY

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("geom", GEOMETRY)])


def points(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", G.point(F.col("lon"), F.col("lat")).alias("geom"))


def of_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, geom) of some ways, which take only the nodes that they list."""
    listed = ways.select(F.explode("nodes").alias("id")).distinct()
    return shapes.way_shapes(ways, nodes.join(listed, "id", "left_semi"))


def of_relations(relations: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, geom) of some relations, which take only the nodes and way geometries that they list: by one join with these."""
    return shapes.relation_shapes(relations, points(nodes), lines)


@dataclass
class Geometries:
    """The two tables, over the three of the base."""

    nodes: KeyedTable
    ways: KeyedTable
    relations: KeyedTable
    lines: KeyedTable
    areas: KeyedTable

    @staticmethod
    def under(base: dict[str, KeyedTable], folder: str) -> Geometries:
        own = lambda name: KeyedTable(base["ways"].spark, f"{folder}/{name}", SCHEMA, base["ways"].bits)
        return Geometries(base["nodes"], base["ways"], base["relations"], own("way_geometry"), own("relation_geometry"))

    def state(self) -> dict:
        found = {name: getattr(self, name).manifest() for name in ("nodes", "ways", "relations")}
        return {name: m.state if m else 0 for name, m in found.items()}

    def fresh(self) -> bool:
        now = self.state()
        return all((m := t.manifest()) is not None and m.notes == now for t in (self.lines, self.areas))

    def build(self) -> None:
        """Both tables from nothing. All meet all, by sorting joins, so that no table is gathered on the driver."""
        now, nodes = self.state(), self.nodes.read()
        self.lines.replace(shapes.way_shapes(self.ways.read(), nodes.hint("merge")), now)
        self.areas.replace(of_relations(self.relations.read().hint("merge"), nodes, self.lines.read()), now)

    def current(self) -> Geometries:
        if not self.fresh():
            self.build()
        return self

    def moved(self, changed: DataFrame) -> DataFrame:
        """(objtype, id) of changes (a deleted flag, and the columns of the base) that can move a geometry: before they are applied."""
        old = self.nodes.read().select("id", F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat")).hint("merge")
        nodes = changed.filter("objtype = 'n'").join(old, "id", "left").filter("deleted OR NOT (lon <=> b_lon AND lat <=> b_lat)").select("objtype", "id")
        return nodes.unionByName(changed.filter("objtype <> 'n'").select("objtype", "id"))

    def refresh(self, moved: DataFrame, steps: Steps) -> tuple[int, int]:
        """Compute again what hangs on `moved` (a small table, saved before the base changed), once it is applied; how many ways and relations that were."""
        moved = unsent(moved)
        ids = lambda t: moved.filter(F.col("objtype") == t).select("id")
        now, nodes, ways, relations = self.state(), self.nodes.read(), self.ways.read(), self.relations.read()
        hit = unsent(steps.keep(shapes.dirty(ways, relations, ids("n"), ids("w"), ids("r"))))

        def written(table: KeyedTable, t: str, objects: DataFrame, listed: str, made) -> int:
            own = hit.filter(F.col("objtype") == t).select("id")
            there = unsent(steps.keep(objects.join(own, "id", "left_semi")), F.size(listed))  # the whole table is read once
            rows = own.join(made(there), "id", "left").join(there.select("id", F.lit(False).alias("gone")), "id", "left")
            n = table.change(rows.withColumn("gone", F.coalesce("gone", F.lit(True))), now)
            if table.due():
                table.compact()
            return n

        n_ways = written(self.lines, "w", ways, "nodes", lambda some: of_ways(some, nodes))
        return n_ways, written(self.areas, "r", relations, "members", lambda some: of_relations(some, nodes, self.lines.read()))
