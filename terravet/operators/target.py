"""Which changes are of interest, which components they hold, and which changes may go through unreviewed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions.tags import Rules
from terravet.operators import graph, nearby
from terravet.plans.tables import Steps
from terravet.schemas import OBJECT_KEY

#: Whether a geometry column is inside the area of interest.
Area = Callable[[Column], Column]


def everywhere(geom: Column) -> Column:
    return F.lit(True)


def inside_box(min_x: float, min_y: float, max_x: float, max_y: float) -> Area:
    """The area of one box; a geometry without place is inside."""

    def area(geom: Column) -> Column:
        b = G.bbox(geom)
        return geom.isNull() | b.isNull() | ((b["min_x"] <= max_x) & (b["max_x"] >= min_x) & (b["min_y"] <= max_y) & (b["max_y"] >= min_y))

    return area


def inside_polygons(polygons: list | None) -> Area:
    """The united area of polygons from configuration; without any, everywhere. A geometry without place is inside."""
    if not polygons:
        return everywhere
    meets = G.intersects_polygons(polygons)
    return lambda geom: geom.isNull() | F.coalesce(meets(geom), F.lit(True))


def enriched(changes: DataFrame, base: DataFrame, change_geom: DataFrame, base_geom: DataFrame) -> DataFrame:
    """Each change with what it replaces: new, b_tags, b_geom, geom, and nodes and members of before and after together."""
    old = base.select(*OBJECT_KEY, F.lit(True).alias("known"), F.col("tags").alias("b_tags"), F.col("nodes").alias("b_nodes"), F.col("members").alias("b_members"))
    rows = changes.join(change_geom, OBJECT_KEY, "left").join(old, OBJECT_KEY, "left").join(base_geom.withColumnRenamed("geom", "b_geom"), OBJECT_KEY, "left")
    both = lambda b, c: F.when(F.col(b).isNotNull() & F.col(c).isNotNull(), F.concat(b, c)).otherwise(F.coalesce(c, b))
    return rows.withColumns({"new": F.col("known").isNull(), "nodes": both("b_nodes", "nodes"), "members": both("b_members", "members")}).drop("known", "b_nodes", "b_members")


def flags(rows: DataFrame, rules: Rules, area: Area = everywhere) -> DataFrame:
    """enriched rows with targeted and geom_changed."""
    t_before, t_after = rules.predicate(F.col("b_tags")), rules.predicate(F.col("tags"))
    a_before, a_after = area(F.col("b_geom")), area(F.col("geom"))
    scope = (t_before | t_after) & (a_before | a_after)
    moved = ~G.same(F.col("b_geom"), F.col("geom"))
    marked = rows.withColumns({"__scope": F.when(F.col("new"), t_after & a_after).otherwise(scope), "__moved": moved, "__area": a_after})
    tags = rules.changed(F.col("b_tags"), F.col("tags"))
    return marked.withColumns(
        {
            "targeted": F.when(F.col("new"), F.col("__scope")).otherwise(F.col("__scope") & (tags | F.col("__moved"))),
            "geom_changed": F.when(F.col("new"), F.col("__area")).otherwise(F.col("__scope") & F.col("__moved")),
        }
    ).drop("__scope", "__moved", "__area")


def activity(rows: DataFrame) -> DataFrame:
    """flags with propa, active and eligible."""
    return graph.propagated(rows).withColumn("active", F.col("targeted") | F.col("propa")).withColumn("eligible", F.col("active") | F.col("geom_changed"))


def held_components(rows: DataFrame, distance: float, projection: G.Projection | None = None, steps: Steps | None = None) -> DataFrame:
    """(cc_id) of components to hold: those with a targeted change, and those with another change within `distance` of one.

    One step: what is held for being near holds nothing further. Nearness is a join on the cells of segments and an exact distance.
    """
    projection, steps = projection or G.Projection(), steps or Steps(rows.sparkSession, "held")
    placed = rows.select("cc_id", "targeted", projection.geometry(F.col("geom")).alias("geom"), projection.geometry(F.col("b_geom")).alias("b_geom"))
    core = placed.filter("targeted").select("cc_id").distinct()
    shapes = placed.select(F.col("cc_id").alias("id"), F.explode(F.array("geom", "b_geom")).alias("geom")).filter("geom IS NOT NULL")
    shapes, ids = steps.keep(shapes), core.withColumnRenamed("cc_id", "id")
    found = nearby.beside(shapes.join(ids, "id", "left_semi"), shapes.join(ids, "id", "left_anti"), distance, steps)
    return core.union(found.select(F.col("id").alias("cc_id"))).distinct()


def release(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(objtype, id, version, deleted) of the changes whose component isn't held."""
    return rows.join(held, "cc_id", "left_anti").select("objtype", "id", "version", "deleted")


def release_untargeted(base: DataFrame, queue: DataFrame, base_geom: DataFrame, change_geom: DataFrame, rules: Rules, steps: Steps, area: Area = everywhere, distance: float = 0.0, projection: G.Projection | None = None, kept: graph.KeptComponents | None = None) -> tuple[DataFrame, DataFrame]:
    """The queue's flags (objtype, id, targeted, cc_id), and the changes to release."""
    rows = steps.keep(activity(flags(enriched(queue.drop("targeted", "cc_id"), base, change_geom, base_geom), rules, area)))
    rows = steps.keep(rows.join(graph.change_components(rows, steps, kept), OBJECT_KEY))
    return rows.select(*OBJECT_KEY, "targeted", "cc_id"), release(rows, held_components(rows, distance, projection, steps))


def write_back(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue with the columns of found (objtype, id, ...) in place of its own."""
    new = [c for c in found.columns if c not in OBJECT_KEY]
    return queue.drop(*new).join(found, OBJECT_KEY, "left").select(queue.columns)
