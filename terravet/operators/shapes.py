"""Geometry of the base, and of the base overlaid with changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions import polygons


def overlay_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, lon, lat) of every node: a changed node's own place, else the base's; a changed node without a place keeps the base's."""
    changed = changes.filter("objtype = 'n'").select("id", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"), F.lit(True).alias("changed"))
    both = nodes.select("id", "lon", "lat").join(changed, "id", "full")
    return both.select("id", F.coalesce("c_lon", "lon").alias("lon"), F.coalesce("c_lat", "lat").alias("lat"))


def way_vertices(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pos, node, lon, lat) for each reference of each way; unknown nodes have null coordinates."""
    refs = ways.select("id", F.posexplode("nodes").alias("pos", "node"))
    return refs.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node", "left").select("id", "pos", "node", "lon", "lat")


def way_shapes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, geom) of ways (id, nodes); null where no node is known.

    Each reference carries whether its way is a ring, so that the lists of vertices aren't joined to the ways again.
    """
    refs = ways.select("id", G.is_ring(F.col("nodes")).alias("closed"), F.posexplode_outer("nodes").alias("pos", "node"))
    placed = refs.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node", "left").withColumn("p", G.vertex(F.col("lon"), F.col("lat")))
    known = F.when(F.col("p").isNotNull(), F.struct("pos", "p"))
    lists = placed.groupBy("id").agg(F.sort_array(F.collect_list(known)).alias("v"), F.max("closed").alias("closed"))
    return lists.select("id", G.way_line(F.col("v.p"), F.col("closed")).alias("geom"))


def relation_shapes(relations: DataFrame, node_shapes: DataFrame, way_shapes_: DataFrame) -> DataFrame:
    """(id, geom) of relations (id, members): the lines of member ways stitched, member nodes beside; null without any.

    Base and changed relations go by the same rule, so that one without a real change looks unchanged.
    """
    members = relations.select("id", F.posexplode("members").alias("pos", "m")).select("id", "pos", "m.type", "m.ref")
    shapes = node_shapes.select(F.lit("n").alias("type"), F.col("id").alias("ref"), "geom").unionByName(way_shapes_.select(F.lit("w").alias("type"), F.col("id").alias("ref"), "geom"))
    found = members.join(shapes, ["type", "ref"]).filter("geom IS NOT NULL")
    lists = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("geom.parts").alias("parts")))).alias("g"))
    gathered = lists.select("id", G.geometry("collection", F.flatten("g.parts")).alias("geom"))
    return relations.select("id").join(gathered.select("id", G.merged(F.col("geom")).alias("geom")), "id", "left")


def base_shapes(nodes: DataFrame, ways: DataFrame, relations: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(objtype, id, geom) of the base; of its objects in `changes` (objtype, id) only, if they are given, from all that these list."""
    own = lambda df, t: df if changes is None else df.join(changes.filter(F.col("objtype") == t).select("id"), "id", "left_semi")
    points = nodes.select("id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
    relations = own(relations, "r")
    if changes is not None:
        members = relations.select(F.explode("members").alias("m")).filter("m.type = 'w'").select(F.col("m.ref").alias("id"))
        ways = ways.join(members.union(changes.filter("objtype = 'w'").select("id")).distinct(), "id", "left_semi")
    lines = way_shapes(ways, nodes)
    areas = relation_shapes(relations, points, lines)
    tag = lambda df, t: df.select(F.lit(t).alias("objtype"), "id", "geom")
    return tag(own(points, "n"), "n").unionByName(tag(own(lines, "w"), "w")).unionByName(tag(areas, "r"))


def change_shapes(nodes: DataFrame, ways: DataFrame, relations: DataFrame, changes: DataFrame) -> DataFrame:
    """(objtype, id, geom) of each change, over the base overlaid with all changes.

    A deleted way has no geometry; a deleted relation without members takes the base's.
    """
    listed = changes.filter("objtype = 'w' AND NOT deleted").select(F.explode("nodes").alias("id"))
    points = changes.filter("objtype = 'n'").select("id", G.point(F.col("lon"), F.col("lat")).alias("geom"))
    changed = changes.filter("objtype = 'w'").select("id", "nodes", "deleted")
    new = changes.filter("objtype = 'r'").select("id", "members", "deleted")
    old = relations.select("id", F.col("members").alias("old"))
    own = new.join(old, "id", "left").select("id", F.when(F.col("deleted") & (F.coalesce(F.size("members"), F.lit(0)) <= 0), F.col("old")).otherwise(F.col("members")).alias("members"))
    members = own.select(F.explode("members").alias("m")).select("m.type", F.col("m.ref").alias("id"))
    wanted = members.filter("type = 'w'").select("id").distinct()
    rest = ways.select("id", "nodes").join(changed.select("id"), "id", "left_anti").unionByName(changed.filter("NOT deleted").select("id", "nodes")).join(wanted, "id", "left_semi")
    # Only nodes that a shape lists are overlaid, not the whole base.
    listed = listed.union(rest.select(F.explode("nodes").alias("id"))).union(members.filter("type = 'n'").select("id")).distinct()
    over = overlay_nodes(nodes.join(listed, "id", "left_semi"), changes)
    lines = way_shapes(changed.filter("NOT deleted"), over)
    lines = changed.select("id").join(lines, "id", "left")
    shapes = way_shapes(rest, over)
    areas = relation_shapes(own, over.select("id", G.point(F.col("lon"), F.col("lat")).alias("geom")), shapes)
    tag = lambda df, t: df.select(F.lit(t).alias("objtype"), "id", "geom")
    return tag(points, "n").unionByName(tag(lines, "w")).unionByName(tag(areas, "r"))


def areas(relations: DataFrame, way_shapes_: DataFrame) -> DataFrame:
    """(id, geom): what the rings of each relation's stitched member ways enclose; inner rings fill, as all are united. A ring that crosses itself doesn't count."""
    lines = relation_shapes(relations, way_shapes_.limit(0), way_shapes_)
    rings = F.filter(F.col("geom.parts"), lambda p: (F.size(p) >= 4) & G.is_closed(p))
    closed = lines.filter("geom IS NOT NULL").select("id", rings.alias("rings")).filter(F.size("rings") > 0)
    return closed.select("id", polygons.area_of(G.geometry("polygon", F.col("rings"))).alias("geom")).filter("geom IS NOT NULL")


def dirty(ways: DataFrame, relations: DataFrame, node_ids: DataFrame, way_ids: DataFrame, relation_ids: DataFrame) -> DataFrame:
    """(objtype, id) of ways and relations whose geometry hangs on changed objects: ways by their nodes, relations by nodes and by all those ways."""
    by_node = ways.select("id", F.explode("nodes").alias("n")).join(node_ids.select(F.col("id").alias("n")).distinct(), "n", "left_semi").select("id")
    hit_ways = way_ids.select("id").union(by_node).distinct()
    keys = node_ids.select(F.lit("n").alias("t"), "id").union(hit_ways.select(F.lit("w").alias("t"), "id")).distinct()
    members = relations.select("id", F.explode("members").alias("m")).select("id", F.col("m.type").alias("t"), F.col("m.ref").alias("ref"))
    by_member = members.join(keys.withColumnRenamed("id", "ref"), ["t", "ref"], "left_semi").select("id")
    hit_relations = relation_ids.select("id").union(by_member).distinct()
    return hit_ways.select(F.lit("w").alias("objtype"), "id").union(hit_relations.select(F.lit("r").alias("objtype"), "id"))
