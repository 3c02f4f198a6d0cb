"""Ways that touch: neighbours of changed ways before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravet.functions.tags import Rules

NEIGHBOR = "struct<id:bigint,way_id:bigint,x:double,y:double>"


def touching(ways: DataFrame, others: DataFrame, exclude: DataFrame, nodes: DataFrame) -> DataFrame:
    """(locha_id, id, neighbors): the shared nodes of ways (locha_id, id, nodes) with other ways (id, nodes).

    A neighbour of the same logical change, in exclude (locha_id, way_id), doesn't count. Both node lists are exploded and
    joined on the node.
    """
    own = ways.select("locha_id", "id", F.explode(F.array_distinct("nodes")).alias("node"))
    refs = others.select(F.col("id").alias("way_id"), F.explode(F.array_distinct("nodes")).alias("node"))
    met = own.join(refs, "node").filter("id <> way_id").join(exclude, ["locha_id", "way_id"], "left_anti")
    placed = met.join(nodes.select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y")), "node")
    one = F.struct(F.col("node").alias("id"), "way_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return placed.groupBy("locha_id", "id").agg(F.array_sort(F.collect_set(one)).alias("neighbors"))


def base_neighbors(base_ways: DataFrame, base_nodes: DataFrame, changes: DataFrame, rules: Rules) -> DataFrame:
    """Neighbours in the base of targeted changed ways, deleted ones included."""
    selected = changes.filter(F.col("objtype") == "w").filter(rules.predicate(F.col("tags")))
    pool = base_ways.filter(rules.predicate(F.col("tags")))
    ways = selected.filter("targeted").select("locha_id", "id").join(pool.select("id", "nodes"), "id")
    return touching(ways, pool, selected.select("locha_id", F.col("id").alias("way_id")), base_nodes)


def last_nodes(base_nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, lon, lat, deleted) of nodes as the changes leave them."""
    new = changes.filter("objtype = 'n'").select("id", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"), F.col("deleted").alias("c_deleted"))
    return base_nodes.select("id", "lon", "lat").join(new, "id", "full").select("id", F.coalesce("c_lon", "lon").alias("lon"), F.coalesce("c_lat", "lat").alias("lat"), F.coalesce("c_deleted", F.lit(False)).alias("deleted"))


def last_ways(base_ways: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, nodes, tags, deleted) of ways as the changes leave them."""
    new = changes.filter("objtype = 'w'").select("id", F.col("nodes").alias("c_nodes"), F.col("tags").alias("c_tags"), F.col("deleted").alias("c_deleted"))
    return base_ways.select("id", "nodes", "tags").join(new, "id", "full").select("id", F.coalesce("c_nodes", "nodes").alias("nodes"), F.coalesce("c_tags", "tags").alias("tags"), F.coalesce("c_deleted", F.lit(False)).alias("deleted"))


def change_neighbors(base_ways: DataFrame, base_nodes: DataFrame, changes: DataFrame, rules: Rules) -> DataFrame:
    """Neighbours of targeted changed ways that remain, as the changes leave the network."""
    selected = changes.filter(F.col("objtype") == "w").filter(rules.predicate(F.col("tags"))).filter("NOT deleted")
    pool = last_ways(base_ways, changes).filter("NOT deleted").filter(rules.predicate(F.col("tags")))
    return touching(selected.filter("targeted").select("locha_id", "id", "nodes"), pool, selected.select("locha_id", F.col("id").alias("way_id")), last_nodes(base_nodes, changes))


def network_diff(base_ways: DataFrame, base_nodes: DataFrame, changes: DataFrame, rules: Rules) -> DataFrame:
    """(locha_id, id, base_neighbors, change_neighbors) of ways whose neighbours differ; null for none."""
    b = base_neighbors(base_ways, base_nodes, changes, rules).withColumnRenamed("neighbors", "base_neighbors")
    c = change_neighbors(base_ways, base_nodes, changes, rules).withColumnRenamed("neighbors", "change_neighbors")
    both = b.join(c, ["locha_id", "id"], "full")
    none = F.array().cast(f"array<{NEIGHBOR}>")
    x, y = F.coalesce("base_neighbors", none), F.coalesce("change_neighbors", none)
    return both.filter((F.size(F.array_except(x, y)) > 0) | (F.size(F.array_except(y, x)) > 0))
