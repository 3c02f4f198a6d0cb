"""Logical changes: pending changes clustered by place and topology, under ids that last while their members do."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.functions import scalars
from terravet.operators import nearby
from terravet.operators.graph import components
from terravet.plans.tables import Steps
from terravet.schemas import OBJECT_KEY

#: Parts of one cluster at most, and rounds of splitting; the radius in distances, the cell in distances.
MOST, ROUNDS, RADIUS, CELL = 99, 5, 20, 100
#: Points that k-means is given at a time; a larger cluster is cut by a grid of that radius first, and by finer ones.
POINTS, HALVINGS = 5000, 16


def clustering_input(rows: DataFrame, projection: G.Projection) -> DataFrame:
    """(cc_id, geom): the shapes after and before of each component's changes, together and in the plane; null without any.

    They stand in the order of the changes' keys, after before before, since the point on the surface is that of the first of the longest.
    """
    shapes = rows.select("cc_id", *OBJECT_KEY, F.posexplode(F.array("geom", "b_geom")).alias("side", "g"))
    some = F.when(F.col("g").isNotNull(), F.struct(*OBJECT_KEY, "side", projection.geometry(F.col("g"))["parts"].alias("parts")))
    lists = shapes.groupBy("cc_id").agg(F.sort_array(F.collect_list(some)).alias("l"))
    parts = lists.select("cc_id", F.transform("l", lambda s: s["parts"]).alias("p"))
    return parts.select("cc_id", F.when(F.size(F.flatten("p")) > 0, G.geometry("collection", F.flatten("p"))).alias("geom"))


def linked_clusters(shapes: DataFrame, distance: float, steps: Steps) -> DataFrame:
    """(id, cluster): shapes (id, cell, geom) linked within a cell by steps of at most distance; a lone one is its own."""
    shapes = steps.keep(shapes)
    found = components(nearby.links(shapes, ["cell"], distance, steps), steps)
    return shapes.select("id").join(found.select(F.col("v").alias("id"), F.col("component").alias("cluster")), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def kmeans(points: np.ndarray, k: int, radius: float, rounds: int = 20) -> np.ndarray:
    """Labels of k groups, more if one is wider than the radius; begun from points far apart, so that runs agree."""
    while True:
        centres = [points.mean(axis=0)]
        centres[0] = points[np.argmin(((points - centres[0]) ** 2).sum(axis=1))]
        while len(centres) < k:
            far = np.min([((points - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(points[int(np.argmax(far))])
        c = np.array(centres)
        for _ in range(rounds):
            label = np.argmin(((points[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
            new = np.array([points[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
            if np.array_equal(new, c):
                break
            c = new
        reach = np.sqrt(((points - c[label]) ** 2).sum(axis=1)).max()
        if reach <= radius or k >= len(points):
            return label
        k += 1


def cut(points: DataFrame, distance: float, most: int) -> DataFrame:
    """points with tile: clusters of more than `most` points are cut into the coarsest cells that hold no more.

    Cells are a part's diameter wide at most, as parts have no larger radius. Where more points than `most` stand in the
    finest cell, they are dealt by the md5 of their ids, which any engine has.
    """
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"))
    counted = points.join(sizes, "cluster")
    whole = counted.filter(F.col("__n") <= most).select(*points.columns, F.lit(None).cast("string").alias("tile"))
    side = lambda k: F.lit(2.0 * RADIUS * distance) / F.pow(F.lit(2.0), k)
    name = lambda k: F.concat_ws(":", k, F.floor(F.col("x") / side(k)), F.floor(F.col("y") / side(k)))
    large = counted.filter(F.col("__n") > most).select(*points.columns)
    tiles = large.select("id", "cluster", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("k"), "x", "y").withColumn("tile", name(F.col("k")))
    full = tiles.groupBy("cluster", "tile").agg(F.count(F.lit(1)).alias("n"))
    fit = tiles.join(full, ["cluster", "tile"]).filter((F.col("n") <= most) | (F.col("k") == HALVINGS))
    first = fit.groupBy("id").agg(F.min_by(F.struct("tile", "n"), "k").alias("t"))
    share = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    dealt = F.concat_ws(":", "t.tile", F.when(F.col("t.n") > most, F.pmod(share, F.ceil(F.col("t.n") / most))))
    return whole.unionByName(large.join(first, "id").withColumn("tile", dealt).select(*points.columns, "tile"))


def split_large(points: DataFrame, distance: float, most: int = MOST, rounds: int = ROUNDS, at_once: int = POINTS) -> DataFrame:
    """(id, cluster, part) of points (id, cluster, x, y): clusters of more than `most` split by k-means, again while they are too large.

    Clusters of more than `at_once` points are cut in tiles first, so that no task is given more; tiles are numbered, and parts within their tile.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        xy, labels = pdf[["x", "y"]].to_numpy(float), np.zeros(len(pdf), np.int64)
        for round_ in range(rounds):
            names, sizes = np.unique(labels, return_counts=True)
            large = names[sizes > most] if round_ else names
            if not len(large):
                break
            for name in large:
                own = np.flatnonzero(labels == name)
                part = kmeans(xy[own], -(-len(own) // most), RADIUS * distance)
                labels[own] = np.where(part == 0, name, labels.max() + part)
        return pd.DataFrame({"id": pdf["id"], "cluster": pdf["cluster"], "part": labels + (int(pdf["number"].iloc[0]) << 31)})

    tiled = Steps(points.sparkSession, "tiles").keep(cut(points, distance, at_once))
    numbers = renumbered(tiled.filter("tile IS NOT NULL").select("cluster", "tile").distinct(), "cluster", "tile")
    rows = tiled.filter("tile IS NULL").withColumn("number", F.lit(0).cast("long")).unionByName(tiled.join(numbers, ["cluster", "tile"]).select(*tiled.columns, F.col("number").cast("long")))
    return rows.groupBy("cluster", "number").applyInPandas(split, "id long, cluster long, part long")


def glued(groups: DataFrame, rows: DataFrame, steps: Steps) -> DataFrame:
    """(cc_id, main): groups (cc_id, g) put together, again and again, where a way of one lists a node object of another."""
    named = rows.join(groups, "cc_id")
    refs = named.filter("objtype = 'w'").select("g", F.explode("nodes").alias("node")).filter("node IS NOT NULL").distinct()
    own = named.filter("objtype = 'n'").select(F.col("g").alias("o"), F.col("id").alias("node"))
    pairs = refs.join(own, "node").filter("g <> o").select(F.col("g").alias("a"), F.col("o").alias("b")).distinct()
    found = components(pairs, steps).select(F.col("v").alias("g"), F.col("component").alias("main"))
    return groups.join(found, "g", "left").select("cc_id", F.coalesce("main", "g").alias("main"))


def renumbered(df: DataFrame, *keys: str, name: str = "number") -> DataFrame:
    """df with a dense number for each distinct key, from 1, in the order of the keys; a null key comes last.

    The distinct keys are ranked within ranges; over the ranges, of which there are as many as partitions, their sizes are added up.
    """
    steps = Steps(df.sparkSession, "numbers")
    order = [F.col(k).asc_nulls_last() for k in keys]
    ranged = df.select(*keys).distinct().repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    known = steps.keep(ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order))))
    sizes = known.groupBy("__p").agg(F.max("__n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = known.join(F.broadcast(sizes.select("__p", before.alias("__before"))), "__p").select(*keys, (F.col("__n") + F.col("__before")).alias(name))
    ranked = ranked.toDF(*[f"__{k}" for k in keys], name)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(ranked[f"__{k}"]) for k in keys])
    return df.join(ranked, same).select(*[df[c] for c in df.columns if c != name], ranked[name])


def signatures(rows: DataFrame, key: str) -> DataFrame:
    """(key, signature): the sorted objtype|id|version|deleted of a group's changes, joined by commas."""
    one = scalars.signature(F.col("objtype"), F.col("id"), F.col("version"), F.col("deleted"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("objtype", "id", one.alias("s")))).alias("l"))
    return lists.select(key, F.array_join(F.transform("l", lambda x: x["s"]), ",").alias("signature"))


def stable_id(signature: Column) -> Column:
    """A 32-bit id of a signature: the same while the members and their versions are."""
    return scalars.wrap_int32(F.crc32(signature.cast("binary")))


def stable_id_of(signature: str) -> int:
    x = zlib.crc32(signature.encode())
    return x - (1 << 32) if x >= 1 << 31 else x


def assign_locha(rows: DataFrame, distance: float, steps: Steps, projection: G.Projection | None = None) -> DataFrame:
    """(objtype, id, locha_id) of the pending changes rows (objtype, id, version, deleted, cc_id, nodes, geom, b_geom).

    Components without any geometry are each a logical change of its own.
    """
    shapes = steps.keep(clustering_input(rows, projection or G.Projection()).filter("geom IS NOT NULL"))
    at = steps.keep(shapes.withColumn("p", G.point_on_surface("geom")))
    size = max(CELL * distance, 1e-9)
    cell = F.struct(F.round(F.col("p.x") / size).cast("long").alias("x"), F.round(F.col("p.y") / size).cast("long").alias("y"))
    placed = at.select(F.col("cc_id").alias("id"), cell.alias("cell"), "geom")
    clusters = linked_clusters(placed, distance, steps)
    points = at.select(F.col("cc_id").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y")).join(clusters, "id")
    parts = split_large(points.select("id", "cluster", "x", "y"), distance)
    first = Window.partitionBy("cluster", "part")
    groups = parts.withColumn("g", F.min("id").over(first)).select(F.col("id").alias("cc_id"), "g")
    alone = rows.select("cc_id").distinct().join(groups, "cc_id", "left_anti").select("cc_id", F.col("cc_id").alias("g"))
    main = steps.keep(glued(steps.keep(groups.unionByName(alone)), rows, steps))
    named = rows.select(*OBJECT_KEY, "version", "deleted", "cc_id").join(main, "cc_id")
    ids = signatures(named, "main").select("main", stable_id(F.col("signature")).alias("locha_id"))
    return named.join(ids, "main").select(*OBJECT_KEY, "locha_id")

