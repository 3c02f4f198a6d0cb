"""Connected components of a link table, by contraction: no vertex set or label ever comes to one task or the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in links (a, b), of one orderable type; component is the smallest id that can be reached.

    Each round sends a vertex to the neighbour, or itself, whose hash is smallest, joins the vertices that meet, and goes
    on with the links between what remains. The hash changes by the round, so that a chain of any order shrinks by a
    constant factor; the maps of the rounds are put together at the end. Links from an id to itself and those with a null end say nothing,
    repeated links count once, and without links the result is empty.
    """
    with scratch.inner() as own:
        return scratch.save(contracted(links.filter("a IS NOT NULL AND b IS NOT NULL"), own))


def contracted(links: DataFrame, scratch: Scratch) -> DataFrame:
    edges = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(maps))
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(seed, F.col(c)).alias("h"), F.col(c).alias("id"))
        near = both.groupBy("v").agg(F.least(F.min(rank("w")), F.min(rank("v")))["id"].alias("to"))
        near = scratch.save(near)
        maps.append(near)
        moved = (
            edges.join(near.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
            .join(near.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        edges = scratch.save(moved)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = whole.select(F.col("v").alias("to"), F.col("to").alias("end"))
        whole = scratch.save(earlier.join(later, "to", "left").select("v", F.coalesce("end", "to").alias("to")))
    least = whole.groupBy("to").agg(F.least(F.min("v"), F.col("to")).alias("component"))
    return whole.join(least, "to").select(F.col("v").alias("id"), "component")
