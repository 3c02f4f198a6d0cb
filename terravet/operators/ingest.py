"""Bringing base extracts and change batches in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.schemas import OBJECT_KEY


def merge_extracts(*extracts: DataFrame, keep_latest: bool = False) -> DataFrame:
    """Several extracts as one. Rows of the same id and version are one; keep_latest: only the latest version of an id."""
    rows = reduce(lambda a, b: a.unionByName(b), extracts).dropDuplicates(["id", "version"])
    return last_of(rows, ["id"], F.col("version")) if keep_latest else rows


def last_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key with the greatest order; combined on the map side, so that a key of many rows isn't gathered."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("last")).select("last.*")


def simplify(batch: DataFrame, *order: Column) -> DataFrame:
    """The last state of each object in a batch of changes, by version and then the given order."""
    return last_of(batch, OBJECT_KEY, F.col("version"), *order)


def import_changes(queue: DataFrame, batch: DataFrame, insert_order: str = "insert_order") -> DataFrame:
    """The queue with a batch written over it: for each object the last row by arrival, whatever its version.

    What stages had worked out about a replaced change goes with it.
    """
    last = last_of(batch, OBJECT_KEY, F.col(insert_order)).drop(insert_order)
    cleared = {"targeted": F.lit(False), "locha_id": F.lit(None).cast("long"), "cc_id": F.lit(None).cast("long")}
    fresh = last.withColumns({c: cleared[c] if c in cleared else F.lit(None).cast(queue.schema[c].dataType) for c in queue.columns if c in cleared or c not in last.columns})
    return queue.join(fresh, OBJECT_KEY, "left_anti").unionByName(fresh.select(queue.columns))


def prune_unknown_deletes(queue: DataFrame, base: DataFrame) -> DataFrame:
    """The queue without deletes of objects that the base doesn't have."""
    known = base.select(*OBJECT_KEY).hint("merge")  # never gathered: of the keys in its files Spark guesses far too little
    gone = queue.filter("deleted").join(known, OBJECT_KEY, "left_anti").select(*OBJECT_KEY)
    return queue.join(gone, OBJECT_KEY, "left_anti")


def same_sequence(states: DataFrame) -> DataFrame:
    """One row: whether all extracts (sequence_number) stand at one sequence, and how many there are."""
    n = F.count_distinct("sequence_number")
    return states.agg((n <= 1).alias("consistent"), n.alias("sequences"))
