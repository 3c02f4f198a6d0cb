"""Metadata of edit sessions: which to fetch, and writing what was fetched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.functions import scalars

#: Ids asked for at a time.
BATCH = 100


def missing(base: DataFrame, queue: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """(id) of changesets to fetch: of pending changes if unknown, open, or older than their waiting time; of base objects that have a pending change if unknown or open."""
    sets = known.select(F.col("id").cast("long").alias("changeset_id"), "open", "created_at", "updated_at", F.lit(True).alias("known"))
    unknown = F.col("known").isNull() | F.coalesce("open", F.lit(False))
    waited = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))
    old = waited >= scalars.refresh_after(F.col("created_at"), F.col("updated_at"))
    of = lambda df: df.select(F.col("changeset_id").cast("long").alias("changeset_id")).filter("changeset_id IS NOT NULL").distinct().join(sets, "changeset_id", "left")
    pending = of(queue).filter(unknown | old).select(F.col("changeset_id").alias("id"))
    behind = of(base.join(queue.select("objtype", "id"), ["objtype", "id"], "left_semi")).filter(unknown).select(F.col("changeset_id").alias("id"))
    return pending.union(behind).distinct()


def fetched(ids: DataFrame, provider: Callable[[list[int]], pd.DataFrame], schema: str) -> DataFrame:
    """What a provider gives for the ids, BATCH at a time, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                yield provider(pdf["id"].iloc[at : at + BATCH].tolist())

    return ids.mapInPandas(run, schema)


def looked_up(ids: DataFrame, source: DataFrame) -> DataFrame:
    """The provider of a place without network: rows of a table."""
    return source.join(ids, "id", "left_semi")


def upserted(known: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """known with the rows of new over it, updated now."""
    fresh = new.withColumn("updated_at", now.cast(known.schema["updated_at"].dataType)).select(known.columns)
    return known.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
