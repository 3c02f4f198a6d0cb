"""The base as one table, and the views that entity queries read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.schemas import BASE

AREA_OFFSET = 3_600_000_000


def typed(df: DataFrame, objtype: str | None = None) -> DataFrame:
    """Columns of schemas.BASE in their types, those that are missing as nulls."""
    cols = []
    for f in BASE.fields:
        if f.name == "objtype" and objtype:
            cols.append(F.lit(objtype).alias("objtype"))
        else:
            cols.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def base_view(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """All objects with their type n, w or r."""
    return reduce(lambda a, b: a.unionByName(b), [typed(nodes, "n"), typed(ways, "w"), typed(relations, "r")])


def area_predicate(nodes: Column) -> Column:
    """A way that may stand for an area: a ring of at least four references."""
    return F.coalesce((F.size(nodes) >= 4) & (F.get(nodes, F.lit(0)) == F.get(nodes, F.size(nodes) - 1)), F.lit(False))


def entity_views(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """node, way, relation, nwr and area; the user's name and id are masked. Areas are rings and relations, relations offset in id."""
    masked = base_view(nodes, ways, relations).withColumn("username", F.lit(None).cast("string")).withColumn("uid", F.lit(None).cast("int"))
    by = {name: masked.filter(F.col("objtype") == t) for name, t in (("node", "n"), ("way", "w"), ("relation", "r"))}
    rings = by["way"].filter(area_predicate(F.col("nodes")))
    areas = rings.unionByName(by["relation"].withColumn("id", F.col("id") + F.lit(AREA_OFFSET)))
    return by | {"nwr": masked, "area": areas}


def register(views: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
