"""Objects of one kind that stand close together, before and after a logical change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.functions.tags import Rules


def _cells(x: Column, y: Column, size: Column, around: bool) -> Column:
    """Grid cells of a point, with those around it or alone; the cell is as wide as the distance."""
    cx, cy = F.floor(x / size), F.floor(y / size)
    if not around:
        return F.array(F.struct(cx.alias("cx"), cy.alias("cy")))
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def close_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a beside rows of b (its columns prefixed with o_) with equal keys (null-safe) and not further apart than a's distance.

    a and b: keys, x, y, distance. The join is on keys and grid cells, so that no cell meets all others.
    """
    near = a.withColumn("cell", F.explode(_cells(F.col("x"), F.col("y"), F.col("distance"), True)))
    other = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns]).withColumn("o_cell", F.explode(_cells(F.col("o_x"), F.col("o_y"), F.col("o_distance"), False)))
    on = F.col("cell") == F.col("o_cell")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    apart = F.pow(F.col("x") - F.col("o_x"), F.lit(2)) + F.pow(F.col("y") - F.col("o_y"), F.lit(2))
    return near.join(other, on).filter(apart <= F.col("distance") * F.col("distance")).drop("cell", "o_cell")


def matching(points: DataFrame, rules: Rules) -> DataFrame:
    """points (objtype, id, tags, x, y, ...) of the rules, with the first rule's index and distance, and the level."""
    rows = points.withColumns({"index": rules.first_index(F.col("tags")), "distance": rules.first_distance(F.col("tags")), "level": F.col("tags")["level"]})
    return rows.filter("index IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").drop("tags")


def base_candidates(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base objects (objtype, id, index, distance, level, x, y) within reach of a change of their rule and level, with its locha_id.

    An object near several logical changes goes with the smallest id. Places meet places: of changes in one place the smallest id counts,
    and base objects in one place have the same nearest changes.
    """
    place = ["index", "level", "distance", "x", "y"]
    spots = changes.groupBy(*place).agg(F.min("locha_id").alias("locha_id"))
    pairs = close_pairs(spots, base.select(*place).distinct(), ["index", "level"])
    near = pairs.groupBy(*[f"o_{c}" for c in place]).agg(F.min("locha_id").alias("locha_id"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in place])
    one = base.join(near, same).groupBy("objtype", "id", "index").agg(F.min(F.struct("locha_id", "level", "distance", "x", "y")).alias("m"))
    return one.select("objtype", "id", "index", "m.*")


def twins(a: DataFrame, b: DataFrame, more: list[str]) -> DataFrame:
    """(locha_id, index, objtype, id, the columns `more`, count, duplicates) of rows of a: the names of other objects of b of the same logical change, rule and level within reach.

    Names may be as many as pairs, so no pair is shuffled: objects of b are gathered by the cells around them, as places with their names, and meet
    the places of a there. A row holds the names of nine cells, some three times as many as a place in their midst has twins.
    """
    keys = ["locha_id", "index", "level"]
    place = [*keys, "distance", "x", "y"]
    cells = lambda around: F.explode(_cells(F.col("x"), F.col("y"), F.col("distance"), around))
    own = a.groupBy(*place).agg(F.collect_list(F.struct("objtype", "id", *more)).alias("own")).withColumn("cell", cells(False))
    names = b.groupBy(*place).agg(F.collect_list(F.struct(F.col("objtype").alias("t"), F.col("id").alias("i"))).alias("names"))
    around = names.withColumn("cell", cells(True)).groupBy(*keys, "cell").agg(F.collect_list(F.struct("x", "y", "names")).alias("near"))
    on = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in [*keys, "cell"]])
    met = own.join(around.toDF(*[f"o_{k}" for k in [*keys, "cell"]], "near"), on)
    apart = lambda p: F.pow(F.col("x") - p["x"], F.lit(2)) + F.pow(F.col("y") - p["y"], F.lit(2))
    close = F.filter("near", lambda p: apart(p) <= F.col("distance") * F.col("distance"))
    found = F.sort_array(F.flatten(F.transform(close, lambda p: p["names"])))
    told = met.select("locha_id", "index", "own", F.transform(found, lambda s: F.concat(s["t"], s["i"].cast("string"))).alias("l"))
    each = told.select("locha_id", "index", F.explode("own").alias("o"), "l").select("locha_id", "index", "o.*", "l")
    others = each.withColumn("duplicates", F.array_remove("l", F.concat("objtype", F.col("id").cast("string")))).drop("l")
    return others.withColumn("count", F.size("duplicates").cast("long")).filter("count > 0").select("locha_id", "index", "objtype", "id", *more, "count", "duplicates")


def base_counts(candidates: DataFrame) -> DataFrame:
    """(index, objtype, id, count) of neighbours in the base; an object without any counts 1, as an outer join does.

    candidates: an object of a rule once. Places meet places, with the number of objects that stand there, so that objects in one place aren't paired.
    """
    place = ["locha_id", "index", "level", "distance", "x", "y"]
    spots = candidates.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    met = close_pairs(spots, spots, ["locha_id", "index", "level"]).groupBy(*place).agg(F.sum("o_n").alias("n")).toDF(*[f"o_{c}" for c in place], "n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in place])
    # A place meets itself: each object counts the others.
    return candidates.join(met, same).select("index", "objtype", "id", F.greatest(F.col("n") - 1, F.lit(1)).alias("count"))


def change_twins(candidates: DataFrame, changes: DataFrame, alive: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(locha_id, index, objtype, id, more columns of alive, count, duplicates) of changed objects, among base objects and living changes.

    A base object that a change of the same rule touches doesn't count; one that is changed out of the rule still does.
    """
    touched = changes.select("locha_id", "objtype", "id", "index")
    rest = candidates.join(touched, ["locha_id", "objtype", "id", "index"], "left_anti")
    cols = ["locha_id", "objtype", "id", "index", "level", "distance", "x", "y"]
    return twins(alive.select(*cols, *more), rest.select(cols).unionByName(alive.select(cols)), list(more))


def duplicates(base: DataFrame, changes: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    """(locha_id, index, objtype, id, duplicates) of changed objects that came to stand by others of their rule and level.

    base: objtype, id, tags, x, y (planar points). changes: also locha_id and deleted. An object that had neighbours in the
    base is told only if it has more now, and then under its own name; strict: under theirs.
    """
    near = matching(base, rules)
    all_changes = matching(changes, rules)
    candidates = base_candidates(near, all_changes)
    had = base_counts(candidates).select("index", "objtype", "id", F.col("count").alias("had"))
    # What an object had goes with it, so that the names that are found aren't shuffled.
    alive = all_changes.filter("NOT deleted").join(had, ["index", "objtype", "id"], "left")
    more = change_twins(candidates, all_changes, alive, ("had",)).filter("had IS NULL OR count > had")
    own = F.array(F.concat("objtype", F.col("id").cast("string")))
    told = F.col("duplicates") if strict else F.when(F.col("had").isNotNull(), own).otherwise(F.col("duplicates"))
    return more.select("locha_id", "index", "objtype", "id", told.alias("duplicates"))
