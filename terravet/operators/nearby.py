"""Which geometries of two tables are near each other: an equi-join on the cells of their segments, and the exact distance of these.

The least distance of two shapes is that of two of their segments; so the join carries segments only, and no geometry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.plans.tables import Steps


#: Segments that `beside` compares with all others first, and the factor by which each further round takes more.
FIRST, MORE, SHARES = 64, 16, 1 << 20


def segments_of(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __s): the segments of shapes (keys, geom)."""
    return shapes.select(*keys, F.explode(G.segment_ends(F.col("geom"))).alias("__s"))


def boxed(segments: DataFrame, size: float, margin: float) -> DataFrame:
    """segments with __box and __level. A long segment stands in a coarser grid, so that none covers many cells."""
    side = lambda f, a, b, name: f(F.col("__s")[a], F.col("__s")[b]).alias(name)
    box = F.struct(side(F.least, "ax", "bx", "min_x"), side(F.least, "ay", "by", "min_y"), side(F.greatest, "ax", "bx", "max_x"), side(F.greatest, "ay", "by", "max_y"))
    return segments.withColumn("__box", box).withColumn("__level", G.level(F.col("__box"), size, margin))


def boxes(shapes: DataFrame, keys: list[str], size: float, margin: float) -> DataFrame:
    """(keys, __s, __box, __level): the segments of shapes (keys, geom) and their boxes."""
    return boxed(segments_of(shapes, keys), size, margin)


def tiles(segments: DataFrame, keys: list[str], size: float, margin: float, levels: Column) -> DataFrame:
    """(keys, __s, __at, __cell): the cells of each segment in the grids of these levels."""
    each = segments.select(*keys, "__s", "__box", F.explode(levels).alias("__at"))
    return each.select(*keys, "__s", "__at", F.explode(G.cells(F.col("__box"), size, margin, F.col("__at"))).alias("__cell"))


def met(a: DataFrame, b: DataFrame, within: list[str], reach: float, steps: Steps) -> DataFrame:
    """Pairs of segments of a (within, id, __s) and b (within, o_id, __s, which becomes __o) at most `reach` apart; some come twice.

    Of two segments near each other, one's grid is no finer than the other's: each segment stands in its own grid, and is
    looked for in those of the other table that are coarser.
    """
    size, keys, others = max(reach, 1e-9) * 2, ["id", *within], ["o_id", *within]
    first, second = steps.keep(boxed(a, size, reach)), steps.keep(boxed(b, size, reach))
    used = lambda df: sorted(r[0] for r in df.select("__level").distinct().collect())  # noqa: E731  # a few numbers
    above = lambda known, equal: F.filter(F.array(*[F.lit(x) for x in known]).cast("array<int>"), lambda x: (x >= F.col("__level")) if equal else (x > F.col("__level")))
    in_first, in_second = used(first), used(second)
    own = lambda df, k, margin: tiles(df, k, size, margin, F.array("__level"))
    on, other = [*within, "__at", "__cell"], lambda df: df.withColumnRenamed("__s", "__o")
    joined = lambda x, y: x.join(other(y), on).select(*within, "id", "o_id", "__s", "__o")
    pairs = joined(tiles(first, keys, size, reach, above(in_second, True)), own(second, others, 0.0))
    pairs = pairs.unionByName(joined(own(first, keys, reach), tiles(second, others, size, 0.0, above(in_first, False))))
    return pairs.filter(G.segment_boxes_within(F.col("__s"), F.col("__o"), reach)).filter(G.segments_within(F.col("__s"), F.col("__o"), reach))


def near(a: DataFrame, b: DataFrame, within: list[str], reach: float, steps: Steps, ordered: bool = False) -> DataFrame:
    """(within, id, o_id) of shapes of a and b (id, geom, and the columns `within`, which have to be equal) at most `reach` apart.

    ordered: only pairs with id below o_id, for a table and itself.
    """
    keys = ["id", *within]
    pairs = met(segments_of(a, keys), segments_of(b, keys).withColumnRenamed("id", "o_id"), within, reach, steps)
    if ordered:
        pairs = pairs.filter("id < o_id")
    return steps.keep(pairs.select(*within, "id", "o_id").distinct())


def links(shapes: DataFrame, within: list[str], reach: float, steps: Steps) -> DataFrame:
    """(a, b) of shapes (id, geom, within) that link the same shapes as all pairs at most `reach` apart would.

    Each different segment is looked for once, under the least id of those that have it; the others are linked with that one. So shapes
    that lie on each other give a link each, not pairs.
    """
    each = steps.keep(segments_of(shapes, ["id", *within]).distinct())
    on = [*within, "__s"]
    first = steps.keep(each.groupBy(*on).agg(F.min("id").alias("id")))
    same = each.withColumnRenamed("id", "a").join(first, on).select("a", F.col("id").alias("b"))
    apart = met(first, first.withColumnRenamed("id", "o_id"), within, reach, steps).select(F.col("id").alias("a"), F.col("o_id").alias("b"))
    return steps.keep(same.union(apart).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def beside(a: DataFrame, b: DataFrame, reach: float, steps: Steps) -> DataFrame:
    """(id) of shapes of b (id, geom) with one of a (geom) at most `reach` apart.

    Shapes of b that a few segments of a tell of already go to no further round; what is left meets more of them each time, and
    in the end all. Each different segment is looked for once.
    """
    known = steps.keep(segments_of(a, []).distinct().withColumn("__r", F.pmod(F.xxhash64("__s"), F.lit(SHARES))))
    left, done, share, found = steps.keep(segments_of(b, ["id"]).distinct()), 0, FIRST / max(known.count(), 1), []
    while done < SHARES:
        upto = min(SHARES, max(done + 1, int(share * SHARES)))
        some = known.filter((F.col("__r") >= done) & (F.col("__r") < upto)).select(F.lit(0).alias("id"), "__s")
        pairs = met(some, left.select("__s").distinct().withColumn("o_id", F.lit(0)), [], reach, steps)
        hit = pairs.select(F.col("__o").alias("__s")).distinct()
        found.append(steps.keep(left.join(hit, "__s", "left_semi").select("id").distinct()))
        done, share = upto, share * MORE
        if done < SHARES:
            left = steps.keep(left.join(found[-1], "id", "left_anti"))
            if left.isEmpty():
                break
    return reduce(lambda x, y: x.union(y), found)
