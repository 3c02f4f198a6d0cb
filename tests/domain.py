"""Small tables for the scenarios."""

from terravet import schemas
from terravet.operators.views import base_view


def nodes(spark, *rows):
    """(id, tags, lon, lat)"""
    return spark.createDataFrame([(i, 1, 1, None, None, None, t, None if x is None else float(x), None if y is None else float(y)) for i, t, x, y in rows], schemas.NODE)


def ways(spark, *rows):
    """(id, tags, nodes)"""
    return spark.createDataFrame([(i, 1, 1, None, None, None, t, n) for i, t, n in rows], schemas.WAY)


def relations(spark, *rows):
    """(id, tags, members)"""
    return spark.createDataFrame([(i, 1, 1, None, None, None, t, m) for i, t, m in rows], schemas.RELATION)


def changes(spark, *rows):
    """(objtype, id, version, deleted, tags, lon, lat, nodes) and members if there are any"""
    full = []
    for r in rows:
        t, i, v, d, tags, x, y, n = r[:8]
        full.append((t, i, v, d, 1, None, None, None, tags, None if x is None else float(x), None if y is None else float(y), n, r[8] if len(r) > 8 else None, False, 1, None))
    return spark.createDataFrame(full, schemas.CHANGE)


def base(spark, n, w=None, r=None):
    return base_view(n, w if w is not None else ways(spark), r if r is not None else relations(spark))


def ids(df, *cols):
    return sorted(tuple(x[c] for c in cols) if len(cols) > 1 else x[cols[0]] for x in df.collect())


def text(geom):
    """A geometry as well-known text."""
    if geom is None:
        return None
    if geom["kind"] == "point":
        return "POINT({x:g} {y:g})".format(**geom["parts"][0][0].asDict())
    return "LINESTRING(" + ",".join(f"{p['x']:g} {p['y']:g}" for p in geom["parts"][0]) + ")"


