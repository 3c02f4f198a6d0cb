"""The registered query line_merge against stitching by hand, over every relation of the smallest tables."""

from collections import Counter, defaultdict

import duckdb
import pytest
from test_catalogue import DATA

from terravet.plans.catalogue import QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


def place(node):
    return float(node * 37 % 360 - 180), float(node * 17 % 170 - 85)


def stitched(lines):
    """Lines and vertices after pairs of ends at one place, which no third end shares, are joined: each join that isn't within one line makes one line and one vertex fewer."""
    ends = defaultdict(list)
    for i, line in enumerate(lines):
        if len(line) > 1 and line[0] != line[-1]:
            for end in (line[0], line[-1]):
                ends[end].append(i)
    up = list(range(len(lines)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    joined = 0
    for met in ends.values():
        if len(met) == 2 and (a := find(met[0])) != (b := find(met[1])):
            up[a] = b
            joined += 1
    return len(lines) - joined, sum(map(len, lines)) - joined


def by_hand():
    """Lines and vertices of every relation."""
    rows = duckdb.sql(f"SELECT o_custkey, o_orderkey, l_partkey FROM '{DATA}/lineitem.parquet' JOIN '{DATA}/orders.parquet' ON o_orderkey = l_orderkey JOIN '{DATA}/customer.parquet' ON c_custkey = o_custkey JOIN '{DATA}/part.parquet' ON p_partkey = l_partkey ORDER BY o_custkey, o_orderkey, l_linenumber, l_partkey").fetchall()
    ways = defaultdict(lambda: defaultdict(list))
    for relation, way, node in rows:
        if (at := place(node)) not in ways[relation][way][-1:]:
            ways[relation][way].append(at)
    return {relation: stitched(list(w.values())) for relation, w in ways.items()}


def test_every_relation_is_stitched(spark):
    got = {r["id"]: (r["lines"], r["vertices"]) for r in QUERIES["line_merge"](spark, str(DATA)).collect()}
    assert len(got) > 50 and got == by_hand()
