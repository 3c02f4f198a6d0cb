"""dbscan_queue against clusters by brute force over all pending nodes."""

import math

import pytest
from test_catalogue import DATA

from terravet.plans import catalogue
from terravet.sources.warehouse import CREATED, Warehouse

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


def test_created_nodes_are_clustered(spark):
    rows = catalogue.queue_of(Warehouse(spark, str(DATA))).filter("objtype = 'n' AND NOT deleted").select("id", "lon", "lat").collect()
    cluster = {r["id"]: r["id"] for r in rows}
    cell = lambda v: math.copysign(math.floor(abs(v) / 60 + 0.5), v)
    near = lambda a, b: cell(a["lon"]) == cell(b["lon"]) and cell(a["lat"]) == cell(b["lat"]) and (a["lon"] - b["lon"]) ** 2 + (a["lat"] - b["lat"]) ** 2 <= 36
    for i, a in enumerate(rows):
        for b in rows[:i]:
            x, y = sorted((cluster[a["id"]], cluster[b["id"]]))
            if x != y and near(a, b):
                cluster = {k: x if c == y else c for k, c in cluster.items()}
    assert sum(i >= CREATED for i in cluster) > 50
    got = catalogue.QUERIES["dbscan_queue"](spark, str(DATA)).collect()
    assert {r["id"]: r["cluster"] for r in got} == cluster and len(got) == len(cluster)
