"""The PBF data source: round trips, splits, and a block by hand."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravet.sources import pbf

COLUMNS = [x.split()[0] for x in pbf.SCHEMA.split(", ")]


def rows():
    rng, when = random.Random(3), datetime(2024, 2, 3, 4, 5, 6)
    some = lambda: {rng.choice("abcdé"): rng.choice(["1", "yes", "", "長い"]) for _ in range(rng.randint(0, 3))}
    out = [("n", i * 7 - 300, 1 + i % 3, i, when, i % 5, f"user{i % 4}", some(), round(rng.uniform(-180, 180), 7), round(rng.uniform(-90, 90), 7), None, None) for i in range(900)]
    out += [("w", i + 1, 2, 9, when, 3, "é", some(), None, None, [rng.randint(-5, 10**12) for _ in range(rng.randint(0, 40))], None) for i in range(300)]
    out += [("r", i + 1, 5, 1, when, 1, "r", some(), None, None, None, [{"ref": rng.randint(1, 10**10), "role": rng.choice(["", "outer"]), "type": rng.choice("nwr")} for _ in range(rng.randint(0, 9))]) for i in range(80)]
    return out


def plain(df):
    return sorted(str([sorted(v.items()) if isinstance(v, dict) else v for v in (r[c] for c in COLUMNS)]) for r in df.withColumn("members", F.to_json("members")).collect())


@pytest.fixture(scope="module")
def objects(spark):
    return spark.createDataFrame(rows(), pbf.SCHEMA).repartition(4)


def test_what_is_written_comes_back(spark, objects, tmp_path, monkeypatch):
    monkeypatch.setattr(pbf, "BLOCK", 100)
    path = str(tmp_path / "out")
    pbf.write(objects, path)
    back = pbf.read(spark, path)
    empty = lambda df: df.withColumns({"nodes": F.when(F.col("objtype") == "w", F.coalesce("nodes", F.array().cast("array<long>"))), "members": F.when(F.col("objtype") == "r", F.col("members"))})
    assert plain(empty(back)) == plain(empty(objects))
    assert pbf.read(spark, path + "/" + sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".pbf")[0]).count() > 0
    assert back.filter("objtype = 'w'").count() == 300


def test_a_file_is_split_by_blobs(spark, objects, tmp_path, monkeypatch):
    path = str(tmp_path / "one.osm.pbf")
    all_rows = [r.asDict(recursive=True) for r in objects.orderBy("objtype", "id").collect()]
    with open(path, "wb") as f:
        f.write(pbf.header())
        for kind in "nwr":
            own = [r for r in all_rows if r["objtype"] == kind]
            for a in range(0, len(own), 50):
                f.write(pbf.block_of(own[a : a + 50]))
    monkeypatch.setattr(pbf, "SPLIT", 5000)
    parts = pbf.Reader(path).partitions()
    assert len(parts) > 5 and sum(len(p.at) for p in parts) == 18 + 6 + 2
    assert pbf.read(spark, path).groupBy("objtype").count().count() == 3 and pbf.read(spark, path).count() == 1280


def test_numbers():
    xs = [0, 1, 127, 128, 300, 2**31, 2**62, 2**63 - 1]
    data = b"".join(map(pbf.coded, xs))
    assert pbf.numbers([data]).tolist() == xs and pbf.numbers(None).tolist() == []
    signed = [0, -1, 5, -(2**40), 2**50, -7]
    assert pbf.numbers([b"".join(map(pbf.coded, pbf.deltas(signed)))], True, True).tolist() == signed
    assert pbf.numbers([b"".join(pbf.coded(pbf.signed(x)) for x in signed)], True).tolist() == signed and np.array_equal([pbf.zigzag(pbf.signed(x)) for x in signed], signed)


def test_plain_nodes_offsets_and_header(tmp_path):
    """A block by hand: a node that isn't dense, a coarse grid with an offset, no information; and a header with its state."""
    table = pbf.chunk(1, b"") + pbf.chunk(1, b"k") + pbf.chunk(1, b"v")
    node = pbf.number(1, pbf.signed(-5)) + pbf.packed(2, [1]) + pbf.packed(3, [2]) + pbf.number(8, pbf.signed(3)) + pbf.number(9, pbf.signed(-4))
    data = pbf.chunk(1, table) + pbf.chunk(2, pbf.chunk(1, node)) + pbf.number(17, 1000) + pbf.number(19, 10**9) + pbf.number(20, -(10**9))
    (row,) = pbf.Block(data).rows()
    assert (row["id"], row["lat"], row["lon"], row["tags"], row["version"], row["username"]) == (-5, 1.000003, -1.000004, [("k", "v")], None, None)
    path = str(tmp_path / "state.osm.pbf")
    with open(path, "wb") as f:
        f.write(pbf.framed("OSMHeader", pbf.chunk(4, b"OsmSchema-V0.6") + pbf.number(32, 1700000000) + pbf.number(33, 42) + pbf.chunk(34, b"http://example.org/")))
    state = pbf.replication(path)
    assert state["sequence_number"] == 42 and state["base_url"] == "http://example.org/" and state["timestamp"].year == 2023
    with pytest.raises(ValueError, match="raw or zlib"):
        pbf.inflated(pbf.chunk(4, b"x"))
