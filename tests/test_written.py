"""Diffs and feeds that executors write; files by number as a stream; validity by a sweep."""

import gzip
import math
import random
import time
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravet.functions import geometry as G
from terravet.operators import apply, export, review
from terravet.plans.project import Project
from terravet.sources import config, osc
from terravet.streaming import replication_stream
from tests import domain as D

NOW = datetime(2024, 1, 1, tzinfo=UTC)


def plain_diff(rows):
    out, action = ['<?xml version="1.0" encoding="UTF-8"?>', '<osmChange version="0.6">'], None
    for r in sorted(rows, key=lambda r: (r["objtype"], r["id"], r["version"])):
        own = "delete" if r["deleted"] else "create" if r["version"] == 1 else "modify"
        if own != action:
            out += ([f"</{action}>"] if action else []) + [f"<{own}>"]
            action = own
        out.append(export.element(r))
    return "\n".join([*out, f"</{action}>", "</osmChange>", ""])


@pytest.mark.parametrize("kinds", [1, 3])
def test_diff_of_many_ranges(spark, tmp_path, kinds):
    """Blocks within a range, over several ranges, and of the whole."""
    rng = random.Random(kinds)
    rows = D.changes(spark, *[("n", i, 1 if kinds == 1 else (i // 40) % 2 + 1, kinds == 3 and i // 100 % 2 == 0, {"a": f'x & "{i}"'}, i % 7, 2, None) for i in rng.sample(range(1000), 400)])
    path = tmp_path / "1.osc.gz"
    assert export.write_osc(rows.repartition(7), f"file://{path}")
    assert gzip.decompress(path.read_bytes()).decode() == plain_diff([r.asDict(recursive=True) for r in rows.collect()])
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["1.osc.gz"]
    assert "Local" not in export.write_osc.__code__.co_names


def test_feed(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 9) if i != 5 else None, None if i == 7 else 1.0 * i, 2.0, 3.0, 4.0, [f'{{"a<&>": {i}}}'] if i % 2 else []) for i in range(30)]
    df = spark.createDataFrame(rows, "locha_id long, created timestamp_ntz, min_x double, min_y double, max_x double, max_y double, features array<string>")
    path = tmp_path / "feed.atom"
    review.write_atom(df.repartition(5), "a & b", "http://example.org/?a=1&b=2", f"file://{path}")
    found = [r.asDict() for r in df.orderBy("created", "locha_id").collect()]
    assert path.read_text() == review.atom(found, "a & b", "http://example.org/?a=1&b=2") + "\n"


def test_old_versions_go(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in range(5):
        apply.set_aside(spark.range(n), path)
    apply.forget(spark, path, keep=2)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["v4", "v4.current", "v5", "v5.current"]
    assert apply.current(spark, path).count() == 4


class Kept(Project):
    """A project that only imports, to be quick."""

    def update(self, batch, provider, now):
        self.taken = [*getattr(self, "taken", []), sorted((r["id"], r["version"]) for r in batch.collect())]
        self.import_changes(batch)


def served(spark, folder, numbers):
    for n in numbers:
        at = f"{folder}/server/{osc.State(n, NOW).path}"
        export.write_osc(D.changes(spark, ("n", 1, n, False, {"a": str(n)}, 0, 0, None), ("n", 100 + n, 1, False, None, 1, 1, None)), f"file://{at}.osc.gz")
        Path(f"{at}.state.txt").write_text(osc.State(n, NOW).text())
        time.sleep(0.02)


def test_a_stream_of_files_goes_on_where_it_stopped(spark, settings):
    p = Kept(spark, f"file://{settings}/data", config.load(settings / "demo/config.yaml"))
    served(spark, settings, [1, 2, 3])
    run = lambda size=1: replication_stream.start(p, f"file://{settings}/server", f"file://{settings}/checkpoint", size, now=lambda: NOW).awaitTermination()
    run()
    assert p.taken == [[(1, n), (100 + n, 1)] for n in (1, 2, 3)]  # a file at a time, as no two are within a byte
    served(spark, settings, [4, 5])
    run(1 << 20)
    assert p.taken[3:] == [[(1, 5), (104, 1), (105, 1)]]
    assert osc.State.parse(osc.read_text(spark, f"{p.folder}/replication/state.txt")).sequence == 5
    one = Kept(spark, f"file://{settings}/other", p.config)
    one.import_changes(osc.merged_diffs(spark, [f"file://{settings}/server/{osc.State(n, NOW).path}.osc.gz" for n in range(1, 6)]).withColumn("insert_order", F.lit(0)))
    assert sorted(map(str, one.table("queue").collect())) == sorted(map(str, p.table("queue").collect()))
    served(spark, settings, [7])
    with pytest.raises(Exception, match="change file 6 is missing"):
        run()
    assert len(p.taken) == 4
    served(spark, settings, [6])
    # The batch that failed is tried again as it was; the number that was missing has to be part of a new one.
    other = replication_stream.update_batch(p, now=lambda: NOW)
    other(spark.createDataFrame([(f"file://{settings}/server/{osc.State(n, NOW).path}.osc.gz", 1) for n in (5, 6, 7)], "path string, length long"), 0)
    assert p.taken[4] == [(1, 7), (106, 1), (107, 1)]


def test_diffs_of_one_name_in_several_folders(spark, tmp_path):
    for k, v in (("a", 2), ("b", 2)):
        export.write_osc(D.changes(spark, ("n", 1, v, False, {"from": k}, 0, 0, None)), f"file://{tmp_path}/{k}/1.osc.gz")
    both = [f"file://{tmp_path}/{k}/1.osc.gz" for k in "ab"]
    assert [osc.merged_diffs(spark, x).first()["tags"]["from"] for x in (both, both[::-1])] == ["b", "a"]


@pytest.mark.parametrize("seed", range(20))
def test_sweep_finds_what_all_pairs_find(seed):
    rng = random.Random(seed)
    p = np.array([(rng.uniform(0, 5), rng.uniform(0, 5)) for _ in range(rng.randint(3, 9))] if seed % 2 else [(rng.randint(0, 5), rng.randint(0, 5)) for _ in range(6)], float)
    ring = np.concatenate([p, p[:1]])
    assert G.self_crossing(ring[:-1], ring[1:]) == G._crossing(ring[:-1], ring[1:], ring[:-1], ring[1:])


def test_a_ring_of_many_vertices_is_checked_in_seconds():
    t = np.linspace(0, 2 * math.pi, 1_000_001)[:-1]
    ring = np.column_stack([np.cos(t), np.sin(t)])
    ring = np.concatenate([ring, ring[:1]])
    began = time.time()
    assert not G.self_crossing(ring[:-1], ring[1:])
    turned = ring.copy()
    turned[[5000, 5001]] = turned[[5001, 5000]]
    assert G.self_crossing(turned[:-1], turned[1:])
    assert time.time() - began < 60
