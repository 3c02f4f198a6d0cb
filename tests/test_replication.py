"""Fetching by sequence: the cap on bytes, the state reached, what is missing; and an update of a project from it."""

import gzip
from datetime import UTC, datetime

import pytest

from terravet.sources import osc, replication

START = osc.State(0, datetime(2024, 1, 1, tzinfo=UTC))


@pytest.fixture
def server(tmp_path):
    for n in range(1, 5):
        state = osc.State(n, datetime(2024, 1, n, tzinfo=UTC))
        at = tmp_path / f"{state.path}.osc.gz"
        at.parent.mkdir(parents=True, exist_ok=True)
        text = f'<osmChange version="0.6"><modify><node id="{n}" version="2" lat="1" lon="2"/></modify></osmChange>' + " " * 10
        at.write_bytes(gzip.compress(text.encode(), mtime=0))
        (tmp_path / f"{state.path}.state.txt").write_text(state.text())
    (tmp_path / "state.txt").write_text(state.text())
    return tmp_path


def test_files_after_a_state(spark, server):
    all_ = replication.after(spark, f"file://{server}", START)
    assert len(all_.files) == 4 and all_.state.sequence == 4 and all_.code == replication.FETCHED
    assert sorted(r["id"] for r in osc.merged_diffs(spark, all_.files).collect()) == [1, 2, 3, 4]
    size = (server / f"{osc.State(1, START.timestamp).path}.osc.gz").stat().st_size
    some = replication.after(spark, f"file://{server}", START, size=int(2.5 * size))
    assert len(some.files) == 2 and some.state == osc.State(2, datetime(2024, 1, 2, tzinfo=UTC))
    assert len(replication.after(spark, f"file://{server}", some.state, size=1).files) == 1
    none = replication.after(spark, f"file://{server}", all_.state)
    assert none.files == [] and none.code == replication.NOTHING and none.state == all_.state


def test_gaps_are_met(spark, server):
    (server / f"{osc.State(3, START.timestamp).path}.osc.gz").unlink()
    with pytest.raises(FileNotFoundError):
        replication.after(spark, f"file://{server}", START)
    with pytest.raises(FileNotFoundError):
        replication.after(spark, f"file://{server}/nowhere", START)


def test_a_project_from_extract_to_export(spark, server, settings, tmp_path):
    """Base from PBF, changes fetched in two steps, base out as PBF."""
    from terravet.plans.project import Project
    from terravet.sources import config, pbf
    from tests import domain as D

    n, w, r = D.nodes(spark, (1, {"a": "1"}, 0, 0), (2, {"b": "1"}, 5, 5)), D.ways(spark, (10, {"w": "1"}, [1, 2])), D.relations(spark)
    p = Project(spark, f"file://{tmp_path}/source", config.load(settings / "demo/config.yaml"))
    p.put(nodes=n, ways=w, relations=r)
    p.export(f"{tmp_path}/out.osm.pbf")
    q = Project(spark, f"file://{tmp_path}/data", p.config)
    q.import_base(f"{tmp_path}/out.osm.pbf")
    flat = lambda x: sorted((r["objtype"], r["id"], r["version"], str(r["nodes"]), str(sorted((r["tags"] or {}).items()))) for r in x.base.collect())
    assert flat(p) == flat(q)
    assert q.fetch_changes(f"file://{server}", 200) == replication.FETCHED and q.fetch_changes(f"file://{server}") in (replication.FETCHED, replication.NOTHING)
    assert sorted(D.ids(q.table("queue"), "id")) == [1, 2, 3, 4] and q.fetch_changes(f"file://{server}") == replication.NOTHING
