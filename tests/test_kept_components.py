"""Kept labels after each of a series of random updates against components from nothing; how much is computed again."""

import random

from terravet.operators import graph
from terravet.plans.tables import Steps


def plain(links):
    label = {}
    for a, b in links:
        for v in (a, b):
            label.setdefault(v, v)
    go = True
    while go:
        go = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                go = True
    return label


def frame(spark, links):
    return spark.createDataFrame(list(links), "a long, b long")


def test_random_updates(spark, tmp_path):
    rng, links = random.Random(11), set()
    kept = graph.KeptComponents(spark, f"file://{tmp_path}")
    for k in range(6):
        links -= set(rng.sample(sorted(links), min(len(links), 4)))
        links |= {(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(12 if k == 0 else 4)}
        if k == 4:
            links = {x for x in links if x[0] > 30}
        before = {r["v"]: r["component"] for r in kept.labels().collect()}
        changed = kept.update(frame(spark, links), Steps(spark, "t"))
        got = {r["v"]: r["component"] for r in kept.labels().collect()}
        assert got == plain(links)
        assert changed == sum(before.get(v) != got.get(v) for v in before.keys() | got.keys())
    assert kept.update(frame(spark, links), Steps(spark, "t")) == 0


def test_only_touched_components_are_computed(spark, tmp_path, monkeypatch):
    chains = [(10 * i + j, 10 * i + j + 1) for i in range(40) for j in range(5)]
    kept = graph.KeptComponents(spark, f"file://{tmp_path}")
    kept.update(frame(spark, chains), Steps(spark, "t"))
    given, whole = [], graph.components

    def counted(links, steps):
        given.append(links.count())
        return whole(links, steps)

    monkeypatch.setattr(graph, "components", counted)
    # A chain falls in two, two chains become one.
    assert kept.update(frame(spark, [x for x in chains if x != (2, 3)] + [(15, 20)]), Steps(spark, "t")) == 3 + 6
    assert given == [4 + 5 + 5 + 1]
    assert {r["v"]: r["component"] for r in kept.labels().collect()} == plain([x for x in chains if x != (2, 3)] + [(15, 20)])
    assert kept.table.manifest().deltas[-1]["rows"] == 9


def test_rounds_and_the_last_task_agree(spark, monkeypatch):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    for most in (0, 40, 10_000):
        monkeypatch.setattr(graph, "AT_ONCE", most)
        assert {r["v"]: r["component"] for r in graph.components(frame(spark, links), Steps(spark, "t")).collect()} == plain(links)
