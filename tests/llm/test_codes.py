"""Product codes against plain Lloyd's rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravet.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """{row number: (codes, error)} and the codebooks."""
    kept = [(i, v, [math.floor(4096 * x) for x in e]) for i, (v, e, _) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = {}
    for _, v, w in sorted(kept, key=lambda x: (x[1] is None, x[1] or 0, x[2])):
        first.setdefault(v, w)
    seeds = list(first.values())[:entries]
    width = len(seeds[0]) // parts
    cut = lambda w, p: w[p * width : (p + 1) * width]
    books = [[cut(w, p) for w in seeds] for p in range(parts)]

    def nearest(p, w):
        return min((sum((a - b) ** 2 for a, b in zip(w, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            owned = {}
            for _, _, w in kept:
                owned.setdefault(nearest(p, cut(w, p))[1], []).append(cut(w, p))
            new.append([[sum(c) // len(owned[j]) for c in zip(*owned[j])] if j in owned else e for j, e in enumerate(books[p])])
        books = new
    out = {}
    for i, _, w in kept:
        found = [nearest(p, cut(w, p)) for p in range(parts)]
        out[i] = ([j for _, j in found], sum(d for d, _ in found))
    return out, books


def vectors(kind, n=700, dims=16):
    rng = random.Random(kind)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    make = {"spread": lambda: [rng.gauss(0, 0.2) for _ in range(dims)], "clusters": lambda: [c + rng.gauss(0, 0.01) for c in rng.choice(centres)], "grid": lambda: [rng.randint(-1, 1) / 4 for _ in range(dims)], "one": lambda: [0.5] * dims}[kind]
    rows = [(i * 7 % n, [float(np.float32(x)) for x in make()], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [None] + [0.0] * (dims - 1), 1), (n + 3, [float("nan")] * dims, 1), (n + 4, [float("inf")] + [0.0] * (dims - 1), 2)]
    return rows + [rows[3], rows[3], (0, rows[5][1], None), (None, rows[6][1], 1), (-5, rows[7][1], 3)]


@pytest.mark.parametrize("kind", ["spread", "clusters", "grid", "one"])
def test_rows_equal_plain_rounds(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", codes int").repartition(3)
    found, books = codes.product_codes(df, parts=4, entries=16)
    expected, plain_books = plain(rows, 4, 16, 6)
    assert [b.tolist() for b in books] == plain_books
    assert sorted((str(r["vec_id"]), r["codes"], r["error"]) for r in found.collect()) == sorted((str(rows[i][0]), c, e) for i, (c, e) in expected.items())
    errors = {}
    for i, (_, e) in expected.items():
        errors[rows[i][2]] = errors.get(rows[i][2], 0) + e
    labelled = codes.with_label_errors(found).collect()
    assert len(labelled) == len(expected) and all(r["label_error"] == errors[r["label"]] for r in labelled)


def test_trees_assign_whole_nodes():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4096, 4096, (6, 8))
    points = centres[rng.integers(0, 6, 1000)] + rng.integers(-20, 20, (1000, 8))
    seen = []
    books = [np.array(centres[:, :4]), np.array(centres[:, 4:])]
    nearest, totals = codes.assigned(codes.planted(points, 2), codes.EntryTrees(books), seen)
    assert seen[0][0] > 0 and seen[0][1] < 1000 and totals[:, -1].sum() == 2000


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 33, 250])
def test_trees_of_any_size(n):
    rng = np.random.default_rng(n)
    points = rng.integers(-9, 9, (n, 6))
    books = [rng.integers(-9, 9, (5, 3)) for _ in range(2)]
    f = codes.planted(points, 2)
    nearest, totals = codes.assigned(f, codes.EntryTrees(books))
    for p in range(2):
        d = ((points[:, None, 3 * p : 3 * p + 3] - books[p][None]) ** 2).sum(axis=2)
        own = np.empty(n, np.int64)
        own[f.order[p]] = nearest.reshape(2, n)[p]
        assert (own == d.argmin(axis=1)).all()
        assert totals[5 * p : 5 * p + 5, :3].sum(axis=0).tolist() == points[:, 3 * p : 3 * p + 3].sum(axis=0).tolist()


def test_odd_tables(spark):
    none, books = codes.product_codes(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and books == []
    some = spark.createDataFrame([(5, [1.0] * 8, None), (3, [2.0] * 8, None), (9, [1.0] * 16, None), (10, [], 1)], SCHEMA)
    found, books = codes.product_codes(some)
    assert sorted((r["vec_id"], r["error"]) for r in found.collect()) == [(3, 0), (5, 0)] and len(books[0]) == 2
    with pytest.raises(ValueError):
        codes.product_codes(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))


def test_query(spark, tmp_path):
    rows = vectors("spread", 120, 64)
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op11_codes"](spark, str(tmp_path)).collect()
    expected, books = plain(rows, 8, 16, 6)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["codebooks_sha256"]) for r in found) == sorted((str(rows[i][0]), "".join(f"{c:02x}" for c in cs), e, digest) for i, (cs, e) in expected.items())
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(str, con.execute(codes.statement()).fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in found)
    assert spark.read.parquet(f"{tmp_path}/embeddings.parquet").where(F.lit(False)).count() == 0
