"""What once was cut without a word: rates of samples, visits of buckets, columns named like the operators' own."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terravet.llm import common, lines, mixing, vectors

INNER = ("__id", "__stays", "__n", "__source", "__u", "__low", "__high", "__count", "__of", "__part", "__salt", "__key", "__sums", "__drawn", "row", "id", "source_", "size")


def test_no_group_is_too_large_to_be_sampled():
    assert common.rate_of(1600 / 1e13) >= 1 and common.rate_of(3.0) == common.RATES and common.rate_of(0.25) == common.RATES // 4


def test_visits_go_on_until_the_sample_is_found(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    exact = {}
    for i in range(0, 600, 20):
        s = x @ x[i]
        s[i] = -np.inf
        exact[i] = set(np.argsort(-s)[:20].tolist())
    monkeypatch.setattr(vectors, "FIRST_PROBES", 2)
    found = {}
    for r in vectors.neighbours(df, F.col("vec_id") % 20 == 0, functions=6, tables=1).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(exact[q] & found[q]) / 20 for q in exact]) >= 0.9


def test_names_of_inner_columns(spark):
    rng = random.Random(3)
    same = "a line that stands in many of these texts"
    rows = [(i, "\n".join([same, f"own {rng.random()} line {i}"]), f"s{i % 3}") for i in range(40)] + [(None, same, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = plain.withColumns({c: F.lit(f"own {c}") for c in INNER}).withColumn("a.b", F.lit(1))
    for made in (lambda df: lines.dedup_lines(df, least=1), mixing.mix):
        given, expected = made(odd), made(plain)
        assert [c for c in given.columns if c in odd.columns] == odd.columns
        assert all(r[c] == f"own {c}" for r in given.collect() for c in INNER)
        key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
        assert key(given) == key(expected)
