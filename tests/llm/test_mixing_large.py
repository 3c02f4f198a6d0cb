"""Means too large for one draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravet.llm import mixing


@pytest.mark.parametrize("broadcast", [True, False])
def test_rare_source_gets_its_whole_share(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 200, "rare").otherwise("common").alias("source"))
    got = mixing.mix(many, {"rare": 0.75, "common": 0.25}, rows=360_000)  # 1,350 and 900 of each document
    copies = got.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias("a"), F.max("copy").alias("b"), F.count_distinct("copy").alias("d")).collect()
    assert len(copies) == 300 and all(r["n"] == r["b"] == r["d"] and r["a"] == 1 for r in copies)
    for source, mean in (("rare", 1350), ("common", 900)):
        n = np.array([r["n"] for r in copies if r["source"] == source])
        assert abs(n.mean() - mean) < 4 * (mean / len(n)) ** 0.5 and 0.6 < n.var() / mean < 1.6
    mixed = mixing.mix(many.filter("doc_id < 100 OR doc_id > 198"), {"rare": 1.0, "common": 30.0}, rows=62_000)  # 20 of each rare one, 594 of each common one
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["rare"] - 2000) < 200 and abs(n["common"] - 60_000) < 1000


def test_statement_agrees_beyond_one_draw(spark, tmp_path):
    """The DuckDB statement and the operator on a source whose mean is 1,500 and one of 0.5, with nulls and a repeated row."""
    import duckdb

    rows = [(i, f"text {i}", "en", "common", 6) for i in range(2998)] + [(5000, "rare", "fr", "rare", 4), (5001, None, None, None, None), (5001, None, None, None, None), (None, "no id", "en", "common", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "doc_id, source, copy, shuffle_key"
    expected = sorted(map(str, con.execute(f"SELECT {columns} FROM ({mixing.OP10_SQL})").fetchall()))
    got = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).select(*columns.split(", ")).collect()
    assert sorted(str(tuple(r)) for r in got) == expected and sum(r["source"] == "rare" for r in got) > 900
