"""Exact duplicates against a dictionary of normalised texts, with tables so small that buckets spill over several levels."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from terravet.llm import exact, queries

SPACE = re.compile("[\x20\x09-\x0d]+")


def plain(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(SPACE.sub(" ", r[1] or ""), []).append(((r[0] is None, r[0] or 0), i))
    out = []
    for text, own in groups.items():
        keep = min(own)
        for _, i in own:
            out.append((rows[i][0], rows[keep[1]][0], len(own), i == keep[1], hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def more(rows):
    out = list(rows)
    for i in range(300):
        out.append((1000 + i, ["a  hot\ttext ", "a hot text "][i % 2], "en", "s", None))
    for i in range(60):
        out.append((2000 + i % 45, f"text {i % 37}\x0b\x0c{'y' * (i % 37)}", "en", "s", None))
    return out + [(None, "a hot text ", None, None, None), (None, "only null", None, None, None), (None, "only  null", None, None, None), (7000, "x" * 3_000_000, None, None, None), (6999, "x" * 3_000_000, None, None, None)]


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 4096, "table_bytes": 2000, "read_bytes": 300}, {"bucket_bytes": 1 << 30, "table_bytes": 1, "read_bytes": 1}])
def test_rows(spark, more, sizes):
    some = more if sizes.get("table_bytes") != 1 else more[-90:]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in ("row", "h", "leader", "sha", "t", "size", "keep_id", "n")})
    assert got(exact.exact_duplicates(df.repartition(5), **sizes)) == plain(some)


def test_equal_hashes_are_compared_whole():
    table = exact.Table(1 << 20, slots=4)
    numbers = [table.find(5, t) for t in (b"a", b"b", b"a", b"c", b"", b"b", b"d", b"")]
    assert numbers == [0, 1, 0, 2, 3, 1, 4, 3]


def test_a_full_table_stays_full():
    table = exact.Table(200)
    assert [table.find(1, b"x" * 150), table.find(2, b"y" * 150), table.find(3, b"z"), table.find(1, b"x" * 150)] == [0, -1, -1, 0]
    assert exact.Table(1).find(9, b"long text") == 0


def test_no_rows(spark, empty):
    assert exact.exact_duplicates(empty).count() == 0 and exact.exact_duplicates(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_query_and_statement(spark, more, tmp_path):
    df = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    df.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert Counter(con.execute(exact.OP12_SQL).fetchall()) == got(queries.QUERIES["op12_exact"](spark, str(tmp_path)))
