"""Spelling variants against plain tokenisation and all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from terravet.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans({c: c + 32 for c in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def plain(rows, slip=199, least_n=5):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_n}
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    stems = ["colour", "grammar", "straße", "naïveté", "aabbaabb", "abcabcabc", "ÀÉÎõü×", "letters", "mississippi", "banana"]
    vocabulary = {}
    for s in stems:
        vocabulary[s] = 400
        for _ in range(12):
            w = list(s)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(w))
                rng.choice([lambda: w.insert(i, rng.choice("abéz")), lambda: w.pop(i) if len(w) > 6 else None, lambda: w.__setitem__(i, rng.choice("abcé")), lambda: rng.shuffle(w)])()
            vocabulary["".join(w)] = rng.choice([4, 5, 6, 30, 79, 80, 81])
    vocabulary |= {"chainsaw": 400, "chainsawe": 60, "chainsawes": 10}
    words = [rng.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w.isascii() else w]) for w, n in vocabulary.items() for _ in range(n)]
    rng.shuffle(words)
    out = [(i, rng.choice([" ", "-", "\n", "œ", "1", "🙂"]).join(words[a : a + 40])) for i, a in enumerate(range(0, len(words), 40))]
    return out + [(None, " ".join(words[:90])), (900, None), (901, ""), (902, "abc 123"), (903, "z" * 50_000), out[0], out[0]]


def found(df):
    rows = df.collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("slip", [199, 7])
def test_rows(spark, texts, slip):
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("word", "n", "form", "letters", "key")}).repartition(4)
    expected = plain(texts, slip)
    assert found(spelling.variants(df, slip=slip)) == expected
    assert sum(x[1] is not None for x in expected) >= 10 and sum(x[2] != x[1] for x in expected if x[1]) > 0


def test_signatures_are_exact(spark):
    rng = random.Random(2)
    vectors = list({"".join(sorted(rng.choice("abcde") for _ in range(rng.randint(4, 9)))) for _ in range(300)})
    places = {v: {(c, v[:i].count(c)) for i, c in enumerate(v)} for v in vectors}
    keys = {r["letters"]: set(r["keys"]) for r in spelling.signatures(spark.createDataFrame([(v,) for v in vectors], "letters string")).collect()}
    for a, b in combinations(vectors, 2):
        if len(places[a] ^ places[b]) <= 2:
            assert keys[a] & keys[b]


def test_odd_tables(spark, empty):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "lonely lonely lonely lonely lonely")], "doc_id long, text string")).collect()[0].asDict() == {"word": "lonely", "form": None, "root": "lonely", "n": 5, "n_near": 0, "form_n": None}


def test_query_and_statement(spark, texts, tmp_path):
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(con.execute(spelling.OP13_SQL).fetchall()) == found(queries.QUERIES["op13_spelling"](spark, str(tmp_path))) == plain(texts)
