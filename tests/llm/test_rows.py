"""Operators on single rows: language, licences, media, quality, pieces, mixing; and vectors."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terravet.llm import language, licences, media, mixing, pieces, quality, vectors

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces(docs, clashing, rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = Counter()
    for doc, text, *_ in rows:
        ids = sp.encode(text or "")
        expected[doc, len(ids), tuple(ids), sp.decode(ids) if ids else ""] += 1
    for table in (docs, clashing):
        got = pieces.tokenize(table, MODEL, table_chunks=500).collect()
        assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got) == expected
    assert pieces.tokenize(empty, MODEL).count() == 0
    got = pieces.tokenize_joined(clashing, MODEL).collect()
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got) == expected and pieces.tokenize_joined(empty, MODEL).count() == 0


def test_pieces_whole_text_equals_chunks():
    seg, rng = pieces.Segmenter(MODEL), random.Random(3)
    assert seg.cuts
    for _ in range(300):
        text = "".join(rng.choice("ab \n\t▁é🙂中,.  ") for _ in range(rng.randint(0, 40)))
        assert seg.encode([text]) == [seg.sp.encode(text)]


def test_language(spark, clashing, empty):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["ção", "nho", "lha", "que"]}
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200)))
    rows = [(i, text(s), name) for i, (name, s) in enumerate(list(syllables.items()) * 60)]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "12 34 ...", "aa"), (902, "", None)], "doc_id long, text string, lang string")
    made = language.fit(df.filter(~language.held_out()))
    assert sorted(made) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language.identify(df, made).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 20 and all(got[i]["lang_pred"] == rows[i][2] and not got[i]["rejected"] for i in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(empty, made).count() == 0 and language.fit(empty) == {}
    assert {r["lang_pred"] for r in language.identify(clashing, {}).collect()} == {"und"}
    same = dict(made, dd=made["aa"])
    assert all(r["rejected"] for r in language.identify(df.filter("lang = 'aa'"), same).collect())


def test_licences(spark, docs, clashing, empty):
    mit = licences.TEMPLATES["MIT"]
    texts = [mit, mit.upper(), "Copyright (c) 2020 Me\n\n" + mit, mit.replace("persons", "people").replace("sell", "give"), "some words before. Released under the MIT License. And after", "This work is licensed under the GNU General Public License, version 3.", "nothing of the kind", "", None, "the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert [got[i]["licence"] for i in range(len(texts))] == ["MIT"] * 4 + ["MIT notice", "GPL-3.0 notice"] + [None] * 4
    assert got[0]["dice"] == 1.0 == got[1]["dice"] and 0.8 <= got[3]["dice"] < 1 and got[7]["dice"] == 0.0
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    pairs = lambda t: set(zip(plain(t)[:-1], plain(t)[1:]))
    a, b = pairs(texts[3]), pairs(mit)
    assert abs(got[3]["dice"] - 2 * len(a & b) / (len(a) + len(b))) < 1e-12
    assert licences.scan(empty).count() == 0 and licences.scan(clashing).count() == docs.count()


def test_licence_bounds_lose_nothing():
    s = licences.Scanner()
    for k, own in enumerate(s.sets):
        low, high = s.bounds[k]
        n = len(own)
        for size in range(1, 3 * n):
            best = 2 * min(size, n) / (size + n)
            assert low <= size <= high or best < s.dice


def test_media(docs, clashing, rows, empty):
    expected = Counter()
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        stored = b"P5\n576 %d\n255\n" % (len(payload) // 576) + payload
        expected[doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest()] += 1
    for table in (docs, clashing):
        got = media.media_column(table).collect()
        assert Counter(tuple(r)[:7] for r in got) == expected
    assert media.media_column(empty).count() == 0


def test_chunks():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    parts = media.chunked(data)
    assert b"".join(p for _, p in parts) == data and all(media.LEAST <= len(p) <= media.MOST for _, p in parts[:-1])
    moved = media.chunked(b"x" * 777 + data)
    assert len({d for d, _ in parts} & {d for d, _ in moved}) > len(parts) * 0.8
    h = 0
    for b in data[:200]:
        h = (h * 2 + int(media.GEAR[b])) % (1 << 32)
    assert int(media.gear(np.frombuffer(data[:200], np.uint8))[-1]) == h
    with pytest.raises(ValueError):
        media.from_media(b"P5\n576 2\n255\n" + bytes(576))


def test_quality(spark, clashing, empty):
    rng = random.Random(2)
    words = {0: ["scum", "vile"], 1: ["BUY!!", "NOW###"], 2: ["river", "stone"]}
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "sea", "hill", *words[i % 3] * 2]) for _ in range(40)), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.fit(df.filter("doc_id < 200").select("doc_id", "text"), df.filter("doc_id < 200").select("doc_id", "grade"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = quality.grade(df, model).join(df, "doc_id").filter("doc_id >= 200").collect()
    assert np.mean([round(r["expected_grade"]) == r["grade"] for r in got]) > 0.95
    assert all(r["kept"] == (r["tail_prob"] >= quality.KEEP) for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in quality.grade(odd, model).collect()] == [(0.0, 0.0, False)] * 3
    assert quality.grade(empty, model).count() == 0 and quality.fit(empty, df.limit(0).select("doc_id", "grade")) is None
    assert quality.grade(clashing, None).count() == clashing.count() == quality.grade(clashing, model).count()
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, 0), (4, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert {r[0]: r[1] for r in quality.graded(labels).collect()} == {1: 2, 2: 1, 3: 0, 4: 1, 5: None}


def test_gradient_is_right():
    """The fitted likelihood can't be raised by a small step of any threshold or weight."""
    rng = np.random.default_rng(1)
    rows = [(int(g), np.array([0, int(g) + 1]), np.array([1.0, float(rng.uniform(0.5, 1))])) for g in rng.integers(0, 3, 60)]
    m = quality.fit_rows(rows, 3, bits=4)
    p = m.grades(np.array([m.score(a, v) for _, a, v in rows]))
    assert np.allclose(p.sum(axis=1), 1) and np.mean(p.argmax(axis=1) == [r[0] for r in rows]) == 1


def test_fit_is_a_maximum():
    """On ratings that overlap: no small step of a weight or threshold raises the penalised likelihood that fit_rows maximises."""
    rng = np.random.default_rng(4)
    rows = [(int(np.clip(round(x + rng.normal() * 0.7), 0, 2)), np.array([0, 1 + int(x)]), np.array([1.0, 1.0])) for x in rng.integers(0, 3, 600)]
    m = quality.fit_rows(rows, 3, bits=4)
    y, weigh = np.array([r[0] for r in rows]), None
    weigh = (len(y) / (3 * np.bincount(y, minlength=3)))[y]

    def value(weights, thresholds):
        made = quality.Ordinal(weights, thresholds)
        p = made.grades(np.array([made.score(a, v) for _, a, v in rows]))[np.arange(len(y)), y]
        return float((weigh * np.log(p)).mean() - quality.PENALTY / 2 * (weights**2).sum())

    best = value(m.weights, m.thresholds)
    for step in (0.05, -0.05):
        for k in range(4):
            w = m.weights.copy()
            w[k] += step
            assert value(w, m.thresholds) <= best + 1e-5
        for k in range(2):
            t = m.thresholds.copy()
            t[k] += step
            assert value(m.weights, t) <= best + 1e-5
    # Scores by hand: the distribution function of each threshold less the score.
    p = m.grades(np.array([0.3]))[0]
    below = 1 / (1 + np.exp(-(m.thresholds - 0.3)))
    assert np.allclose(p, [below[0], below[1] - below[0], 1 - below[1]])


def test_quality_learns_from_whole_texts(spark):
    """What tells the grade stands after 3,000 other distinct words, in null-free and repeated rows."""
    rng = random.Random(3)
    filler = [f"filler{i}" for i in range(3000)]
    mark = {0: "vile", 1: "cheap", 2: "river"}
    rows = [(i, " ".join(rng.sample(filler, 3000)) + " " + " ".join([mark[i % 3] * 3] * 40), i % 3) for i in range(90)]
    df = spark.createDataFrame([*rows, rows[0], (None, "vile", 0)], "doc_id long, text string, grade int")
    model = quality.fit(df, df.select("doc_id", "grade"))
    got = quality.grade(df.filter("doc_id IS NOT NULL"), model).dropDuplicates(["doc_id"]).collect()
    assert np.mean([round(r["expected_grade"]) == r["doc_id"] % 3 for r in got]) > 0.95


def test_language_learns_every_label_from_whole_texts(spark):
    """230 labels, and texts that tell their language only after 1,200 characters."""
    rng = random.Random(5)
    own = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for i in range(230)}
    text = lambda k: "same beginning of all " * 55 + " ".join(rng.choice(own[k]) for _ in range(300))
    rows = [(j * 1000 + i, text(k), k) for i, k in enumerate(own) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language.fit(df)
    assert sorted(made) == sorted(own)
    fresh = spark.createDataFrame([(i, text(k), k) for i, k in enumerate(own) if i % 10 == 0], "doc_id long, text string, lang string")
    got = language.identify(fresh, made, keep=("doc_id", "lang")).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_language_against_plain_compression(spark):
    """Predictions of each row against the smallest size by a compressor made here for each language."""
    import zstandard

    rng = random.Random(6)
    own = {"aa": "kalomitu", "bb": "scheinungver", "cc": "nholhaque"}
    text = lambda k, n: " ".join("".join(rng.choice(own[k]) for _ in range(4)) for _ in range(n))
    made = {k: text(k, 400).encode() for k in own}
    rows = [(i, text(rng.choice(list(own)), rng.randint(1, 2500))) for i in range(60)]
    rows += [rows[0], (None, rows[1][1])]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), made, keep=("doc_id", "text")).collect()

    def size(k, t):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(t[a : a + language.BLOCK_CHARS].encode())) for a in range(0, len(t), language.BLOCK_CHARS))

    assert len(got) == len(rows)
    for r in got:
        sizes = {k: size(k, r["text"]) for k in own}
        assert sizes[r["lang_pred"]] == min(sizes.values()) and r["rejected"] == (sorted(sizes.values())[1] - min(sizes.values()) < language.MARGIN * sorted(sizes.values())[1])




def test_mixing(spark, docs, clashing, rows, empty):
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, "b").otherwise("c").alias("source"))
    got = mixing.mix(many, {"a": 0.5, "b": 0.25, "c": 0.25})
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 30_000) < 900 and abs(n["b"] - 15_000) < 1200 and abs(n["c"] - 15_000) < 600
    copies = got.filter("source = 'b'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy").alias("m"))
    assert copies.filter("n <> m").isEmpty()
    first = [r["doc_id"] for r in got.select("doc_id").limit(500).collect()]
    assert first != sorted(first)
    assert mixing.mix(many, {"a": 1.0}).filter("source <> 'a'").isEmpty()
    assert set(clashing.columns) <= set(mixing.mix(clashing).columns)
    one = Counter((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect())
    assert one == Counter((r["doc_id"], r["copy"]) for r in mixing.mix(docs.repartition(2)).collect()) and mixing.mix(empty).count() == 0
    assert 0.5 * len(rows) < sum(one.values()) < 1.6 * len(rows)
    assert mixing.mix(docs, by="chars").count() > 0


@pytest.mark.parametrize("mean", [0.0, 0.3, 1.0, 4.5, 60.0, 500.0])
def test_poisson_intervals(spark, mean):
    rows = mixing.intervals(spark.createDataFrame([("s", mean)], "__source string, __mean double")).collect()
    p, total, k = np.exp(-mean), np.exp(-mean), 0
    for r in sorted(rows, key=lambda r: r["__count"]):
        assert r["__count"] == k + 1 and abs(r["__low"] - total) < 1e-9
        k += 1
        p *= mean / k
        total += p
    assert not rows or max(r["__high"] for r in rows) == 2.0


def test_more_sources_than_are_broadcast(docs, monkeypatch):
    few = Counter((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert Counter((r["doc_id"], r["copy"]) for r in mixing.mix(docs).collect()) == few


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16))
    x[:400] = x[0]  # one very common vector
    x[400:600] *= rng.uniform(0.2, 5, size=(200, 1))
    return x


def test_neighbours(spark, cloud):
    rows = [(i, v.tolist()) for i, v in enumerate(cloud)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None, *[1.0] * 15]), (5004, [1.0] * 3), (None, [1.0] * 16), (5005, [float("inf")] * 16)]
    df = spark.createDataFrame([*rows, *odd, rows[20]], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = vectors.neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 1500, 20))
    hits = total = 0
    for q, found in by.items():
        score = (cloud * cloud[q]).sum(axis=1)
        order = sorted((j for j in range(1500) if j != q), key=lambda j: (-score[j], j))[:10]
        found = sorted(found, key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        hits += len({r["vec_id"] for r in found} & set(order))
        total += 10
    assert hits / total >= 0.9


def test_edges_are_crossed_in_expected_order():
    for m in (1, 2, 3, 5):
        sets = vectors.edge_sets(m, 10**6)
        assert len(sets) == 3**m == len({tuple(sorted(x for x in s if x >= 0)) for s in sets.tolist()})
        made, q = vectors.Hashes(4, 1, m, 2.0, 10**6), np.random.default_rng(m).normal(size=(5, 5))
        low, _ = made.slots(0, q)
        keys = made.visits(0, q)
        near = {k for d in np.ndindex(*[3] * m) for k in made.keys(0, low[0] + np.array(d) - 1)[None].tolist()}
        assert set(keys[0].tolist()) == near and (keys[:, 0] == made.keys(0, low)).all()


def test_large_norms_lose_no_neighbour_to_rounding(spark):
    """Products near 0 of vectors with norms of 1e8, where rounding is larger than the differences."""
    rng = np.random.default_rng(3)
    q = rng.normal(size=8) * 1e8
    x = rng.normal(size=(300, 8)) * 1e8
    x -= np.outer(x @ q / (q @ q), q)
    x += np.outer(rng.normal(size=300) * 1e-12, q)
    rows = [(0, q.tolist())] + [(i + 1, v.tolist()) for i, v in enumerate(x)]
    got = vectors.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=10).orderBy("rank").collect()
    score = [(-float((np.array(v) * q).sum()), i) for i, v in rows[1:]]
    assert [(r["vec_id"]) for r in got] == [i for _, i in sorted(score)[:10]]


def test_few_vectors_give_all(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = vectors.neighbours(df, F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4]
    assert vectors.neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_poor_queries_are_scored_against_all(spark, cloud):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cloud[600:900])], "vec_id long, embedding array<double>")
    got = vectors.neighbours(df, F.col("vec_id") % 20 == 0, k=10, tables=1, functions=8, width=0.2, probes=1).collect()
    x = cloud[600:900]
    for q in range(0, 300, 20):
        score = (x * x[q]).sum(axis=1)
        order = sorted((j for j in range(300) if j != q), key=lambda j: (-score[j], j))[:10]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == order


def test_features_are_one_for_equal_texts():
    assert media.features(bytes(576)) == media.features(bytes(576)) and json.dumps(media.features(b"\xff" * 1152))
