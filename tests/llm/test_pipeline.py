"""The pipeline's stages, each on the rows that its predecessor kept, against plain versions; clashing columns, nulls, an empty table."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_near import plain_components
from test_short_lines import plain as plain_lines

from terravet.llm import language, mixing

CLASH = ("rejected", "score", "margin", "lang_pred", "copy", "shuffle_key", "kept", "component_id", "ids", "decoded", "n_removed", "n_tokens", "t", "k0", "__0")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    syllables = {"aa": ["ka", "lo", "mi", "tu", "re"], "bb": ["sch", "ein", "ung", "ver", "zt"]}
    words = {k: ["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(150)] for k, s in syllables.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    out = []
    for i in range(60):
        k = ["aa", "bb"][i % 2]
        lines = [text(k, rng.randint(8, 40)) for _ in range(rng.randint(1, 4))]
        out.append((i, "\n".join(["A line that stands everywhere in these texts", *lines]), k if i % 5 else None, f"s{min(i % 4, 2)}", None))
    for i in range(60, 70):  # near copies, whose lines differ enough to stay
        w = out[i - 60][1].split(" ")
        w[len(w) // 2] = "other"
        out.append((i, " ".join(w), "aa", "s1", None))
    out += [(80, None, "aa", "s0", None), (81, "", "aa", None, None), (82, "123 456", None, "s0", None), (83, out[3][1], "bb", "s9", None), out[7], (None, text("aa", 30), "aa", None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    columns = docs.columns
    key = lambda r: (r["doc_id"], r["text"])
    made = language.fit(docs.filter(~language.held_out()))
    known = language.Classifier(made)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs, folder).cache()
    assert first.columns == columns and all(r["rejected"] == "own rejected" and r["__0"] == "own __0" for r in first.collect())
    given = [r for r in docs.collect()]
    assert Counter(map(key, first.collect())) == Counter(key(r) for r in given if not known.predict(r["text"])[3])
    assert 50 < first.count() < len(given)

    second = stages["lines"](spark, first, folder).cache()
    assert second.columns == columns
    by_id = sorted({key(r) for r in first.collect() if r["doc_id"] is not None})
    expected = {i: (t, n) for (i, _), (t, n) in zip(by_id, (plain_lines([t for _, t in by_id])[j] for j in range(len(by_id))))}
    for r in second.collect():
        assert r["doc_id"] is None or r["text"] == expected[r["doc_id"]][0] and r["n_chars"] == len(r["text"])
    kept = Counter(r["doc_id"] for r in second.collect())
    assert kept == Counter(r["doc_id"] for r in first.collect() if r["doc_id"] is None or not expected[r["doc_id"]][1] or expected[r["doc_id"]][0].strip())

    third = stages["near_duplicates"](spark, second, folder).cache()
    assert third.columns == columns
    components = plain_components([(r["doc_id"], r["text"]) for r in second.collect()], 5, 80, 100)
    one_each = {i for i, (_, c) in components.items() if i == c}
    assert Counter(r["doc_id"] for r in third.collect()) == Counter([*one_each, *[r["doc_id"] for r in second.collect() if r["doc_id"] is None]])

    fourth = stages["mixing"](spark, third, folder).cache()
    assert fourth.columns == columns
    assert Counter(map(key, fourth.collect())) == Counter(map(key, mixing.mix(third).collect()))

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = stages["pieces"](spark, fourth, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in last) == Counter((r["doc_id"], tuple(sp.encode(r["text"])), sp.decode(sp.encode(r["text"]))) for r in fourth.collect())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in whole) == Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in last) and len(whole) > 20


def test_no_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
