import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return [rng.choice(vocabulary) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows, shared passages and odd characters."""
    rng = random.Random(7)
    out, doc = [], 0
    seed = prose(rng, 300)
    passage = "".join(rng.choice("abcdefg hijk") for _ in range(620))

    def add(text, lang="en", source="s0", doc_id=None):
        nonlocal doc
        out.append((doc if doc_id is None else doc_id, text, lang, source, None if text is None else len(text)))
        doc += 1

    for i in range(40):
        add(" ".join(prose(rng, rng.randint(1, 200))), rng.choice(["en", "fr", None]), f"s{i % 4}")
    for i in range(25):  # near copies of one text, of all distances
        w = list(seed)
        for _ in range(i):
            w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
        add(" ".join(w))
    for _ in range(5):
        add(" ".join(seed))
    for i in range(12):  # a passage amid others
        add("".join(rng.choice("opqrstu vwxyz\n") for _ in range(rng.randint(0, 700))) + passage[rng.randint(0, 60) :] + "".join(rng.choice("opqrstu vwxyz") for _ in range(rng.randint(0, 500))))
    add("ab " * 600)  # repeats within itself
    add(" ".join(prose(rng, 30_000)))
    for text in (None, "", " ", "\n\n", "x", "two words", "Two WORDS", "é ▁ ñ　x y\t\r\n\x00z 🙂🙂", "1234 5678", "...", "▁▁▁", "one line here too\nOne line here too\nanother line of text\n"):
        add(text, None, None)
    add("again and again and again we meet", "fr")
    out.append(out[-1])  # a repeated row
    add("no number", doc_id=None)
    out[-1] = (None, *out[-1][1:])
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same with columns named like those that operators add or use."""
    from pyspark.sql import functions as F

    names = "kept component_id id key t ids decoded n_tokens licence dice copy shuffle_key keep score rejected n_removed n_bytes feature medium lines gram d0 d1 pivot rank count value".split()
    return docs.withColumns({n: F.lit(n) for n in names})
