"""Near duplicates, lines and repeated strings against plain versions over all pairs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from terravet.llm import documents, graph, lines, near, substrings
from terravet.llm.common import Scratch


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def plain_components(rows, n, num, den):
    own = {r[0]: shingles(r[1], n) for r in rows if r[0] is not None}
    sets, ids = Sets(), sorted(own)
    for i in ids:
        sets.find(i)
        for j in ids:
            both = len(own[i] & own[j])
            if i < j and own[i] and own[j] and den * both >= num * (len(own[i]) + len(own[j]) - both):
                sets.join(i, j)
    return {i: (len(own[i]), sets.find(i)) for i in ids}


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_documents(docs, clashing, rows, n, num):
    expected = plain_components(rows, n, num, 100)
    for table in (docs, clashing) if n == 3 else (docs,):
        got = documents.near_duplicates(table, n, num, 100).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_no_documents(empty):
    assert documents.near_duplicates(empty).count() == 0 and lines.dedup_lines(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    """A bucket of many components, dealt in small blocks, against all pairs."""
    rng = random.Random(3)
    seed = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.05 else f"y{rng.randrange(99)}" for w in seed) for _ in range(90)]
    rows = [(i, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "FEW", 2)
    df = spark.createDataFrame([(1, i, i) for i, _ in rows], "key long, id long, component long")
    table = spark.createDataFrame(rows, "id long, text string")
    links = near.across(df, table, near.word_sets(3), near.Threshold(85, 100), Scratch(spark, "blocks"))
    found = {r["id"]: r["component"] for r in graph.components(links, Scratch(spark, "c")).collect()} if not links.isEmpty() else {}
    expected = plain_components([(i, t, None) for i, t in rows], 3, 85, 100)
    assert {i: found.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in expected.items()}


def test_signature_estimates_similarity():
    made = near.Circulant(64, 4, 20)
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    x, y = made.least(made.places(a)), made.least(made.places(b))
    assert abs((x == y).mean() - 800 / 1200) < 0.1


def plain_lines(rows):
    places, texts = defaultdict(set), {}
    for doc, text, *_ in rows:
        if doc is not None and text is not None:
            texts[doc] = text.encode().split(b"\n")
            for n, line in enumerate(texts[doc]):
                if len(line) >= lines.MIN_BYTES:
                    places[line.lower()].add((doc, n))
    items, sets = list(places), Sets()
    own = [frozenset(x[k : k + 8] for k in range(len(x) - 7)) for x in items]
    for i in range(len(items)):
        sets.find(i)
        for j in range(i):
            both = len(own[i] & own[j])
            if 100 * both >= 80 * (len(own[i]) + len(own[j]) - both):
                sets.join(i, j)
    groups = defaultdict(set)
    for i, x in enumerate(items):
        groups[sets.find(i)] |= places[x]
    gone = {p for g in groups.values() for p in g if p != min(g)}
    return {doc: (b"\n".join(x for n, x in enumerate(t) if (doc, n) not in gone).decode(), sum((doc, n) in gone for n in range(len(t)))) for doc, t in texts.items()}


def test_lines(docs, clashing, rows):
    expected = plain_lines(rows)
    for table in (docs, clashing):
        got = lines.dedup_lines(table)
        assert set(table.columns) <= set(got.columns)
        got = got.select("doc_id", "text", "n_removed").collect()
        assert len(got) == len(rows)
        for r in got:
            if r["text"] is None or r["doc_id"] is None:
                assert r["n_removed"] == 0
            else:
                assert (r["text"], r["n_removed"]) == expected[r["doc_id"]]


def plain_removed(rows):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[s : s + 400] for b in data for s in range(len(b) - 399))
    out = Counter()
    for (doc, *_), b in zip(rows, data):
        cover = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                cover[s : s + 400] = b"\1" * 400
        spans = sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out[doc, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group", [substrings.GROUP, 1])
def test_repeated_strings(docs, clashing, rows, group):
    short = [r for r in rows if len(r[1] or "") < 5000]
    expected = plain_removed(short)
    got = substrings.remove_repeats((docs if group > 1 else clashing).filter("text IS NULL OR length(text) < 5000"), group)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.drop("kept").collect()) == expected


def test_deep_shallow_sorting():
    rng = random.Random(1)
    for alphabet, n in ((b"ab", 200), (b"a", 60), (b"abcdef", 300)):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(n)]
        strings += [b"q" * 50 + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(40)]
        order, common = substrings.deep_shallow(strings)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
        assert common == [0, *[substrings.Blind.common(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:])]]


def test_many_contexts_count_alike():
    """The way of large groups agrees with that of small ones."""
    rng = random.Random(2)
    core = bytes(rng.randrange(97, 100) for _ in range(380))
    left, right = [], []
    for _ in range(600):
        x = bytes(rng.choice(b"ab") for _ in range(12)) + core + bytes(rng.choice(b"ab") for _ in range(12))
        left.append(x[:200])
        right.append(x[200:])
    whole = substrings.repeated(left, right)
    seen = Counter((t, (a[len(a) - t :] + b)[:400]) for a, b in zip(left, right) for t in range(max(0, 400 - len(b)), len(a) + 1))
    for i in range(0, 600, 50):
        for t in range(max(0, 400 - len(right[i])), len(left[i]) + 1):
            assert whole[i, t] == (seen[t, (left[i][len(left[i]) - t :] + right[i])[:400]] > 1)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcd") for _ in range(9000))
    monkeypatch.setattr(substrings, "PLACES", 2500)
    covered = []
    for texts, numbers, begins, _ in substrings.parts([text]):
        starts, ends, _, grams, *_ = substrings.BYTES.of(texts)
        t, first, last, anchor, _ = substrings.anchored(grams, starts, ends)
        covered += [w + begins[0] for f, e in zip(first, last) for w in range(f, e + 1)]
    assert covered == list(range(9000 - 399))


def test_long_texts_in_pieces_of_words(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") for _ in range(4000)).encode()
    monkeypatch.setattr(substrings, "PLACES", 2500)
    covered = []
    for texts, numbers, begins, before in substrings.parts([text], substrings.WORDS):
        starts, ends, _, grams, unit_start, unit_end = substrings.WORDS.of(texts)
        t, first, last, anchor, _ = substrings.anchored(grams, starts, ends, substrings.WORDS)
        covered += [w + before[0] for f, e in zip(first, last) for w in range(f, e + 1)]
        assert all(text[begins[0] + unit_start[w]] == text[2 * (w + before[0])] for w in range(len(unit_start)))
    assert covered == list(range(4000 - 50))


def plain_passages(rows):
    """Words within strings of 51 words that also stand elsewhere, by text."""
    data = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t, *_ in rows]
    seen = Counter(tuple(w[s : s + 51]) for w in data for s in range(len(w) - 50))
    out = Counter()
    for (doc, *_), w in zip(rows, data):
        cover = bytearray(len(w))
        for s in range(len(w) - 50):
            if seen[tuple(w[s : s + 51])] > 1:
                cover[s : s + 51] = b"\1" * 51
        out[doc, sum(cover)] += 1
    return out


@pytest.mark.parametrize("group", [substrings.GROUP, 1])
def test_passages_of_words(spark, group):
    """Passages of 45 to 70 words, most below 400 bytes, amid others, with other white space between their words."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, passages = [], [some(n) for n in (45, 50, 51, 52, 60, 70)]
    for p in passages:
        for i in range(3):
            own = some(rng.randint(0, 60)) + p[rng.randint(0, 2) * (i == 2) :] + some(rng.randint(0, 60))
            rows.append((len(rows), "".join(w + rng.choice([" ", "\n", "  ", "\t "]) for w in own)))
    rows += [(100, " ".join(some(200))), (101, None), (102, ""), (103, " ".join(["a"] * 60)), (None, rows[0][1]), (5, rows[5][1])]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group)
    assert Counter((r["doc_id"], r["passage_words"]) for r in got.collect()) == plain_passages(rows)
