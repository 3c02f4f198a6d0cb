"""Licences inside longer documents, with words inserted or missing."""

import random

from terravet.llm import licences


def words(rng, n):
    return ["".join(rng.choice("bcdfgh") for _ in range(7)) for _ in range(n)]


def plain(t):
    return "".join(c if c.isalnum() else " " for c in t.lower()).split()


def test_spans_longer_and_shorter_than_the_template():
    rng, mit = random.Random(5), plain(licences.TEMPLATES["MIT"])
    n, s = len(mit), licences.Scanner()
    pairs = lambda w: set(zip(w[:-1], w[1:]))
    for own in (mit[: n // 2] + words(rng, n * 22 // 100) + mit[n // 2 :], mit[: n * 75 // 100], mit[: n // 3] + mit[n // 3 + n // 4 :]):
        a, b = pairs(own), pairs(mit)
        dice = 2 * len(a & b) / (len(a) + len(b))
        found = s.scan([" ".join(words(rng, 300) + own + words(rng, 300)).encode()])[0]
        assert dice > 0.8 and found and s.names[found[0][0]] == "MIT" and found[0][1] >= dice - 1e-12 and found[0][2] == 300
    assert not s.scan([" ".join(words(rng, 900)).encode()])[0]


def test_all_spans_by_hand():
    """Against a plain scan of every span of every template, on small templates and texts made from them."""
    rng = random.Random(9)
    templates = {"A": " ".join(words(rng, 14)), "B": " ".join(words(rng, 25)), "C": "the and of " + " ".join(words(rng, 9))}
    s = licences.Scanner(templates)
    bi = lambda w: set(zip(w[:-1], w[1:]))
    texts = [" ".join(words(rng, rng.randint(0, 30)))] * 2 + ["", "the", "x y"]
    for _ in range(120):
        out = words(rng, rng.randint(0, 12))
        for name in rng.sample("ABC", rng.randint(1, 2)):
            w = plain(templates[name])
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = words(rng, rng.randint(0, 2))
            out += w + words(rng, rng.randint(0, 12))
        texts.append(" ".join(out))
    hits = 0
    for text, found in zip(texts, s.scan([t.encode() for t in texts])):
        w, expected = plain(text), {}
        for name, own in templates.items():
            b = bi(plain(own))
            best = max((2 * len(a & b) / (len(a) + len(b)) for i in range(len(w)) for j in range(i + 2, len(w) + 1) for a in [bi(w[i:j])]), default=0.0)
            if best >= licences.DICE:
                expected[name] = best
        got = {s.names[k]: c for k, c, _ in found}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
        hits += len(got)
    assert hits > 80


def test_whole_texts_of_licences():
    """A licence file with a notice before it is found by its whole text; a header isn't the licence."""
    known = licences.templates_known()
    s = licences.Scanner()
    found = s.scan([("Copyright 2020 Someone. " * 20 + known["Apache-2.0"]).encode(), known["GPL-3.0"].encode(), known["MPL-2.0 header"].encode(), known["BSD-3-Clause"].encode()])
    assert [s.names[f[0][0]] for f in found] == ["Apache-2.0", "GPL-3.0", "MPL-2.0 header", "BSD-3-Clause"] and len(known) > 18


def test_bundles_of_licences():
    """Many licences after one another are each found where they first begin, in steps that grow with the text."""
    known = licences.templates_known()
    s = licences.Scanner()
    files = [n for n in licences.FULL if n.startswith(("Apache", "MPL", "LGPL"))]
    text, begins, at = [], {}, 0
    for n in files * 3:
        begins.setdefault(n, at)
        text.append(known[n])
        at += len(licences.bigrams([known[n].encode()])[0])
    found = {s.names[k]: (c, a) for k, c, a in s.scan([" ".join(text).encode()])[0]}
    assert all(found[n] == (1.0, begins[n]) for n in files)


def test_distinct_counts():
    rng = random.Random(3)
    pair = [rng.randrange(9) for _ in range(60)]
    own, some = licences.Bigrams(licences.np.array(pair, "u8")), licences.np.array([p < 4 for p in pair])
    for width in (1, 5, 59, 60, 80):
        assert own.distinct(width).tolist() == [len(set(pair[a : a + width])) for a in range(60)]
        assert own.distinct(width, some).tolist() == [len({p for p in pair[a : a + width] if p < 4}) for a in range(60)]
