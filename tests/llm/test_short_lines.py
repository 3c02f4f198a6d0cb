"""The lines query on lines too short for stretches, against a plain version over all pairs."""

from collections import defaultdict

import corpus_pipeline
import pytest

from terravet.llm import queries

TEXTS = ["Menu\nsome longer line of this page\nRead more", "menu\n\n}\nRead more\n日本語", "日本語\n}\n\nabcdefghijk", "abcdefghijkl\nMenu!\nabc\nread  more\naaaaaaaaa", "aaaaaaaaaaaaaaaa\nABC\nMenu\nRead\nabcdefg", None, "", "\n"]


def plain(texts):
    """Texts and numbers of removed lines; a line of 8 bytes or more is its set of stretches, a shorter one itself."""
    at = {(d, n): x for d, t in enumerate(texts) if t is not None for n, x in enumerate(t.encode().split(b"\n")) if x}
    sets = {p: frozenset(x.lower()[k : k + 8] for k in range(max(1, len(x) - 7))) for p, x in at.items()}
    component = {p: p for p in at}
    for p in sorted(at):
        for q in sorted(at):
            if q < p and 100 * len(sets[p] & sets[q]) >= 80 * len(sets[p] | sets[q]) and component[p] != component[q]:
                a, b = sorted((component[p], component[q]))
                component = {k: a if c == b else c for k, c in component.items()}
    gone = defaultdict(set)
    for p, c in component.items():
        if p != c:
            gone[p[0]].add(p[1])
    return {d: (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]), len(gone[d])) for d, t in enumerate(texts)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("short"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_short_lines(spark, folder):
    expected = plain(TEXTS)
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_lines"](spark, folder).collect()}
    assert len(got) == len(TEXTS) and sum(r["n_removed"] for r in got.values()) > 6
    assert {d: r["n_removed"] for d, r in got.items()} == {d: n for d, (_, n) in expected.items()}
    kept = corpus_pipeline.distinct_lines(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {d: t for d, (t, n) in expected.items() if not n or t.strip()}
