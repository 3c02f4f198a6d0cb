"""Pieces through the table of distinct chunks, with blocks so small that chunks and texts meet again over many."""

from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from terravet.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 20])
def test_blocks(spark, docs, block_bytes):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = docs.collect()
    expected = Counter()
    for r in rows:
        ids = sp.encode(r["text"] or "")
        expected[r["doc_id"], len(ids), tuple(ids), sp.decode(ids)] += 1
    got = pieces.tokenize_joined(docs, MODEL, block_bytes=block_bytes).collect()
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in got) == expected and len(got) == len(rows)


def test_texts_without_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in pieces.tokenize_joined(df, MODEL).collect()) == [(1, 0, [], ""), (2, 0, [], ""), (2, 0, [], "")]
