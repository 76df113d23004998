"""Sizes in tokens."""

from __future__ import annotations

import os

from pustaka.llm import token_counts as T


def test_counts(spark):
    enc = T._encoding(os.path.join(T.TOKENIZERS, T.VOCABULARY))
    texts = ["plain text", "हाल के वर्षों में", "", None, "word " * 90000, "x" * 250000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(df, keep=("source",)).collect()}
    assert [got[i] for i in range(4)] == [len(enc.encode_ordinary(t or "")) for t in texts[:4]]
    assert got[4] == len(enc.encode_ordinary(texts[4])) and got[5] > 0
