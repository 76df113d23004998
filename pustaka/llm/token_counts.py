"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pustaka.session import cut

#: The folder of the vocabulary files, and the file that is used.
TOKENIZERS = os.environ.get("PUSTAKA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How byte-level BPE of this kind splits text before merging. A fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are cut into stretches at white space before a letter or digit, where the splitter would cut them too.
LONG = 200_000


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _stretches(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > LONG:
        end = start + LONG
        while end > start + 1 and not (text[end - 1] != " " and text[end] == " " and text[end + 1 : end + 2].isalnum()):
            end -= 1
        end = start + LONG if end <= start + 1 else end
        yield text[start:end]
        start = end
    yield text[start:]


def token_counts(df: DataFrame, row_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """(doc_id, *keep, n_tokens): whole texts are counted; a null text has no tokens. Written once to the shared folder."""
    path = vocabulary or os.path.join(TOKENIZERS, VOCABULARY)
    rows = df.select(F.col(row_id).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kept = rows.drop("__text").columns

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or _encoding(path)
            texts = b.column(b.num_columns - 1).to_pylist()
            n = [len(enc.encode_ordinary(t)) if len(t) <= LONG else sum(len(enc.encode_ordinary(s)) for s in _stretches(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return cut(rows.mapInArrow(worker, rows.drop("__text").schema.add("n_tokens", "long")), "sizes")
