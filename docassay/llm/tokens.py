"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the vocabulary; both are parameters.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this vocabulary splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The tokenizer of this process."""
    path = os.path.join(folder, vocabulary)
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


# Fixed value: what the tokenizer takes for white space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of white space from this length on are taken out before splitting, as the splitter can't hold very long ones.
_RUN = re.compile(f"[{_WHITE}]{{1000,}}")


def count_tokens(text: str, own) -> int:
    """Tokens of a whole text, whatever its length.

    A run of white space is one piece up to its last character, which belongs to the word behind it, so
    a text may be cut there without changing any piece.
    """
    total, at = 0, 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(own.encode_ordinary(text[at : m.start()])) + len(own._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(own.encode_ordinary(text[at:] if at else text))


def sized(documents: DataFrame, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens); a null text has no size and gives no row, an empty one has size 0."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(folder, vocabulary)
        for batch in batches:
            n = [count_tokens(t, own) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), "text").mapInArrow(size, "doc_id bigint, source string, n_tokens bigint")
