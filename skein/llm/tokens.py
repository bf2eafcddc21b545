"""Token counts with the files of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the file used; both are parameters.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters after which a text handed to the tokenizer is cut at the next lone space.
CHUNK = 100_000
_LONE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
# Fixed value: the pattern that the vocabulary's byte-level BPE splits text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str):
    """The encoding of a vocabulary file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str) -> int:
    """Tokens of a whole text; long texts are encoded in chunks.

    Chunks end before a lone space between words, where the pattern always begins a new piece, so
    the count is that of the text as a whole; a stretch without such a space is one chunk.
    """
    enc, total, at = encoding(path), 0, 0
    while at < len(text):
        m = _LONE.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = m.start() if m else len(text)
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def with_tokens(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens): the size of each text; null and empty texts have 0 tokens."""
    path = path or f"{TOKENIZERS}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(t, path) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
