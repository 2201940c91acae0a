"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Place of the vocabulary; every operator takes it as a parameter.
VOCABULARY = os.environ.get("PITLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file (a line of base64 token and rank for each); read once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text)) if text else 0


def _count_batches(batches, path: str):
    for b in batches:
        sizes = np.fromiter((count(t, path) for t in b.column("text").to_pylist()), dtype=np.int64, count=b.num_rows)
        yield b.drop_columns(["text"]).append_column("tokens", pa.array(sizes))


def with_tokens(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and `tokens`, the size of the whole text; a NULL or empty text has 0."""
    rows = documents.select(*keep, "text")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(partial(_count_batches, path=vocabulary), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens long")
