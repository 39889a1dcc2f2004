"""Sizes of texts in tokens of a public tokenizer, which is read from a path and never changed."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[int, object] = {}


def _encoding(raw: bytes):
    key = hash(raw)
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _loaded[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def with_tokens(df: DataFrame, column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replace ``column`` by ``tokens`` BIGINT; null text has 0 tokens. The vocabulary file (of fixed size) is sent from the driver."""
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(shared.value)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn("tokens", count(column)).drop(column)
