"""Encoding and decoding with a public tokenizer's vocabulary, which is read from a path and never trained or changed."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# How the vocabulary's tokenizer splits text before merging bytes, and the special tokens in their order.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = ("<unk>", "<|begin_of_text|>", "<|end_of_text|>", "<|human|>", "<|assistant|>", "<|system|>", "<|end_turn|>")

_loaded: dict[int, object] = {}


def _encoding(raw: bytes):
    key = hash(raw)
    if key not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        top = max(ranks.values()) + 1
        _loaded[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={s: top + i for i, s in enumerate(SPECIAL)})
    return _loaded[key]


def special_tokens(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(token, place, id): ids behind those of the vocabulary, in a fixed order."""
    enc = _encoding(Path(vocabulary).read_bytes())
    return spark.createDataFrame([(s, i, enc._special_tokens[s]) for i, s in enumerate(SPECIAL)], "token string, place int, id int")


def resolve(spark: SparkSession, token: str, vocabulary: str = VOCABULARY) -> int:
    """The id of a special token; one that is missing is an error."""
    row = special_tokens(spark, vocabulary).where(F.col("token") == token).first()
    if row is None:
        raise KeyError(f"{token!r} is no special token")
    return row["id"]


def encode(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, special: bool = False, ends: bool = False) -> Column:
    """Token ids of a text, null for null. ``special`` reads special tokens in the text as such, ``ends`` sets those of begin and end around it."""
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # of fixed size

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(shared.value)
        first, last = (enc._special_tokens[SPECIAL[i]] for i in (1, 2))
        for s in batches:
            out = [None if t is None else enc.encode(t, allowed_special="all") if special else enc.encode_ordinary(t) for t in s]
            yield pd.Series([[first, *x, last] if ends and x is not None else x for x in out], dtype=object)

    return ids(text)


def decode(spark: SparkSession, ids: Column, vocabulary: str = VOCABULARY, special: bool = True) -> Column:
    """The text of token ids; without ``special`` the special tokens are left out."""
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(shared.value)
        low = min(enc._special_tokens.values())
        for s in batches:
            yield pd.Series([None if x is None else enc.decode([int(i) for i in x if special or i < low]) for x in s], dtype=object)

    return text(ids)


def count(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    return F.coalesce(F.size(encode(spark, F.coalesce(text, F.lit("")), vocabulary)), F.lit(0))


def fragmentation(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens for each word between white space."""
    from textmill.functions import text as X

    return count(spark, text, vocabulary) / F.greatest(F.size(X.plain_words(text)), F.lit(1))
