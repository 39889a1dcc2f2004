"""Filters on text quality, and predicates on content."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as X

# Harmful keywords.
HARMFUL = ("bomb", "weapon", "kill", "murder", "explosive", "malware", "phishing", "steal password", "suicide", "harm yourself", "قنبلة", "سلاح", "قتل", "انتحار", "اختراق", "برمجية خبيثة")


@F.pandas_udf(T.DoubleType())
def _top_char(s: pd.Series) -> pd.Series:
    def share(t: str | None) -> float | None:
        if not t:
            return None if t is None else 0.0
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        return int(np.unique(code, return_counts=True)[1].max()) / len(code)

    return s.map(share)


def top_char_share(text: Column) -> Column:
    """Share of the most frequent character, spaces included; counted over code points, in Arrow batches."""
    return _top_char(text)


def quality_measures(text: Column) -> dict[str, Column]:
    t = X.strip(F.coalesce(text, F.lit("")))
    words = X.lower_words(t)
    symbols = F.length(F.regexp_replace(t, rf"[\p{{L}}{X.WS_CLASS}]", ""))
    return {
        "length": F.length(t),
        "top_char": top_char_share(t),
        "words": F.size(words),
        "unique_words": X.share(F.size(F.array_distinct(words)), F.size(words)),
        "symbols": X.share(symbols, F.length(t)),
    }


def quality_filter(text: Column, min_length: int = 30, max_repetition: float = 0.30, min_unique: float = 0.25, max_symbols: float = 0.35, probability: Column | None = None, min_probability: float = 0.80) -> Column:
    """True for text to keep. Null text is dropped; bounds themselves pass.

    Cheap tests run in the JVM; only what passes them has its characters counted.
    ``probability`` is that of the expected language (``language.with_probability``); null
    stands for no expected language and passes.
    """
    t = X.strip(F.coalesce(text, F.lit("")))

    def of(t: Column) -> Column:
        symbols = F.length(F.regexp_replace(t, rf"[\p{{L}}{X.WS_CLASS}]", ""))
        words = X.let(X.lower_words(t), lambda w: (F.size(w) >= 1) & (X.share(F.size(F.array_distinct(w)), F.size(w)) >= min_unique))
        return (F.length(t) >= min_length) & (X.share(symbols, F.length(t)) <= max_symbols) & words

    fine = X.let(t, of)
    if probability is not None:
        fine = fine & F.coalesce(probability >= min_probability, F.lit(True))
    return fine & (F.coalesce(top_char_share(F.when(fine, t)), F.lit(0.0)) <= max_repetition)


def looks_unusable(text: Column) -> Column:
    t = X.collapse(F.coalesce(text, F.lit("")))
    solid = F.regexp_replace(t, X.WS, "")
    n = F.length(solid)
    words = X.words(t)
    unique = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    alpha = F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    other = F.length(F.regexp_replace(solid, r"[\p{L}\p{N}]", ""))
    return (F.length(t) < 20) | (n == 0) | (X.share(alpha, n) < 0.35) | (X.share(other, n) > 0.45) | (F.size(words) < 4) | ((unique < 0.45) & (F.size(words) >= 8))


def is_harmful(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for k in HARMFUL:
        out = out | low.contains(k)
    return out
