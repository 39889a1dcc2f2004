"""Language probabilities by word profiles, for filters that expect a language.

A profile holds how often each word occurs in labelled texts of a language. A text's score
for a language is the sum of the log frequencies of its words, smoothed for words that the
language lacks; scores become probabilities over the languages of the profile. The profile
is of fixed size (``MAX_WORDS``, the most frequent) and is sent to the workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as X

MAX_WORDS = 100_000
SMOOTH = 0.5


def profile(samples: DataFrame, lang: Column, text: str = "text") -> DataFrame:
    """(lang, word, n) of labelled texts; null labels and texts take no part."""
    rows = samples.select(lang.alias("lang"), F.explode(X.lower_words(F.col(text))).alias("word")).where("lang is not null")
    return rows.groupBy("lang", "word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "word").limit(MAX_WORDS)


def detect(text: Column, words: DataFrame) -> Column:
    """A map of the probabilities of the profile's languages; null for text without a word of the profile."""
    rows = words.collect()  # at most MAX_WORDS
    langs = sorted({r["lang"] for r in rows})
    total = {x: sum(r["n"] for r in rows if r["lang"] == x) for x in langs}
    size = len({r["word"] for r in rows})
    base = np.array([np.log(SMOOTH / (total[x] + SMOOTH * size)) for x in langs])
    table: dict[str, np.ndarray] = {}
    for r in rows:
        v = table.setdefault(r["word"], base.copy())
        v[langs.index(r["lang"])] = np.log((r["n"] + SMOOTH) / (total[r["lang"]] + SMOOTH * size))
    shared = words.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("map<string,double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for s in batches:
            out = []
            for ws in s:
                hits = [known[w] for w in ws if w in known] if ws is not None else []
                if not hits:
                    out.append(None)
                    continue
                v = np.sum(hits, axis=0)
                e = np.exp(v - v.max())
                out.append(dict(zip(langs, (e / e.sum()).tolist())))
            yield pd.Series(out, dtype=object)

    return score(X.lower_words(text))


def with_probability(df: DataFrame, text: str, expected: Column, words: DataFrame, column: str = "probability") -> DataFrame:
    """Add the probability of the expected language: null if none is expected, 0 if nothing can be told."""
    p = detect(F.when(expected.isNotNull(), F.coalesce(F.col(text), F.lit(""))), words)
    return df.withColumn(column, F.when(expected.isNotNull(), F.coalesce(F.element_at(p, expected), F.lit(0.0))))
