"""Conversations as arrays of turns: scoring, fingerprints, checks and training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as X

# Patterns that lower the score.
RISKY = ("build a bomb", "make explosives", "hack account", "قتل", "تفجير", "اختراق")
END_TURN = "<|end_turn|>"
BOS, EOS = "<|begin_of_text|>", "<|end_of_text|>"


def _content(t: Column) -> Column:
    return F.coalesce(t["content"], F.lit(""))


def clean_turns(conv: Column) -> Column:
    """Turns (role, content) with contents in NFKC and white space collapsed; what the other functions here expect."""
    texts = X.normal_forms(F.transform(conv, _content), "NFKC")
    return F.zip_with(conv, texts, lambda t, c: F.struct(t["role"].alias("role"), X.collapse(c).alias("content")))


def map_role(role: Column) -> Column:
    r = F.lower(X.strip(role))
    return F.when(r.isin("user", "human"), "human").when(r == "system", "system").when(r == "assistant", "assistant")


def detect_conversation_language(conv: Column) -> Column:
    return X.detect_language(F.array_join(F.transform(conv, _content), " "))


def quality_score(conv: Column, language: Column) -> Column:
    """Structure, language agreement, answer length and risk in 0 to 1, unrounded; null or empty conversations score 0."""
    n = F.size(conv)
    valid = F.size(F.filter(conv, lambda t: F.coalesce(t["role"].isin("system", "user", "assistant"), F.lit(False)) & (F.length(_content(t)) > 0)))
    answers = F.filter(conv, lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    mean = F.aggregate(answers, F.lit(0), lambda a, t: a + F.length(_content(t))) / F.greatest(F.size(answers), F.lit(1))
    blob = F.array_join(F.transform(conv, lambda t: F.lower(_content(t))), " ")
    hits = F.lit(0)
    for r in RISKY:
        hits = hits + blob.contains(r).cast("int")
    agree = F.coalesce(F.coalesce(language, F.lit("")) == detect_conversation_language(conv), F.lit(False))
    score = 0.35 * (valid / F.greatest(n, F.lit(1))) + F.when(agree, 0.25).otherwise(0.12) + 0.25 * F.least(mean / 180.0, F.lit(1.0)) + F.greatest(0.15 - 0.05 * hits, F.lit(0.0))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))).otherwise(F.lit(0.0))


def fingerprint(conv: Column) -> Column:
    """SHA-256 of roles and lower-cased contents; contents are normalised first."""
    parts = F.transform(clean_turns(conv), lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("::"), F.lower(_content(t))))
    return F.sha2(F.array_join(parts, "\n"), 256)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Exact duplicates: the first row of each key. Groups of copies are reduced before the shuffle."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*").select(*df.columns)


def is_valid(conv: Column) -> Column:
    """A system turn stands first, if at all."""
    return ~F.exists(F.slice(conv, 2, F.greatest(F.size(conv), F.lit(1))), lambda t: F.coalesce(t["role"] == "system", F.lit(False)))


def format_turns(conv: Column) -> Column:
    turns = F.filter(conv, lambda t: map_role(t["role"]).isNotNull())
    return F.concat(F.lit(BOS + "\n"), F.array_join(F.transform(turns, lambda t: F.concat(F.upper(map_role(t["role"])), F.lit("\n"), _content(t), F.lit("\n" + END_TURN))), "\n"), F.lit("\n" + EOS))


def last_assistant(conv: Column) -> Column:
    """The last position (from 0) of an assistant turn, or null."""
    at = F.transform(conv, lambda t, i: F.when(F.coalesce(map_role(t["role"]) == "assistant", F.lit(False)), i))
    return F.array_max(at)


def history_tail(conv: Column, n: int = 20) -> Column:
    return F.when(F.size(conv) > n, F.slice(conv, -n, n)).otherwise(conv)


def training_sample(conv: Column, max_len: int) -> dict[str, Column]:
    """Token lists of the prompt and of the last answer, cut from the left, and labels of -100 on the prompt."""
    last = last_assistant(conv)
    before = F.filter(F.slice(conv, 1, F.greatest(last, F.lit(0))), lambda t: map_role(t["role"]).isNotNull())
    prompt = F.concat(F.array(F.lit(BOS)), F.flatten(F.transform(before, lambda t: F.concat(F.array(F.upper(map_role(t["role"]))), X.words(_content(t)), F.array(F.lit(END_TURN))))), F.array(F.lit("ASSISTANT")))
    answer = F.concat(X.words(_content(conv[last])), F.array(F.lit(END_TURN)))
    both = F.concat(prompt, answer)
    n = F.size(both)
    cut = lambda c: F.slice(c, F.greatest(n - max_len + 1, F.lit(1)), max_len)
    labels = F.concat(F.array_repeat(F.lit("-100"), F.size(prompt)), answer)
    return {"input_tokens": cut(both), "label_tokens": cut(labels)}


def turn_ends(messages: DataFrame) -> DataFrame:
    """First and last message of each conversation, by (created_at, id); partial aggregates, no group is gathered."""
    key = F.struct("created_at", "id")
    return messages.where("conversation_id is not null and created_at is not null").groupBy("conversation_id").agg(F.count_distinct("id").alias("messages"), F.min(key).alias("a"), F.max(key).alias("b")).select("conversation_id", "messages", F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"))


def newest(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the planner cuts groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
