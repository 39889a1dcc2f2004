"""Converters of public instruction datasets to one conversation form, and message trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators.conversation import quality_score


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), X.collapse(X.normal_form(F.coalesce(content, F.lit("")), "NFKC")).alias("content"))


def build_example(df: DataFrame, source: str, category: Column, run: str) -> DataFrame:
    """id, source, language, category, conversation and score of rows with ``conversation``; ``run`` stands for the time in ids."""
    conv = F.col("conversation")
    language = X.detect_language(F.array_join(F.transform(conv, lambda t: t["content"]), " "))
    auto = F.concat_ws("-", F.lit(source), F.lit(run), F.substring(F.sha2(F.to_json(conv), 256), 1, 12))
    out = df.select(auto.alias("id"), F.lit(source).alias("source"), language.alias("language"), category.alias("category"), "conversation")
    return out.withColumn("quality_score", F.bround(quality_score(F.col("conversation"), F.col("language")), 4))


def from_dolly(df: DataFrame, system: str, run: str) -> DataFrame:
    ask = F.when(X.falsy_or(F.col("context")).isNotNull(), F.concat("instruction", F.lit("\n\nContext: "), "context")).otherwise(F.col("instruction"))
    rows = df.where("instruction <> '' and response <> ''")
    rows = rows.withColumn("conversation", F.array(turn("system", F.lit(system)), turn("user", ask), turn("assistant", F.col("response"))))
    return build_example(rows, "dolly", X.falsy_or(F.col("category"), F.lit("A")), run)


def from_alpaca(df: DataFrame, system: str, run: str) -> DataFrame:
    """Instruction, input, output; a heading of the answer and repeated marks are removed."""
    answer = F.regexp_replace(F.regexp_replace("output", r"(?i)^\s*(?:### Response:|الإجابة:|الرد:)\s*", ""), r"([!؟?.،])\1+", "$1")
    ask = F.when(X.falsy_or(F.col("input")).isNotNull(), F.concat("instruction", F.lit("\n"), "input")).otherwise(F.col("instruction"))
    rows = df.where("instruction <> '' and output <> ''").withColumn("conversation", F.array(turn("system", F.lit(system)), turn("user", ask), turn("assistant", answer)))
    return build_example(rows, "arabic_alpaca", F.lit("C"), run)


def flatten_trees(messages: DataFrame, system: str | None = None, first: str | None = None) -> DataFrame:
    """Conversations from the root to each leaf of message trees (message_id, parent_id, text, role): (leaf_id, conversation).

    Blank messages are passed over; paths of fewer than two turns are dropped; messages
    without a reachable root aren't found. Without any root the first row (the smallest
    ``message_id``, or ``first`` if given) is one. Trees are walked level by level with one
    join each; a message has one parent, so the walk ends with the deepest leaf.
    """
    m = messages.select(F.col("message_id").alias("id"), F.coalesce("parent_id", F.lit("")).alias("parent"), F.coalesce("text", F.lit("")).alias("text"), F.lower(F.coalesce("role", F.lit(""))).alias("role"))
    t = F.when(F.length(X.strip(F.col("text"))) > 0, F.array(F.struct(F.when(F.col("role").contains("assist"), "assistant").otherwise("user").alias("role"), X.collapse(F.col("text")).alias("content")))).otherwise(F.expr("cast(array() as array<struct<role:string,content:string>>)"))
    m = m.select("id", "parent", t.alias("own"))
    from textmill.session import cut

    leaves = m.join(m.select(F.col("parent").alias("id")).distinct(), "id", "left_anti").select("id")
    roots = m.where("parent = ''")
    if roots.isEmpty():
        roots = m.where(F.col("id") == F.lit(first)) if first is not None else m.join(F.broadcast(m.agg(F.min("id").alias("id"))), "id")  # one row
    level = cut(roots.select("id", F.col("own").alias("path"), F.col("id").alias("root")))
    done = []
    while True:
        done.append(level.join(leaves, "id", "left_semi"))
        # a message that leads back to its root is no new one
        level = cut(m.join(level.withColumnRenamed("id", "parent"), "parent").where("id <> root").select("id", F.concat("path", "own").alias("path"), "root"))
        if level.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    conv = F.concat(F.array(turn("system", F.lit(system))), F.col("path")) if system else F.col("path")
    return out.where("size(path) >= 2").select(F.col("id").alias("leaf_id"), conv.alias("conversation"))


def synthetic(df: DataFrame, template: str, slots: dict[str, list[str]], index: str = "id") -> DataFrame:
    """Fill ``{slot}`` by the values in turn: value number index modulo their count."""
    text = F.lit(template)
    for k, values in slots.items():
        text = F.replace(text, F.lit("{" + k + "}"), F.element_at(F.array(*map(F.lit, values)), (F.col(index) % len(values)).cast("int") + 1))
    return df.withColumn("text", text)
