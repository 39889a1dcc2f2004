"""Training samples of token ids: packed, supervised and collated, and generators of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators.sequence import pack

IGNORED = -100
# Endings of generated questions.
STYLES = ("بصياغة بسيطة.", "مع نقاط سريعة.", "بشكل مختصر.", "مع مثال صغير.")
LEAST_EXAMPLES = 500


def packed_samples(docs: DataFrame, order: list[str], ids: str, width: int, drop_last: bool = False) -> DataFrame:
    """Documents one behind the other, cut every ``width`` ids: (sample, input_ids, labels, doc_uids).

    Labels are the ids themselves; ``doc_uids`` tells for each id the place of its document
    (empty ones have places too), so that a mask can keep documents apart. A group is one
    sample of ``width`` ids.
    """
    from textmill.operators.prefix import prefix_sums

    rows = prefix_sums(docs, [], order, {"uid": F.lit(1)}).drop("uid_total").withColumn("_n", F.coalesce(F.size(ids), F.lit(0)).cast("bigint"))
    parts = pack(rows, order, "_n", width)
    piece = F.slice(ids, (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    parts = parts.select("sample", F.struct("uid", piece.alias("ids")).alias("p"))
    out = parts.groupBy("sample").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    tokens = F.flatten(F.transform("ps", lambda p: p["ids"]))
    out = out.select("sample", tokens.alias("input_ids"), tokens.alias("labels"), F.flatten(F.transform("ps", lambda p: F.array_repeat(p["uid"], F.size(p["ids"])))).alias("doc_uids"))
    return out.where(F.size("input_ids") == width) if drop_last else out


def supervised(prompt: Column, answer: Column, length: int) -> tuple[Column, Column]:
    """Ids and labels of a prompt and its answer, cut from the left; labels ignore the prompt."""
    both = F.concat(prompt, answer)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer)
    start = F.greatest(F.size(both) - length + 1, F.lit(1))
    return F.slice(both, start, length), F.slice(labels, start, length)


def collate(rows: DataFrame, batch: str, pads: dict[str, int]) -> DataFrame:
    """Pad the arrays named in ``pads`` to the longest of their batch and add ``attention_mask``. A batch is small."""
    first = next(iter(pads))
    widest = rows.groupBy(batch).agg(F.max(F.size(first)).alias("_w"))
    rows = rows.join(widest, batch).withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(first)), F.array_repeat(F.lit(0), F.col("_w") - F.size(first))))
    return rows.withColumns({c: F.concat(c, F.array_repeat(F.lit(v), F.col("_w") - F.size(c))) for c, v in pads.items()}).drop("_w")


def shuffle_take(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """A share of the rows, one at least, in an order drawn by ``seed``; the number is the feature."""
    n = max(1, int(df.count() * ratio))
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cap_written(df: DataFrame, keep: Column, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows that are kept; rows that are left out don't count."""
    return df.where(keep).orderBy(*order).limit(n)


def checkpoint_step(path: Column) -> Column:
    """The step in a name such as ``pretrain_step_120.pt``; -1 if there is none."""
    return F.coalesce(F.regexp_extract(path, r"_step_([+-]?[0-9]+)(?:[.][^./]*)?$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))


def latest_checkpoint(df: DataFrame, path: str) -> DataFrame:
    """One row: the path of the largest step, by name among equals."""
    return df.agg(F.max_by(path, F.struct(checkpoint_step(F.col(path)), path)).alias("path"), F.max(checkpoint_step(F.col(path))).alias("step"))


def identity_examples(spark: SparkSession, seeds: dict[str, list[str]], each: int, seed: int = 42) -> DataFrame:
    """(category, idx, user): ``each`` questions of a category, its prompts in turn and an ending chosen by a hash."""
    if each < LEAST_EXAMPLES:
        raise ValueError(f"at least {LEAST_EXAMPLES} examples of each category")
    if empty := [c for c, p in seeds.items() if not p]:
        raise ValueError(f"unknown categories: {empty}")
    rows = spark.range(each).select(F.col("id").alias("idx")).crossJoin(F.broadcast(spark.createDataFrame(list(seeds.items()), "category string, prompts array<string>")))  # few categories
    style = F.element_at(F.array(*map(F.lit, STYLES)), (X.hash32(F.concat(F.lit(f"{seed}|"), "category", F.lit("|"), F.col("idx").cast("string"))) % len(STYLES) + 1).cast("int"))
    prompt = F.element_at("prompts", (F.col("idx") % F.size("prompts") + 1).cast("int"))
    return rows.select("category", "idx", F.concat(prompt, F.lit(" "), style).alias("user"))
