"""Ranked and paged retrieval, tags, and changes to stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators.prefix import prefix_sums


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page in ``order`` with the ``total`` of all rows, which is one number."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def like_search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Case-insensitive LIKE over several columns; wildcards in the query count as such, an empty query finds all."""
    if not query:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return df.where(hit)


def recency_boost(ts: Column, now: str) -> Column:
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86400e6
    return F.exp(-F.greatest(F.lit(0.0), days) / 90.0)


def ranked_memories(items: DataFrame, query: str, now: str, candidates: int, k: int) -> DataFrame:
    """The ``k`` best of each user's ``candidates`` newest memories: (user_id, id, score, place)."""
    new = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc())
    rows = items.where("user_id is not null").withColumn("_r", F.row_number().over(new)).where(F.col("_r") <= candidates)
    hay = F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")), F.coalesce("tags_csv", F.lit("")))
    h, q = X.memory_tokens(hay), X.memory_tokens(F.lit(query))
    near = F.when((F.size(h) == 0) | (F.size(q) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(h, q)) / F.size(F.array_union(h, q)))
    inside = F.lower(hay).contains(query.lower()).cast("int") if query else F.lit(0)
    score = 0.75 * near + 0.15 * inside + 0.10 * F.coalesce(recency_boost(F.col("updated_at"), now), F.lit(0.0))
    best = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("updated_at").desc_nulls_last(), F.col("id").desc())
    return rows.withColumn("score", score).where("score > 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("user_id", "id", "score", "place")


def csv_to_tags(csv: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def tags_to_csv(tags: Column) -> Column:
    """Trimmed tags without blanks and without repeats in another case; the first spelling stays."""
    clean = F.filter(F.transform(tags, lambda x: F.trim(F.replace(x, F.lit(","), F.lit(" ")))), lambda x: x != "")
    return F.array_join(F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1), ",")


def section_label(ts: Column, now: str) -> Column:
    days = F.date_diff(F.lit(now).cast("date"), ts.cast("date"))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.date_format(ts, "yyyy-MM-dd"))


def update(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], now: str) -> DataFrame:
    """Partial update: a null in ``changes`` keeps the old value; changed rows get ``updated_at`` = ``now``."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = rows.join(new, key, "left")
    sets = {c: F.coalesce(f"_n_{c}", c) for c in columns}
    sets["updated_at"] = F.when(F.col("_hit"), F.lit(now).cast(rows.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))
    return out.withColumns(sets).select(*rows.columns)


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append_rows(rows: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Append rows with keys behind the largest, in ``order`` (that of the rows if not given)."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    if order is None:
        new, order = new.withColumn("_o", F.monotonically_increasing_id()), ["_o"]
    numbered = prefix_sums(new, [], order, {"_i": F.lit(1)}).drop("_i_total", "_o")
    return rows.unionByName(numbered.crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_i") + 1).drop("_top", "_i"), allowMissingColumns=True)  # one row


def add_missing(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(kind))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; entries of the second win."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)
