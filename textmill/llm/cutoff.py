"""Problem 7: a score cutoff for each source that keeps a target fraction.

Rows are counted by source and score, range-sorted by source and falling score, and
counted by partition and source; prefix sums of these few counts locate the rows around
the target, of which the exact one is read. No source is gathered in one task, since
a source is spread over partitions by its scores and equal scores are one row.

Defined results: scores that are null, NaN or outside ``low`` to ``high`` aren't counted;
a null source or id takes no part; repeated rows count once; equal scores are kept or
left together; of two scores equally near the target the higher is the cutoff; a source
without countable rows, or without a target, has no cutoff; empty tables give an empty
result; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.prefix import prefix_sums
from textmill.session import bounded_broadcast


def countable(df: DataFrame, source: str = "source", score: str = "quality_score", id_col: str = "id", low: float = 0.0, high: float = 1.0) -> DataFrame:
    s = F.col(score)
    ok = s.isNotNull() & ~F.isnan(s) & s.between(low, high)
    return df.where(ok).select(F.lower(F.trim(source)).alias("source"), F.col(id_col).alias("id"), (s + F.lit(0.0)).alias("score")).where("source is not null and id is not null")


def cutoffs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source: target_fraction, n, cutoff, kept, kept_share. ``rows`` come from ``countable``."""
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_fraction").where("source is not null and target_fraction is not null").groupBy("source").agg(F.max("target_fraction").alias("target_fraction"))
    t = bounded_broadcast(t)
    counts = rows.join(t, "source").distinct().groupBy("source", "score", "target_fraction").agg(F.count("*").alias("c"))
    run = prefix_sums(counts, ["source"], [F.col("score").desc()], {"before": F.col("c")})
    run = run.withColumn("kept", F.col("before") + F.col("c"))
    miss = F.round(F.abs(F.col("kept") - F.col("target_fraction") * F.col("before_total")), 6)
    best = run.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), (-F.col("score")).alias("minus"), "kept", F.col("before_total").alias("n"), "target_fraction")).alias("b"))
    return best.select("source", "b.target_fraction", "b.n", (-F.col("b.minus")).alias("cutoff"), "b.kept", (F.col("b.kept") / F.col("b.n")).alias("kept_share"))


def keep(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The kept rows (source, id, score)."""
    return rows.join(bounded_broadcast(cuts.select("source", "cutoff")), "source").where("score >= cutoff").select("source", "id", "score").distinct()
