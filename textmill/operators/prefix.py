"""Ordered operators over groups of any size: two-level prefix sums.

A plain window puts a whole group into one task. Here the rows are range-sorted, so
that a hot group is spread over many partitions; sums run within each partition and
the totals of the partitions before it (a few numbers for each partition) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.session import cut, shuffle_partitions

PID = "_pid"


def ranges_for(spark: SparkSession) -> int:
    """The number of ranges to cut a frame into: the shuffle's partitions, four for each core at least."""
    return max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int | None = None) -> DataFrame:
    """Range-sort by ``keys`` and ``order`` and add ``_pid``, the chunk of each row.

    The result is checkpointed: chunk numbers come from sampled bounds and must not
    change when a lost partition is computed again.
    """
    n = n or shuffle_partitions(df.sparkSession)
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    return cut(df.repartitionByRange(n, *cols).withColumn(PID, F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, Column],
    n: int | None = None,
    chunked: bool = False,
) -> DataFrame:
    """Add running sums in ``order`` within each group of ``keys``.

    ``sums`` maps a new column ``x`` to the summed expression; ``x`` is the sum over
    all rows before this one and ``x_total`` the sum over the whole group. ``order``
    must be total (end in a unique column) for a repeatable result. No row is lost;
    a null summand counts as 0.
    """
    keys = list(keys)
    ranged = df if chunked else range_chunks(df, keys, order, n)
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    for name, e in sums.items():
        ranged = ranged.withColumn(f"_v_{name}", F.coalesce(e, F.lit(0)))
    totals = ranged.groupBy(*keys, PID).agg(*[F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums])
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = over.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(PID).alias("_kp"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(over).alias(f"{s}_total") for s in sums],
    )
    local = Window.partitionBy(*keys, PID).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"_l_{s}": F.coalesce(F.sum(f"_v_{s}").over(local), F.lit(0)) for s in sums})
    on = (F.col(PID) == F.col("_kp"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(totals, on)
    for s in sums:
        out = out.withColumn(s, F.col(f"_l_{s}") + F.col(f"_o_{s}"))
    drop = [f"_{a}_{s}" for a in "vlo" for s in sums] + [f"_k{i}" for i in range(len(keys))] + ["_kp", PID]
    return out.drop(*drop)
