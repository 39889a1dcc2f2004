"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest MD5 of ``key``; the same rows for any partitioning.

    Rows are counted and thinned by the hash first, so that partitions send few more rows
    than are kept, however many partitions there are.
    """
    h = F.md5(F.col(key).cast("string"))
    n = df.count()
    if n > 4 * rows:
        bound = format(int(min(1.0, 1.5 * rows / n) * 0xFFFFFFFF), "08x")
        df = df.where(F.substring(h, 1, 8) <= bound)
    return df.orderBy(h, key).limit(rows)
