"""Problem 9: sources mixed to target shares, in the order of a time-varying curriculum.

The total is the largest at which every source can give its share of it with at most its
capped number of repeats. A source's weight changes linearly over the run and integrates
to its share; the integral, inverted at the cumulative tokens of each taken document,
gives the document's position, and documents are range-sorted by position. Cumulative
tokens are two-level prefix sums in the order of a hash, so that a source of any size is
spread over tasks.

Defined results: documents without tokens, with a null id or source, or of a source
without target take no part; sources are trimmed and lower-cased; a target without
documents, with a share or repeats of null or below, is left out and the other shares
are taken in proportion; repeated doc_ids count once; ties go by doc_id; empty tables
give empty results; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.prefix import prefix_sums
from textmill.session import bounded_broadcast, cut, shuffle_partitions

MAX_SOURCES = 10_000
SLOPE = 0.8
FILLS = 4  # rounds of filling; each leaves less than one document of the round before


def wanted(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents of a source with a target; for what is dear to work out for each document."""
    t = targets.where("target_share > 0 and max_repeats > 0").select(F.lower(F.trim("source")).alias("_s")).where("_s is not null").distinct()
    return docs.join(bounded_broadcast(t, MAX_SOURCES), F.lower(F.trim(docs["source"])) == F.col("_s"), "left_semi")


def plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source: share, available and demanded tokens, full passes, rest and slope of the weight."""
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.avg("tokens").alias("mean"))
    p = have.join(bounded_broadcast(t, MAX_SOURCES), "source")
    all_ = Window.partitionBy(F.lit(1))  # one row for each source
    p = p.withColumn("share", F.col("target_share") / F.sum("target_share").over(all_))
    p = p.withColumn("total", F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(all_))
    p = p.withColumn("demand", F.least(F.col("share") * F.col("total"), (F.col("available") * F.col("max_repeats")).cast("double")))
    p = p.withColumn("passes", F.floor(F.round(F.col("demand") / F.col("available"), 9))).withColumn("rest", F.greatest(F.col("demand") - F.col("passes") * F.col("available"), F.lit(0.0)))
    # sources of short documents come early: slopes follow the rank of the mean length and cancel out over the shares
    p = p.withColumn("r", F.percent_rank().over(all_.orderBy("mean", "source")))
    p = p.withColumn("r", F.col("r") - F.sum(F.col("share") * F.col("r")).over(all_))
    top = F.max(F.abs("r")).over(all_)
    p = p.withColumn("slope", F.when(top > 0, F.col("r") * SLOPE / top).otherwise(0.0))
    return p.select("source", "target_share", "max_repeats", "available", "demand", "passes", "rest", "slope")


def _gaps(run: DataFrame) -> DataFrame:
    """(source, gap): the tokens of the last pass that taken documents leave open; one row for each source."""
    return run.groupBy("source").agg(F.max("rest").alias("r"), F.sum(F.when(F.col("inside"), F.col("tokens")).otherwise(0)).alias("s")).select("source", (F.col("r") - F.col("s")).alias("gap"))


def mix(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mix (doc_id, source, tokens).

    Returns the chosen documents (doc_id, source, repeat_no, tokens, position), sorted by
    position from 0 to 1, and the plan.
    """
    docs = docs.where("doc_id is not null and source is not null and tokens > 0").select("doc_id", F.lower(F.trim("source")).alias("source"), "tokens").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))
    docs = cut(docs)
    wanted = cut(plan(docs, targets))
    p = bounded_broadcast(wanted, MAX_SOURCES)
    run = prefix_sums(docs.join(p.select("source"), "source", "left_semi").withColumn("h", F.xxhash64("doc_id")), ["source"], ["h", "doc_id"], {"before": F.col("tokens")})
    run = cut(run.drop("before_total").join(p, "source").withColumn("inside", F.col("before") + F.col("tokens") <= F.col("rest")))
    run = run.withColumn("fill", F.lit(False))
    # what the whole documents of the last pass leave open is filled by further ones that fit, in the same order
    for _ in range(FILLS):
        left = run.where("not inside").join(bounded_broadcast(_gaps(run), MAX_SOURCES), "source").where("tokens <= gap").select("source", "h", "doc_id", "tokens", "gap")
        if left.isEmpty():
            break
        more = prefix_sums(left, ["source"], ["h", "doc_id"], {"b": F.col("tokens")}).where("b + tokens <= gap").select("doc_id", F.lit(True).alias("_more"))
        hit = F.col("_more").isNotNull()
        run = cut(run.join(more, "doc_id", "left").withColumns({"inside": F.col("inside") | hit, "fill": F.col("fill") | hit}).drop("_more"))
    # and the rest by the one document that comes nearest
    last = run.where("not inside").join(bounded_broadcast(_gaps(run), MAX_SOURCES), "source").where("abs(tokens - gap) < gap").groupBy("source").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("gap")).alias("miss"), "doc_id")).alias("b")).select("source", F.col("b.doc_id").alias("last_id"))
    run = run.join(bounded_broadcast(last, MAX_SOURCES), "source", "left")
    final = F.coalesce(F.col("doc_id") == F.col("last_id"), F.lit(False))
    run = run.withColumn("fill", F.col("fill") | final)
    taken = F.col("passes") + (F.col("inside") | final).cast("bigint")
    rows = run.withColumn("taken", taken.cast("int")).where("taken > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)))
    # documents that fill a gap stand anywhere in their source's run
    anywhere = (F.pmod(F.xxhash64(F.lit("fill"), "doc_id"), F.lit(1 << 32)) + 0.5) / float(1 << 32)
    u = F.when(F.col("fill") & (F.col("repeat_no") == F.col("passes")), anywhere).otherwise(F.least((F.col("repeat_no") * F.col("available") + F.col("before") + F.col("tokens") / 2) / F.col("demand"), F.lit(1.0)))
    a = F.col("slope")
    position = F.when(F.abs(a) < 1e-9, u).otherwise((-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u)) / (2 * a))
    rows = rows.select("doc_id", "source", "repeat_no", "tokens", position.alias("position"))
    return rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id"), wanted


def shares(mixed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_repeats, tokens, actual_share)."""
    got = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), (F.max("repeat_no") + 1).alias("most_repeats"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row for each source
    return got.join(bounded_broadcast(wanted.select("source", "target_share", "max_repeats"), MAX_SOURCES), "source").withColumn("actual_share", F.col("tokens") / total)
