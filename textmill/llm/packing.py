"""Problem 8: documents into containers of fixed capacity, by linear grouping.

A document above the capacity is split into full containers and a rest; nothing else is
split. Large items (over a quarter of the capacity) are ranked by size and cut into
``GROUPS`` groups of equal cardinality; each group's sizes are rounded up to its largest.
For these few sizes the best configurations are found by linear programming over all
ways to fill a container, rounded, and completed greedily. Actual documents then take the
places of their group by rank, and small items go best-fit into the space that is left,
in buckets of bounded size chosen by a hash.

The driver sees only one row for each group and limit. Ranks are two-level prefix sums,
so that no size or limit is gathered in one task.

Defined results: a null text has no tokens and takes no space, but has a container; a
null doc_id or capacity takes no part, nor does a capacity below 1; repeated doc_ids are
packed once, with the most tokens of their rows; equal sizes go by doc_id; an empty
table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.prefix import prefix_sums
from textmill.session import bounded_broadcast, cut

GROUPS = 24
SMALL_PART = 4  # items of at most 1/4 of the capacity are small
BUCKET_ROWS = 20_000
MAX_LIMITS = 1_000


def configurations(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to put up to three of ``sizes`` into a container, as counts by size."""
    k = len(sizes)
    rows = []
    for a in range(k):
        rows.append((a,))
        for b in range(a, k):
            if sizes[a] + sizes[b] <= capacity:
                rows.append((a, b))
                rows += [(a, b, c) for c in range(b, k) if sizes[a] + sizes[b] + sizes[c] <= capacity]
    out = np.zeros((len(rows), k))
    for i, r in enumerate(rows):
        for j in r:
            out[i, j] += 1
    return out


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, so that all items have a place; few containers.

    The linear program is solved by the revised simplex method over all configurations;
    its solution is rounded down, and what is left is placed in the fullest configurations.
    """
    keep = counts > 0
    index = np.flatnonzero(keep)
    s, n = sizes[keep].astype(float), counts[keep].astype(float)
    if not len(s):
        return []
    a = configurations(s, capacity)
    basis = [int(np.flatnonzero((a.sum(1) == a[:, j]) & (a[:, j] == a[a.sum(1) == a[:, j], j].max()))[0]) for j in range(len(s))]
    for _ in range(2_000):
        b = a[basis].T
        x, y = np.linalg.solve(b, n), np.linalg.solve(b.T, np.ones(len(s)))
        price = a @ y
        enter = int(price.argmax())
        if price[enter] <= 1 + 1e-9:
            break
        d = np.linalg.solve(b, a[enter])
        ratio = np.where(d > 1e-12, x / np.where(d > 1e-12, d, 1), np.inf)
        basis[int(ratio.argmin())] = enter
    use: dict[int, int] = {}
    left = n.copy()
    for i, v in zip(basis, x):
        if (m := int(v + 1e-9)) > 0:
            use[i] = use.get(i, 0) + m
            left -= m * a[i]
    left = np.maximum(left, 0)
    fill = a @ s
    while left.any():
        fits = (a <= left).all(1)
        i = int(np.where(fits, fill, -1).argmax())
        m = int(min(left[j] // a[i, j] for j in range(len(s)) if a[i, j]))
        use[i] = use.get(i, 0) + m
        left -= m * a[i]
    out = []
    for i, m in sorted(use.items()):
        row = np.zeros(len(sizes), dtype=int)
        row[index] = a[i].astype(int)
        out.append((row, m))
    return out


def best_fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Small items of one bucket into the open containers of the bucket, largest first, each where least space is left."""
    bins = part[part["doc_id"].isna()].sort_values("container")
    items = part[part["doc_id"].notna()].sort_values(["size", "doc_id", "piece"], ascending=[False, True, True])
    limit, bucket = int(key[0]), int(key[1])
    capacity = int(part["capacity"].iloc[0])
    free = sorted((int(f), i) for i, f in enumerate(bins["size"]))
    names = bins["container"].tolist()
    chosen = []
    for size in items["size"]:
        at = bisect_left(free, (int(size), -1))
        if at < len(free):
            f, i = free.pop(at)
        else:
            f, i = capacity, len(names)
            names.append(f"s-{bucket}-{len(names)}")
        chosen.append(names[i])
        insort(free, (f - int(size), i))
    return pd.DataFrame({"limit_id": limit, "doc_id": items["doc_id"].astype("int64"), "piece": items["piece"].astype("int32"), "size": items["size"].astype("int64"), "container": chosen})


def pack(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers of (doc_id, tokens) for each (limit_id, capacity_tokens).

    Result: (limit_id, doc_id, piece, size, container); ``piece`` numbers the parts of a
    split document from 0 and ``container`` is unique within its limit.
    """
    spark = docs.sparkSession
    if limits.count() > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits: each document is placed once for each")
    limits = bounded_broadcast(limits.where("limit_id is not null and capacity_tokens > 0").select(F.col("limit_id").cast("int").alias("limit_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct(), MAX_LIMITS)
    # one row for each limit and document, without texts
    docs = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    each = docs.crossJoin(limits)
    pieces = each.where("tokens > capacity").select("limit_id", "doc_id", F.posexplode(F.array_repeat("capacity", F.expr("int(tokens div capacity)"))).alias("piece", "size"))
    whole = pieces.select("limit_id", "doc_id", "piece", "size", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"))
    items = each.select(
        "limit_id", "capacity", "doc_id",
        F.when(F.col("tokens") > F.col("capacity"), F.expr("int(tokens div capacity)")).otherwise(0).alias("piece"),
        F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")).alias("size"),
    ).where("size > 0 or piece = 0")
    large = items.where(F.col("size") * SMALL_PART > F.col("capacity"))
    ranked = prefix_sums(large, ["limit_id"], [F.col("size").desc(), "doc_id"], {"rank": F.lit(1)})
    ranked = cut(ranked.withColumn("grp", F.expr(f"int(rank * {GROUPS} div rank_total)")))
    # a row for each limit and group
    table = ranked.groupBy("limit_id", "grp").agg(F.max("size").alias("size"), F.min("rank").alias("first"), F.count("*").alias("n"), F.max("capacity").alias("capacity")).collect()
    slots = []
    for limit in sorted({r["limit_id"] for r in table}):
        own = sorted((r for r in table if r["limit_id"] == limit), key=lambda r: r["grp"])
        used = np.zeros(len(own), dtype=np.int64)
        for p, (row, times) in enumerate(solve(np.array([r["size"] for r in own]), np.array([r["n"] for r in own]), int(own[0]["capacity"]))):
            for j, a in enumerate(row):
                if a:
                    begin = int(own[j]["first"] + used[j])
                    slots.append((limit, int(own[j]["grp"]), p, int(a), begin, begin + int(a) * times))
                    used[j] += int(a) * times
    plan = bounded_broadcast(spark.createDataFrame(slots, "limit_id int, grp int, config int, each int, begin bigint, stop bigint"))
    placed = ranked.join(plan, ["limit_id", "grp"]).where("rank >= begin and rank < stop")
    placed = cut(placed.select("limit_id", "capacity", "doc_id", "piece", "size", F.concat_ws("-", F.lit("c"), "config", F.expr("(rank - begin) div each")).alias("container")))
    open_ = placed.groupBy("limit_id", "capacity", "container").agg(F.sum("size").alias("used")).select("limit_id", "capacity", F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).alias("piece"), (F.col("capacity") - F.col("used")).alias("size"), "container")
    small = items.where(F.col("size") * SMALL_PART <= F.col("capacity")).select("limit_id", "capacity", "doc_id", "piece", "size", F.lit(None).cast("string").alias("container"))
    both = open_.where("size > 0").unionByName(small)
    rows = both.groupBy("limit_id").agg(F.count("*").alias("n")).select("limit_id", F.greatest(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)).cast("bigint").alias("buckets"))
    both = both.join(bounded_broadcast(rows, MAX_LIMITS), "limit_id").withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("container"))), F.col("buckets")))
    fitted = both.groupBy("limit_id", "bucket").applyInPandas(best_fit, "limit_id int, doc_id bigint, piece int, size bigint, container string")
    return whole.select("limit_id", "doc_id", "piece", "size", "container").unionByName(placed.select("limit_id", "doc_id", "piece", "size", "container")).unionByName(fitted)


def fills(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, container, items, used, capacity, fill)."""
    caps = bounded_broadcast(limits.select(F.col("limit_id").cast("int").alias("limit_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct(), MAX_LIMITS)
    out = packed.groupBy("limit_id", "container").agg(F.count("*").alias("items"), F.sum("size").alias("used"))
    return out.join(caps, "limit_id").withColumn("fill", F.col("used") / F.col("capacity"))


def invariants(packed: DataFrame, docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, documents, torn, overfull, close) of a packing: what must hold whatever the containers are.

    ``torn`` counts documents that aren't placed with all their tokens, or in more parts
    than their size needs; ``close`` tells whether there are at most a twentieth and two more
    containers than all tokens fill.
    """
    caps = bounded_broadcast(limits.select(F.col("limit_id").cast("int").alias("limit_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct(), MAX_LIMITS)
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    placed = packed.groupBy("limit_id", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("parts")).join(sizes, "doc_id").join(caps, "limit_id")
    whole = (F.col("size") == F.col("tokens")) & (F.col("parts") == F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)))
    a = placed.groupBy("limit_id").agg(F.count("*").alias("documents"), F.count_if(~whole).alias("torn"), F.sum("tokens").alias("tokens"))
    b = fills(packed, limits).groupBy("limit_id", "capacity").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), F.count("*").alias("containers"))
    return a.join(b, "limit_id").select("limit_id", "documents", "torn", "overfull", (F.col("containers") <= 1.05 * F.col("tokens") / F.col("capacity") + 2).alias("close"))
