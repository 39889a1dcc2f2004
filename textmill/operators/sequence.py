"""Operators over a global order: interleaving, shards, packing, batches and running statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.prefix import prefix_sums
from textmill.session import cut

# Defaults of the shards of tokenizer training.
SHARD_BYTES = 256 * 1024**2
MAX_CORPUS_BYTES = 10 * 1024**3
# At most so many blocks' states are broadcast.
MOST_STARTS = 10_000


def deficit_cycle(ratios: dict[str, float], steps: int) -> list[str]:
    """The bucket of each step of a cycle: always the one whose share lags most behind its ratio, the first of equals."""
    if not any(r > 0 for r in ratios.values()) or any(r < 0 for r in ratios.values()):
        raise ValueError("ratios must not be negative, and one must be positive")
    total = sum(ratios.values())
    want = {b: r / total for b, r in ratios.items() if r > 0}
    seen = dict.fromkeys(want, 0)
    out: list[str] = []
    for step in range(steps):
        lag = {b: w - seen[b] / max(step, 1) for b, w in want.items()}
        best = max(lag, key=lag.__getitem__)
        seen[best] += 1
        out.append(best)
    return out


def interleave(df: DataFrame, bucket: str, order: list[str], ratios: dict[str, float], steps: int = 10_000) -> DataFrame:
    """Add ``slot``, the place of each row when weighted buckets take turns by largest deficit.

    The k-th row of a bucket belongs to the k-th step of the bucket in the repeated cycle.
    A bucket that runs out is skipped, which doesn't change the order of the others, so
    sorting by the step is enough. The cycle has a fixed length and is broadcast.
    """
    cycle = deficit_cycle(ratios, steps)
    count = {b: cycle.count(b) for b in set(cycle)}
    seen = dict.fromkeys(count, 0)
    table = []
    for step, b in enumerate(cycle):
        table.append((b, seen[b], count[b], step))
        seen[b] += 1
    plan = F.broadcast(df.sparkSession.createDataFrame(table, "_bucket string, _nth bigint, _each bigint, _step bigint"))
    rows = prefix_sums(df.where(F.col(bucket).isin(*count)), [bucket], order, {"_k": F.lit(1)}).drop("_k_total")
    each = F.create_map(*[x for b, n in count.items() for x in (F.lit(b), F.lit(n))])
    rows = rows.withColumn("_each_own", F.element_at(each, F.col(bucket)))
    rows = rows.join(plan, (F.col(bucket) == F.col("_bucket")) & (F.col("_k") % F.col("_each_own") == F.col("_nth")))
    rows = rows.withColumn("_due", F.floor(F.col("_k") / F.col("_each")) * steps + F.col("_step"))
    return prefix_sums(rows, [], ["_due", *order], {"slot": F.lit(1)}).drop("_k", "_due", "_bucket", "_nth", "_each", "_each_own", "_step", "slot_total")


def shards(df: DataFrame, order: list[str], size: Column, shard_bytes: int = SHARD_BYTES, cap: int = MAX_CORPUS_BYTES) -> DataFrame:
    """Add ``shard``: running bytes cut at ``shard_bytes``; rows stop where ``cap`` would be passed."""
    out = prefix_sums(df.withColumn("_b", size), [], order, {"before": F.col("_b")})
    return out.where(F.col("before") + F.col("_b") <= cap).withColumn("shard", F.floor(F.col("before") / shard_bytes).cast("int")).drop("_b", "before_total")


def pack(df: DataFrame, order: list[str], length: str, width: int) -> DataFrame:
    """Concatenate documents and cut every ``width`` tokens: (sample, keys, from, to) segments of documents."""
    out = prefix_sums(df, [], order, {"begin": F.col(length)}).drop("begin_total").where(F.col(length) > 0)
    first, last = F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.col(length) - 1) / width)
    out = out.withColumn("sample", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("sample") * width - F.col("begin"), F.lit(0))
    hi = F.least((F.col("sample") + 1) * width - F.col("begin"), F.col(length))
    return out.withColumns({"from": lo, "to": hi}).drop("begin")


def batches(df: DataFrame, order: list[str], size: int, drop_last: bool = False) -> DataFrame:
    out = prefix_sums(df, [], order, {"row": F.lit(1)})
    out = out.withColumn("batch", F.floor(F.col("row") / size))
    if drop_last:
        out = out.where((F.col("batch") + 1) * size <= F.col("row_total"))
    return out.drop("row", "row_total")


def with_history(df: DataFrame, key: str, order: list[str], n: int, block: int = 4_096) -> DataFrame:
    """Cut each key into blocks (``_block``) of rows in ``order``; each also gets the ``n`` rows before it, marked ``_old``."""
    if n > block:
        raise ValueError("a block must hold the history")
    rows = prefix_sums(df, [key], order, {"_at": F.lit(1)}).drop("_at_total")
    rows = rows.withColumns({"_block": F.floor(F.col("_at") / block), "_old": F.lit(False)})
    tail = rows.where(F.col("_at") % block >= block - n).withColumns({"_block": F.col("_block") + 1, "_old": F.lit(True)})
    return rows.unionByName(tail).drop("_at")


Step = Callable[[list[float], float], tuple[list[float], bool]]


def sequential(df: DataFrame, key: str, order: list[str], value: str, step: Step, result: str, warm: int = 256, block: int = 4_096) -> DataFrame:
    """Fold each key in ``order`` with a small state: add ``result`` BOOLEAN, what ``step(state, value)`` says of each row.

    A key of any size is spread over blocks. Each block starts from the state that the
    ``warm`` rows before it lead to; where the block before ends in another state, the block
    is done again from that one, until all states join. These rounds keep the states at the
    blocks' ends only; the rows are written once, when all starts are known. The result is that of one pass over
    the whole key, and rows of a key that never pauses are still done by many tasks.
    ``order`` must end in a unique column.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + f", `{result}` boolean"
    closed = f"`{key}` {kinds[key]}, _block bigint, _start array<double>, _end array<double>"

    def runner(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Blocks one behind the other: the rows with what is said of each if ``whole``, else the states at either end of each block."""

        def closing(kind: pa.DataType, ends: list[tuple]) -> pa.RecordBatch:
            numbers = pa.list_(pa.float64())
            k, block, start, end = zip(*ends)
            return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(block, pa.int64()), pa.array(start, numbers), pa.array(end, numbers)], [key, "_block", "_start", "_end"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, state, begin, kind = None, [], None, None
            for part in batches:
                hits, ends = [], []
                kind = part.schema.field(key).type
                first, old = part.column("_from"), part.column("_old")
                for i, (k, block, past, v) in enumerate(zip(*(part.column(c).to_pylist() for c in (key, "_block", "_old", value)))):
                    if at is None or block != at[1] or k != at[0]:
                        if begin is not None:
                            ends.append((*at, begin, list(state)))
                        at, begin = (k, block), None
                        state = [float(x) for x in first[i].as_py() or ()]
                    if not past and begin is None:
                        begin = list(state)
                    state, hit = step(state, v)
                    if not past:
                        hits.append(hit)
                if whole and hits:
                    rows = part.filter(pc.invert(old))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kinds), pa.array(hits, pa.bool_())], [*kinds, result])
                elif ends and not whole:
                    yield closing(kind, ends)
            if begin is not None and not whole:
                yield closing(kind, [(*at, begin, list(state))])

        return run

    def placed(rows: DataFrame) -> DataFrame:
        return rows.repartition(key, "_block").sortWithinPartitions(key, "_block", *order)

    def started(rows: DataFrame, starts: DataFrame) -> DataFrame:
        """Rows of the blocks in ``starts``, each block's from its own state; a broadcast leaves them in their places."""
        few = starts.limit(MOST_STARTS + 1).count() <= MOST_STARTS
        other = starts.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), "_from")
        own = rows.where("not _old").join(F.broadcast(other) if few else other, same).drop("_k", "_b")
        return own if few else placed(own)

    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b"))
    rows = cut(placed(with_history(df, key, order, warm, block)))
    ends = cut(rows.withColumn("_from", F.lit(None).cast("array<double>")).mapInArrow(runner(False), closed))
    while True:
        w = Window.partitionBy(key).orderBy("_block")  # one row for each block
        wrong = cut(ends.withColumn("_from", F.lag("_end").over(w)).where("_from is not null and _from <> _start").select(key, "_block", "_from"))
        if wrong.isEmpty():
            return started(rows, ends.select(key, "_block", F.col("_start").alias("_from"))).mapInArrow(runner(True), found)
        again = started(rows, wrong).mapInArrow(runner(False), closed)
        ends = cut(ends.join(wrong.select(F.col(key).alias("_k"), F.col("_block").alias("_b")), same, "left_anti").unionByName(again))


def accept_step(limit: int, seconds: int) -> Step:
    """A sliding window in which only accepted requests count; the state is their times in microseconds."""

    def step(held: list[float], t: float) -> tuple[list[float], bool]:
        held = [h for h in held if h >= t - seconds * 1_000_000]
        if len(held) < limit:
            return [*held, float(t)], True
        return held, False

    return step


def spike_step(times: float = 3.0, window: int = 50, least: int = 3) -> Step:
    """A loss above ``times`` the median of the last ``window`` losses that were no spikes; the state is these losses."""

    def step(seen: list[float], loss: float) -> tuple[list[float], bool]:
        if loss is None or loss != loss:
            return seen, False
        if len(seen) >= least:
            s, half = sorted(seen), len(seen) // 2
            middle = s[half] if len(s) % 2 else (s[half - 1] + s[half]) / 2
            if middle > 0 and loss > times * middle:
                return seen, True
        return [*seen, float(loss)][-window:], False

    return step


def accepted_requests(df: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """Add ``accepted`` by a sliding window in which only accepted requests count; null keys and times take no part."""
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return sequential(rows, key, ["_us", order], "_us", accept_step(limit, seconds), "accepted", warm=max(64, 4 * limit)).drop("_us")


def loss_spikes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Add ``spike``: losses far above the median of those before them, spikes left out of the history. Null losses are none and change nothing."""
    return sequential(df, key, [order], value, spike_step(), "spike", warm=200)


def in_window(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Add ``in_window``: the rows of the key within ``seconds`` before each row, it and those of its time included.

    Keys are cut into buckets of the window's width; a row also stands in the next bucket,
    where it is counted and not returned.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_us", us).withColumn("_bucket", F.floor(F.col("_us") / (seconds * 1_000_000))).withColumn("_old", F.lit(False))
    both = rows.unionByName(rows.withColumns({"_bucket": F.col("_bucket") + 1, "_old": F.lit(True)}))
    w = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return both.withColumn("in_window", F.count("*").over(w)).where("not _old").drop("_us", "_bucket", "_old")
