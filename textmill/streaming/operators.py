"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit(stream: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Requests with ``accepted``, by a sliding window of accepted requests of each key.

    State is one list of at most ``limit`` times for each key; it is dropped when no request
    came for ``seconds``. Rows of a micro-batch are taken in order of time.
    """
    rows = stream.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withWatermark(ts, f"{seconds} seconds")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", accepted boolean"

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        part = pd.concat(list(parts)).sort_values("_us", kind="stable")
        out = []
        for t in part["_us"]:
            held = [h for h in held if h >= t - seconds * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(int(t))
            out.append(ok)
        state.update((held,))
        if len(part):
            due = int(part["_us"].max() // 1000) + seconds * 1000
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        yield part.assign(accepted=out)

    return rows.groupBy(key).applyInPandasWithState(step, schema, "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout).drop("_us")


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in event-time windows; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def join_chunks(events: DataFrame) -> DataFrame:
    """Texts of messages from their chunk events (message_id, seq, type, text); a group is one message."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return events.where("type = 'chunk'").groupBy("message_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def micro_batches(stream: DataFrame, handle, path: str, files: int = 8, interval: str = "10 seconds"):
    """Hand each micro-batch to ``handle(batch, id)``; the number of files for each is set where the stream is read."""
    return stream.writeStream.trigger(processingTime=interval).option("checkpointLocation", path).foreachBatch(handle).start()


def loss_spikes(stream: DataFrame, key: str, order: str, value: str, step=None) -> DataFrame:
    """Rows with ``spike``, by the history of each key's losses that were no spikes.

    State is that of ``sequence.spike_step``: at most fifty losses for each key. Rows of a
    micro-batch are taken in order.
    """
    from textmill.operators.sequence import spike_step

    step = step or spike_step()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", spike boolean"

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = [float(x) for x in state.get[0]] if state.exists else []
        part, out = pd.concat(list(parts)).sort_values(order, kind="stable"), []
        for v in part[value]:
            seen, hit = step(seen, v)
            out.append(hit)
        state.update((seen,))
        yield part.assign(spike=out)

    return stream.groupBy(key).applyInPandasWithState(run, schema, "seen array<double>", "append", GroupStateTimeout.NoTimeout)


def iterate(df: DataFrame, prefetch: bool = True) -> Iterator:
    """Rows one by one, partition by partition; only one partition (two with ``prefetch``) is held at a time."""
    return df.toLocalIterator(prefetchPartitions=prefetch)
