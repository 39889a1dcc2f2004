"""Problem 4: conversations out of message rows.

Rows are sessionized by their channel, the conversation: put in order, split at silences
longer than a limit, and folded into what each session shows (roles, replies, defects).
Without a limit a conversation is one session, which is what ``defects`` and ``rebuild``
are told to look at; ``sessions`` calibrates the limit on the table, infers roles that
aren't stated and drops sessions without replies.

A conversation may be of any size: rows are range-sorted by conversation and time, each
batch of a range is folded alone, and what crosses its edges (the last speaker, the number
of rows before) is carried in one small row for each batch.

Order: created_at, then id. A message without created_at stands behind the message of
its conversation with the next smaller id. Of equal messages of a role within ``RESEND_S``
only the first counts. Messages without visible content are set aside.

Defined results: a null conversation_id belongs nowhere; null or unknown roles break a
conversation; null content counts as blank; messages at the same time go by id; exact
copies of a row count once; a conversation without messages is empty; empty tables give
empty results; only the named columns are read, so that extra ones can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.prefix import PID, prefix_sums, range_chunks, ranges_for
from textmill.session import cut

RESEND_S = 10
ID_CHUNK = 65_536
ROLES = ("user", "assistant", "system", "other")
USER, ASSISTANT, SYSTEM, OTHER = range(4)
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{3164}\x{FE00}-\x{FE0F}]"
ORDER = ["k_ts", "k_id", "k_late", "id"]
FIRST = -(2**62)


def role_code(column: Column) -> Column:
    """0 user, 1 assistant, 2 system, 3 any other, by the stated role."""
    r = F.lower(F.trim(column))
    code = F.when(r.isin("user", "human"), USER).when(r.isin("assistant", "bot", "ai"), ASSISTANT).when(r == "system", SYSTEM).otherwise(OTHER)
    return code.cast("tinyint")


def role_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ROLES)), code.cast("int") + 1)


def _stated(role: Column, text: Column) -> Column:
    """A fingerprint of the role as written and the content; equal ones are one message sent again."""
    return F.xxhash64(F.coalesce(F.lower(F.trim(role)), F.lit("")), text)


def _prepared(messages: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("content"), F.lit(""))
    return messages.where("conversation_id is not null and id is not null").select(
        F.col("conversation_id").alias("conv"),
        "id",
        role_code(F.col("role")).alias("role"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("ts"),
        _stated(F.col("role"), text).alias("h"),
        (F.length(F.regexp_replace(text, INVISIBLE, "")) > 0).alias("visible"),
        *more,
    )


def _anchored(rows: DataFrame) -> DataFrame:
    """Sort keys (k_ts, k_id, k_late); a row without a time takes those of the row it stands behind.

    Ids are cut into chunks. The last row with a time is looked up within the chunk, else it
    is the last one of an earlier chunk, carried over one row for each chunk.
    """
    rows = rows.withColumn("chunk", F.floor(F.col("id") / ID_CHUNK))
    ends = rows.groupBy("conv", "chunk").agg(F.max_by(F.struct("ts", "id"), F.when(F.col("ts").isNotNull(), F.col("id"))).alias("l"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("b", F.last("l", ignorenulls=True).over(before)).where("b is not null").select("conv", "chunk", "b")
    here = F.when(F.col("ts").isNotNull(), F.struct("ts", "id"))
    behind = Window.partitionBy("conv", "chunk").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("a", F.when(F.col("ts").isNull(), F.last(here, ignorenulls=True).over(behind)))
    rows = rows.join(carried, ["conv", "chunk"], "left").withColumn("a", F.coalesce("a", "b"))
    timed = F.col("ts").isNotNull()
    return rows.withColumns({
        "k_ts": F.coalesce(F.col("ts"), F.col("a.ts"), F.lit(FIRST)),
        "k_id": F.when(timed, F.col("id")).otherwise(F.coalesce(F.col("a.id"), F.lit(FIRST))),
        "k_late": (~timed).cast("tinyint"),
    }).drop("a", "b", "chunk")


def _once(rows: DataFrame) -> DataFrame:
    """Drop exact copies and messages sent again.

    Equal messages meet in slots of ``RESEND_S`` seconds, so that many copies make no group;
    the first of a slot is found by one number made of time and id, which is summed up
    without sorting.
    """
    width = RESEND_S * 1_000_000
    timed = F.col("k_late") == 0
    rows = rows.withColumn("slot", F.when(timed, F.floor(F.col("ts") / width)).otherwise(F.col("id")))
    scale, half = F.lit(str(2**64)).cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")
    first = F.col("ts").cast("decimal(18,0)") * scale + (F.col("id").cast("decimal(19,0)") + half)
    keys = ["conv", "role", "h", "k_late", "slot"]
    one = rows.groupBy(*keys).agg(F.min(first.cast("decimal(38,0)")).alias("first"), F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), F.min("k_ts").alias("k_ts"), F.min("k_id").alias("k_id"))
    own = (F.col("first") - F.col("ts").cast("decimal(18,0)") * scale - half).cast("bigint")
    one = one.withColumn("id", F.when(timed, own).otherwise(F.col("slot"))).drop("first")
    prior = one.where(timed).select("conv", "role", "h", "k_late", (F.col("slot") + 1).alias("slot"), F.col("last_ts").alias("p_ts"))
    out = one.join(prior, keys, "left").where(F.col("p_ts").isNull() | (F.col("ts") - F.col("p_ts") > width))
    return out.select("conv", "role", "h", "id", "ts", "k_ts", F.when(timed, F.col("id")).otherwise(F.col("k_id")).alias("k_id"), "k_late")


def counted(messages: DataFrame) -> DataFrame:
    """Messages that count, once and visible, with the keys of their order."""
    return _once(_anchored(_prepared(messages)).where("visible"))


def _sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of rows in order, each read once; bounds are drawn once for a run, so nothing is written."""
    cols = [*keys, *ORDER]
    return rows.repartitionByRange(ranges_for(rows.sparkSession), *cols).sortWithinPartitions(*cols)


FOLDED = "conv bigint, session_no bigint, chunk bigint, turns bigint, users bigint, assistants bigint, other boolean, late_system boolean, first_system boolean, twice boolean, unanswered boolean, answered boolean, head int, tail int, lo bigint, hi bigint"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each session shows within one batch of ordered rows."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    for no, b in enumerate(batches):
        if not b.num_rows:
            continue
        conv, session, role = (b.column(c).to_numpy(zero_copy_only=False) for c in ("conv", "session_no", "role"))
        ts = b.column("ts").to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        n = len(conv)
        edge = np.concatenate(([True], (conv[1:] != conv[:-1]) | (session[1:] != session[:-1])))
        at = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        talk = role <= ASSISTANT
        # the talk before each talk, within its run
        t = np.flatnonzero(talk)
        same = run[t[1:]] == run[t[:-1]]
        again = np.zeros(n, dtype=bool)
        again[t[1:]] = same & (role[t[1:]] == role[t[:-1]])
        answer = np.zeros(n, dtype=bool)
        answer[t[1:]] = same & (role[t[1:]] == ASSISTANT) & (role[t[:-1]] == USER)
        head, tail = np.full(len(at), -1), np.full(len(at), -1)
        head[run[t][::-1]] = role[t][::-1]
        tail[run[t]] = role[t]
        any_ = lambda x: np.add.reduceat(x.astype(np.int64), at) > 0
        none = np.isnan(ts)
        lo, hi = np.minimum.reduceat(np.where(none, np.inf, ts), at), np.maximum.reduceat(np.where(none, -np.inf, ts), at)
        time = lambda x: pa.array([None if np.isinf(v) else int(v) for v in x], pa.int64())
        size = np.diff(np.append(at, n))
        cols = [
            pa.array(conv[at], pa.int64()), pa.array(session[at], pa.int64()), pa.array(np.full(len(at), (pid << 32) + no), pa.int64()), pa.array(size, pa.int64()),
            pa.array(np.add.reduceat((role == USER).astype(np.int64), at)), pa.array(np.add.reduceat((role == ASSISTANT).astype(np.int64), at)),
            pa.array(any_(role == OTHER)), pa.array(any_((role == SYSTEM) & ~edge)), pa.array(role[at] == SYSTEM),
            pa.array(any_(again & (role == ASSISTANT))), pa.array(any_(again & (role == USER))), pa.array(any_(answer)),
            pa.array(head.tolist(), pa.int32()), pa.array(tail.tolist(), pa.int32()), time(lo), time(hi),
        ]
        yield pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in FOLDED.split(", ")])


def sessionize(rows: DataFrame) -> DataFrame:
    """One row for each session of ``rows`` (conv, session_no, role, ts and the keys of the order).

    Columns: conv, session_no, turns, users, assistants, started, ended (microseconds),
    broken, no_reply and replied (a user's message is followed by an assistant's).
    """
    parts = _sorted(rows.select("conv", "session_no", "role", "ts", *[c for c in ORDER]), ["conv", "session_no"]).mapInArrow(_fold, FOLDED)
    # at most one row for each batch of a session
    v = Window.partitionBy("conv", "session_no").orderBy("chunk")
    known = lambda c: F.when(F.col(c) >= 0, F.col(c))
    parts = parts.withColumns({"head": known("head"), "tail": known("tail")})
    parts = parts.withColumns({"came": F.last("tail", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1)), "nth": F.row_number().over(v)})
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")) == 1
    col = F.col
    out = parts.groupBy("conv", "session_no").agg(
        F.sum("turns").alias("turns"), F.sum("users").alias("users"), F.sum("assistants").alias("assistants"), F.min("lo").alias("started"), F.max("hi").alias("ended"),
        any_(col("other") | col("late_system") | (col("first_system") & (col("nth") > 1)) | col("twice") | ((col("head") == ASSISTANT) & (col("came").isNull() | (col("came") == ASSISTANT)))).alias("broken"),
        any_(col("unanswered") | ((col("head") == USER) & (col("came") == USER))).alias("unanswered"),
        F.max_by("tail", F.when(col("tail").isNotNull(), col("chunk"))).alias("last"),
        any_(col("answered") | ((col("head") == ASSISTANT) & (col("came") == USER))).alias("replied"),
    )
    no_reply = F.coalesce(col("unanswered") | (col("last") == USER), F.lit(False))
    return out.select("conv", "session_no", "turns", "users", "assistants", "started", "ended", "broken", no_reply.alias("no_reply"), "replied")


def defects(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, defect) with orphan, empty, broken and no_reply; a conversation is one session."""
    known = conversations.where("id is not null").select(F.col("id").alias("conv")).distinct().withColumn("known", F.lit(True))
    seen = messages.where("conversation_id is not null").select(F.col("conversation_id").alias("conv")).distinct()
    return _defects(seen, known, counted(messages))


def _defects(seen: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    state = sessionize(rows.withColumn("session_no", F.lit(0).cast("bigint")))
    all_ = known.join(seen.withColumn("seen", F.lit(True)), "conv", "full").join(state, "conv", "left")
    talk = F.coalesce(F.col("users") + F.col("assistants"), F.lit(0))
    found = F.when(F.col("known").isNull(), F.array(F.lit("orphan"))).otherwise(
        F.filter(
            F.array(
                F.when(talk == 0, F.lit("empty")),
                F.when(F.col("broken"), F.lit("broken")),
                F.when(F.col("no_reply"), F.lit("no_reply")),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return all_.select(F.col("conv").alias("conversation_id"), F.explode(found).alias("defect"))


def with_content(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """Add ``content`` to turns (id, h); it is joined last, so that texts are moved once."""
    text = F.coalesce(F.col("content"), F.lit(""))
    texts = messages.where("conversation_id is not null and id is not null").select(F.col("id"), _stated(F.col("role"), text).alias("h"), F.col("conversation_id").alias("conv"), "content").dropDuplicates(["id", "h", "conv"])
    return turns.join(texts, ["id", "h", "conv"])


def rebuild(messages: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each counted message: conversation_id, turn_no, id, role (user, assistant, system or other), created_at and content.

    With ``conversations`` only those without a defect are left.
    """
    rows = cut(counted(messages)) if conversations is not None else counted(messages)  # read by the fold and the turns
    if conversations is not None:
        known = conversations.where("id is not null").select(F.col("id").alias("conv")).distinct().withColumn("known", F.lit(True))
        bad = _defects(rows.select("conv").distinct(), known, rows).select(F.col("conversation_id").alias("conv")).distinct()
        rows = rows.join(bad, "conv", "left_anti")
    out = prefix_sums(rows, ["conv"], ORDER, {"turn_no": F.lit(1)})
    out = with_content(out, messages)
    return out.select(F.col("conv").alias("conversation_id"), "turn_no", "id", role_name(F.col("role")).alias("role"), F.timestamp_micros("ts").cast("timestamp_ntz").alias("created_at"), "content")


def _width(minutes: Column) -> Column:
    """Widths of the histogram's bins: whole minutes up to 31, then 16 bins for each power of two."""
    return F.expr(f"shiftleft(bigint(1), greatest(0, length(bin({minutes})) - 5))")


def gap_limit(gaps: DataFrame, share: float, least_s: int) -> DataFrame:
    """One row: the silence (microseconds) that ``share`` of all silences don't exceed, by a histogram of fixed size."""
    m = gaps.where("gap is not null").withColumn("m", F.floor(F.col("gap") / 60_000_000)).withColumn("w", _width("m"))
    bins = m.groupBy((F.floor(F.col("m") / F.col("w")) * F.col("w") + F.col("w")).alias("top")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("top")  # a few hundred rows
    bins = bins.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    return bins.where(F.col("upto") >= share * F.col("all")).agg(F.greatest(F.coalesce(F.min("top") * 60_000_000, F.lit(0)), F.lit(least_s * 1_000_000)).alias("limit"))


# How far a role may be misspelt, in letters.
NEAR = ((USER, "user", 1), (ASSISTANT, "assistant", 3), (SYSTEM, "system", 2))


def infer_roles(rows: DataFrame) -> DataFrame:
    """Give rows without a known role (``code`` other) the one that the evidence is for.

    In this order: a role misspelt in a few letters; remembered facts used, which only an
    assistant has; the speakers before and behind it, which it stands between; a question
    mark at its end. What nothing tells stays other. ``rows`` are ranges with ``_pid``; what
    crosses their edges is carried in one row for each range.
    """
    own, back = Window.partitionBy("conv", PID), Window.unboundedPreceding
    known = F.when(F.col("role") <= ASSISTANT, F.col("role"))
    # what follows is what comes before in the opposite order, which takes one pass
    rows = rows.withColumn("prev", F.last(known, ignorenulls=True).over(own.orderBy(*ORDER).rowsBetween(back, -1)))
    rows = rows.withColumn("next", F.last(known, ignorenulls=True).over(own.orderBy(*[F.col(c).desc() for c in ORDER]).rowsBetween(back, -1)))
    key = F.struct(*ORDER)
    ends = rows.groupBy("conv", PID).agg(F.min_by(known, F.when(known.isNotNull(), key)).alias("head"), F.max_by(known, F.when(known.isNotNull(), key)).alias("tail"))
    v = Window.partitionBy("conv").orderBy(PID)
    ends = ends.select("conv", PID, F.last("tail", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("p0"), F.last("head", ignorenulls=True).over(Window.partitionBy("conv").orderBy(F.col(PID).desc()).rowsBetween(back, -1)).alias("n0"))
    rows = rows.join(ends, ["conv", PID]).withColumns({"prev": F.coalesce("prev", "p0"), "next": F.coalesce("next", "n0")})
    between = F.coalesce(F.when(F.col("prev") == F.col("next"), 1 - F.col("prev")), F.when(F.col("next").isNull(), 1 - F.col("prev")), F.when(F.col("prev").isNull(), 1 - F.col("next")))
    told = F.coalesce(F.col("near"), F.when(F.col("uses"), F.lit(ASSISTANT)), between, F.when(F.col("asks"), F.lit(USER)), F.lit(OTHER))
    return rows.withColumn("role", F.when(F.col("role") == OTHER, told).otherwise(F.col("role")).cast("tinyint")).drop("prev", "next", "p0", "n0")


def _evidence(messages: DataFrame) -> DataFrame:
    """(conv, id, h, near, uses, asks) of messages without a known role."""
    text = F.coalesce(F.col("content"), F.lit(""))
    r = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    near = F.coalesce(*[F.when(F.levenshtein(r, F.lit(name)) <= far, F.lit(code)) for code, name, far in NEAR])
    uses = F.length(F.trim("used_memory_ids")) > 0 if "used_memory_ids" in messages.columns else F.lit(False)
    rows = messages.where("conversation_id is not null and id is not null").where(role_code(F.col("role")) == OTHER)
    return rows.select(F.col("conversation_id").alias("conv"), "id", _stated(F.col("role"), text).alias("h"), near.alias("near"), F.coalesce(uses, F.lit(False)).alias("uses"), text.rlike(r"[?؟]\s*$").alias("asks")).groupBy("conv", "id", "h").agg(F.min("near").alias("near"), F.max("uses").alias("uses"), F.max("asks").alias("asks"))


def sessions(messages: DataFrame, share: float = 0.95, least_s: int = 60, replied_only: bool = True) -> DataFrame:
    """Split conversations at long silences: (conversation_id, session_no, turns, users, assistants, started, ended, replied).

    The gap is calibrated on the table: the ``share`` quantile of all silences between
    neighbouring messages of a conversation, ``least_s`` at least. A message without a
    time belongs to the session of the one it stands behind and has no gap of its own;
    gaps are measured between its neighbours that have one. Roles that aren't stated are
    inferred. Sessions without a user's message that an assistant replies to are dropped
    unless ``replied_only`` is false.
    """
    rows = counted(messages).join(_evidence(messages), ["conv", "id", "h"], "left").drop("h")
    rows = infer_roles(range_chunks(rows, ["conv"], ORDER)).drop("near", "uses", "asks")
    w = Window.partitionBy("conv", PID).orderBy(*ORDER)
    rows = rows.withColumn("gap", F.col("ts") - F.last("ts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy("conv", PID).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    earlier = Window.partitionBy("conv").orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("gap0", F.col("lo") - F.last("hi", ignorenulls=True).over(earlier)).select("conv", PID, "gap0")
    rows = cut(rows.join(ends, ["conv", PID]).withColumn("gap", F.when(F.col("ts").isNotNull(), F.coalesce("gap", "gap0"))).drop("gap0"))
    rows = rows.crossJoin(F.broadcast(gap_limit(rows, share, least_s))).withColumn("cut", F.coalesce((F.col("gap") > F.col("limit")).cast("int"), F.lit(0)))  # one row
    rows = prefix_sums(rows.drop("gap", "limit"), ["conv"], ORDER, {"cuts": F.col("cut")}, chunked=True)
    rows = rows.withColumn("session_no", (F.col("cuts") + F.col("cut")).cast("bigint"))
    out = sessionize(rows).select(F.col("conv").alias("conversation_id"), "session_no", "turns", "users", "assistants", F.timestamp_micros("started").cast("timestamp_ntz").alias("started"), F.timestamp_micros("ended").cast("timestamp_ntz").alias("ended"), "replied")
    return out.where("replied") if replied_only else out
