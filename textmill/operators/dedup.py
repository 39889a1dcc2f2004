"""Near-duplicates by Jaccard similarity of word sets, with keep-first semantics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.session import bounded_broadcast, cut

# Rows that meet are compared in pieces of about so many.
PIECE = 200_000
# At most so many pairs are decided in one task; more are decided in rounds.
TOGETHER = 1_000_000
# Sets of so many words carry a longer sketch too where they meet in bands.
LONG = 200
# What is often equal or zero stands side by side, so that it is compressed: the first two columns and 24 bits of the key.
MEETING = "more binary, at bigint, key bigint, k bigint, s0 bigint, s1 bigint"
KEY = np.uint64(2**64 - 2**24)


def _key(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, "\x1f")))


def word_sets(df: DataFrame, id_col: str, text_col: str, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of rows with one set of lower-cased words, and the set of each class.

    Returns (id, class_id) and (class_id, words); ``class_id`` is the smallest id of the
    class. Rows without words take no part. With ``once`` an id that is repeated counts
    once. Words are made again from the text where they are needed and not kept on disk:
    the rows that stand for no class are left out by their ids and keys.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.where(F.col(id_col).isNotNull() & text.rlike(X.WORD)).select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(X.words(text))).alias("words"))
    rows = rows.withColumn("h", _key(F.col("words")))
    every = cut(rows.select("id", "h"))
    own = every.groupBy("id").agg(F.min("h").alias("h")) if once else every
    classes = own.groupBy("h").agg(F.min("id").alias("class_id"))
    others = cut(every.join(classes.select("h", F.col("class_id").alias("id")), ["id", "h"], "left_anti").distinct())
    sets = rows.join(bounded_broadcast(others, 500_000), ["id", "h"], "left_anti")
    return own.join(classes, "h").select("id", "class_id"), sets.select(F.col("id").alias("class_id"), "words")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _classes(n: np.ndarray, threshold: float) -> np.ndarray:
    """Size classes such that similar sets are of the same class or of neighbouring ones."""
    return np.floor(np.log(n) / math.log(1 / threshold) + 1e-9).astype(np.int64)


def _sketch(x: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set, one of them flipped for each word: sets differ in as many words at least as in bits."""
    bit, one = _mixed(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(57), np.uint64(1)
    mark = one << (bit & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where((bit < 64) == low, mark, np.uint64(0)), start) for low in (True, False)]


def _more(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Another sketch of each long set, of more than half as many bits as it has words; None for others.

    Long sets may differ in so many words that 128 bits drop hardly any pair of them. The
    number of bits is a power of two, 512 at least.
    """
    out, end = np.full(len(start), None, dtype=object), np.append(start[1:], len(x))
    for i in np.flatnonzero(end - start >= LONG):
        bits = max(512, 1 << (int(end[i] - start[i]).bit_length() - 1))
        bit = _mixed(x[start[i] : end[i]] ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(bits - 1)
        own = np.zeros(bits // 64, np.uint64)
        np.bitwise_xor.at(own, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        out[i] = own.tobytes()
    return out


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits two columns of longer sketches differ; the larger is folded to the bits of the smaller."""
    out, la, lb = np.zeros(len(a), np.int64), np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    for m, n in np.unique(np.stack([la, lb], 1), axis=0):
        rows = np.flatnonzero((la == m) & (lb == n))
        for some in np.array_split(rows, len(rows) // 50_000 + 1):
            u, v = (np.frombuffer(b"".join(x[some]), np.uint64).reshape(len(some), -1) for x in (a, b))
            while u.shape[1] != v.shape[1]:
                u, v = sorted((u, v), key=lambda x: x.shape[1])
                v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
            out[some] = np.bitwise_count(u ^ v).sum(1)
    return out


def _rows(key: np.ndarray, k: np.ndarray, at: np.ndarray, sketch: list[np.ndarray], more: pa.Array | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.binary()) if more is None else more, *(pa.array(c.view(np.int64)) for c in (at, key & KEY, k, *sketch))], ["more", "at", "key", "k", "s0", "s1"])


Meeting = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]]


def _meet(sets: DataFrame, threshold: float, places: Meeting) -> DataFrame:
    """Pairs (a, b, similarity) of classes that meet in one of their ``places``, a < b.

    ``places(k, n, x, start, sketch)`` gets the sets of a batch: numbers, sizes, hashed words
    with the start of each set's, and sketches. It gives rows of ``MEETING``; ``at`` holds the
    size, the place and a mark for sets that only look for larger ones here. A pair meets in
    the first places only, as many as the words in which it may differ and one. What differs
    in too many bits of a sketch isn't a pair; only the others are checked word by word.
    """
    least = math.ceil(threshold / (1 - threshold) - 1e-9)  # n / (n + 1) >= t
    differ = (1 - threshold) / (1 + threshold)
    numbered = sets.withColumn("k", F.xxhash64(_key(F.col("words"))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            part = part.filter(pc.greater_equal(pc.list_value_length(part.column("x")), least))
            if part.num_rows:
                lists = part.column("x")
                n = np.asarray(lists.value_lengths()).astype(np.int64)
                x, start = np.asarray(lists.flatten()).view(np.uint64), np.cumsum(n) - n
                yield from places(np.asarray(part.column("k")), n, x, start, _sketch(x, start))

    def alike(more: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the longer sketches leave it open that a pair is similar."""
        out = np.ones(len(i), bool)
        long = np.flatnonzero([a is not None and b is not None for a, b in zip(more[i], more[j])])
        if len(long):
            out[long] = _differing(more[i[long]], more[j[long]]) <= most[long]
        return out

    def compared(c: list[np.ndarray]) -> pa.RecordBatch:
        """Pairs of whole groups of rows, sorted by key and size."""
        more, at, key, k, sketch = *c[:4], [x.view(np.uint64) for x in c[4:]]
        n, place, small = at >> 32, (at >> 1) & 0x7FFFFFFF, (at & 1) == 1
        i, shift, found = np.arange(len(key)), 0, []
        while True:
            shift += 1
            i = i[: np.searchsorted(i, len(key) - shift)]
            j = i + shift
            i = i[(key[i] == key[j]) & (n[i] >= threshold * n[j] - 1e-9)]  # larger ones come later
            if not len(i):
                break
            j = i + shift
            most = np.floor(differ * (n[i] + n[j]) + 1e-6)
            near = ~small[j] & (k[i] != k[j]) & (place[i] <= most)
            near &= sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int64) for s in sketch) <= most
            near[near] = alike(more, i[near], j[near], most[near])
            if near.any():
                a, b = k[i[near]], k[j[near]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["ka", "kb"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, enough = 0, PIECE
        for part in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in part.columns])
            count += part.num_rows
            if count >= enough:
                c = [np.concatenate(x) for x in zip(*held)]
                whole = int(np.searchsorted(c[2], c[2][-1]))  # the last group may go on
                if whole:
                    yield compared([x[:whole] for x in c])
                held, count = [[x[whole:] for x in c]], count - whole
                enough = max(PIECE, 2 * count)
        if count:
            yield compared([np.concatenate(x) for x in zip(*held)])

    hashed = numbered.select("k", F.transform("words", lambda w: F.xxhash64(w)).alias("x"))
    places_of = hashed.mapInArrow(spread, MEETING).repartition("key").sortWithinPartitions("key", "at")
    pairs = cut(places_of.mapInArrow(meeting, "ka bigint, kb bigint").distinct())
    return verified(pairs, numbered, threshold)


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, similarity) of classes, a < b, by an exact join on parts of the sets.

    Two similar sets of n and m words differ in (1 - t) / (1 + t) * (n + m) words at most. Words
    are dealt by hash to one part more than that, so that the sets are equal in one part at
    least, and meet there. The number of parts follows from the size class of the larger set;
    a set deals its words for its own class and for the next. A part holds several
    words, so that few sets meet by chance, also where no word is rare. Sets that are too short
    to differ in a word and be similar all the same don't take part.
    """
    differ = (1 - threshold) / (1 + threshold)

    def places(k: np.ndarray, n: np.ndarray, x: np.ndarray, start: np.ndarray, sketch: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kinds = _classes(np.arange(1, int(n.max() / threshold**2) + 3), threshold)
        top = np.searchsorted(kinds, np.arange(kinds[-1] + 1), "right")  # the largest size of each class
        word, deal = _mixed(x), _mixed(x ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(1)
        for up in (0, 1):
            kind = _classes(n, threshold) + up
            partner = np.minimum(top[kind], np.floor(n / threshold + 1e-9).astype(np.int64))
            parts = np.floor(differ * 2 * top[kind] + 1e-6).astype(np.int64) + 1
            used = np.floor(differ * (n + partner) + 1e-6).astype(np.int64) + 1
            if up:
                used[partner <= top[kind - 1]] = 0  # no set of the next class is similar
            first = np.cumsum(used) - used
            place = (deal % np.repeat(parts, n).astype(np.uint64)).astype(np.int64)
            here = place < np.repeat(used, n)
            total = np.zeros(int(used.sum()), np.uint64)
            np.add.at(total, (np.repeat(first, n) + place)[here], word[here])
            own = np.repeat(np.arange(len(n)), used)
            p = np.arange(len(total)) - first[own]
            key = _mixed(total + _mixed((kind[own].astype(np.uint64) << np.uint64(32)) + p.astype(np.uint64)))
            yield _rows(key, k[own], (n[own] << 32) | (p << 1) | up, [s[own] for s in sketch])

    return _meet(sets, threshold, places)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (ka, kb) of numbered sets with their similarity, those of at least ``threshold``."""
    wanted = pairs.select(F.explode(F.array("ka", "kb")).alias("k")).distinct()
    own = sets.join(bounded_broadcast(wanted, 1_000_000), "k", "left_semi").dropDuplicates(["k", "class_id"])
    left, right = (own.select(F.col("k").alias(f"k{x}"), F.col("class_id").alias(f"c{x}"), F.size("words").alias(f"n{x}"), F.array_join("words", "\x1f").alias(f"w{x}")) for x in "ab")  # as one string each takes a fraction of the room
    both = F.size(F.array_intersect(F.split("wa", "\x1f"), F.split("wb", "\x1f")))
    checked = pairs.join(left, "ka").join(right, "kb").select("ca", "cb", "na", "nb", F.explode(F.array(both)).alias("both"))  # counted once, before the filter
    checked = checked.withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("similarity") >= threshold)
    return checked.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "similarity")


def minhash_classes(sets: DataFrame, threshold: float, bands: int = 24, rows: int = 6) -> DataFrame:
    """Pairs (a, b, similarity) of classes by MinHash signatures in bands, each candidate checked.

    ``bands * rows`` permutations; at the defaults a pair of similarity .85 meets in some band
    with probability .9999, one of .5 with .31. Signatures are made in Arrow batches.
    """
    rng = np.random.default_rng(13)
    k = bands * rows
    mul, add = rng.integers(1, 2**61, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**62, k, dtype=np.uint64)

    def places(numbers: np.ndarray, n: np.ndarray, x: np.ndarray, start: np.ndarray, sketch: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        low = np.empty((k, len(n)), dtype=np.uint64)
        for i in range(k):
            y = x * mul[i] + add[i]
            low[i] = np.minimum.reduceat(y ^ (y >> np.uint64(29)), start)
        more = pa.array(_more(x, start), pa.binary())
        for band in range(bands):
            key = np.full(len(n), band, dtype=np.uint64)
            for i in range(band * rows, (band + 1) * rows):
                key = _mixed(key + low[i])
            yield _rows(key, numbers, n << 32, sketch, more)

    return _meet(sets, threshold, places)


def keep_first(nodes: DataFrame, pairs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(id, kept): a node is dropped if a kept node before it is similar.

    Up to ``together`` pairs, counted, are decided in one task, in order. Beyond that, in each
    round the nodes that no undecided one stands before are kept and what is similar
    to them is dropped; pairs of dropped nodes go, so that a round works on what is still
    undecided only. Nodes without a pair are kept at once.
    """
    left = pairs.select("a", "b")
    if left.limit(together + 1).count() <= together:
        gone = _dropped(left)
    else:
        left, lost = cut(left), None
        while not left.isEmpty():
            heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
            hit = cut(left.join(heads, "a", "left_semi").select("b").distinct())
            left = cut(left.join(hit, "b", "left_anti").join(hit.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
            lost = hit if lost is None else lost.unionByName(hit)
        gone = lost.select(F.col("b").alias("id"))
    return nodes.select("id").join(gone.withColumn("gone", F.lit(True)), "id", "left").select("id", F.col("gone").isNull().alias("kept"))


def _dropped(pairs: DataFrame) -> DataFrame:
    """The nodes (id) that ``keep_first`` drops, by one task that takes them in order."""
    kind = pairs.schema["b"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: dict = {}
        for part in batches:  # by b: what stands before a node is decided
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
                if a not in gone:
                    gone[b] = None
        if gone:
            yield pa.RecordBatch.from_arrays([pa.array(list(gone), part.schema.field("b").type)], ["id"])

    return pairs.repartition(1).sortWithinPartitions("b", "a").mapInArrow(run, f"id {kind}")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.85, minhash: bool = False, keep: bool = True, once: bool = False) -> DataFrame:
    """(id, class_id, links, kept): the class of equal word sets, how many other classes are similar, and whether the row stays.

    Pairs are found by the exact join, or by ``minhash``. Without ``keep`` what stays isn't
    decided and ``kept`` is missing. With ``once`` an id that is repeated counts once.
    """
    member, sets = word_sets(df, id_col, text_col, once)
    pairs = cut((minhash_classes if minhash else similar_classes)(sets, threshold))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    if not keep:
        return member.join(links, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    # classes without a pair stay
    kept = keep_first(links.select(F.col("class_id").alias("id")), pairs).select(F.col("id").alias("class_id"), F.col("kept").alias("stays"))
    out = member.join(links, "class_id", "left").join(kept, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("stays", F.lit(True)) & (F.col("id") == F.col("class_id"))).alias("kept"))
