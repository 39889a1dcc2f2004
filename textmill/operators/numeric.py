"""Numeric reductions: logits, losses, schedules and metrics, as expressions and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as X


def long_form(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, pos, x) of an array column."""
    return df.select(key, F.posexplode(array).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Entries at least as large as the k-th; ties with it stay. A group is one array."""
    w = Window.partitionBy(key).orderBy(F.col("x").desc())
    return rows.withColumn("r", F.rank().over(w)).where(F.col("r") <= k).drop("r")


def softmax(a: Column) -> Column:
    e = X.let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return X.let(e, lambda v: X.let(F.aggregate(v, F.lit(0.0), lambda s, y: s + y), lambda z: F.transform(v, lambda x: x / z)))


def log_sum_exp(a: Column) -> Column:
    return X.let(F.array_max(a), lambda top: top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def top_p(rows: DataFrame, key: str, p: float) -> DataFrame:
    """The smallest prefix by falling probability whose mass passes p; the first always stays."""
    total = rows.groupBy(key).agg(F.max("x").alias("m")).join(rows, key).groupBy(key, "m").agg(F.sum(F.exp(F.col("x") - F.col("m"))).alias("z"))
    q = rows.join(total, key).withColumn("q", F.exp(F.col("x") - F.col("m")) / F.col("z"))
    w = Window.partitionBy(key).orderBy(F.col("x").desc(), "pos")
    before = F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return q.withColumn("before", before).where((F.col("before") <= p)).select(key, "pos", "x", "q")


def temperature(a: Column, t: float) -> Column:
    if t <= 0:
        raise ValueError("the temperature must be positive")
    return F.transform(a, lambda x: x / t)


def repetition_penalty(rows: DataFrame, seen: DataFrame, key: str, penalty: float) -> DataFrame:
    """Entries already seen: positive ones divided, others multiplied by ``penalty``."""
    hit = seen.select(key, "pos").distinct().withColumn("hit", F.lit(True))
    x = F.col("x")
    return rows.join(hit, [key, "pos"], "left").select(key, "pos", F.when(F.col("hit").isNull(), x).when(x < 0, x * penalty).otherwise(x / penalty).alias("x"))


def rms_norm(a: Column, eps: float = 1e-6) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a)
    return X.let(F.sqrt(mean + eps), lambda r: F.transform(a, lambda x: x / r))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, dot / n)


def learning_rate(step: Column, warmup: int, total: int, kind: str = "cosine", floor: float = 0.1) -> Column:
    """Scale in 0 to 1: linear warm-up, then cosine or linear decay to ``floor``."""
    done = F.least(F.lit(1.0), (step - warmup) / float(max(total - warmup, 1)))
    down = 0.5 * (1 + F.cos(F.pi() * done)) if kind == "cosine" else 1 - done
    return F.when(step < warmup, step / float(max(warmup, 1))).otherwise(floor + (1 - floor) * down)


def preference_loss(delta: Column) -> Column:
    """-log sigmoid, in its stable form."""
    return F.greatest(-delta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(delta)))


def clipped_surrogate(new: Column, old: Column, advantage: Column, clip: float = 0.2) -> Column:
    ratio = F.exp(new - old)
    return -F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + clip)), F.lit(1 - clip)) * advantage)


def round_up(x: Column, m: int) -> Column:
    return F.ceil(x / m) * m


def draw(a: Column, u: Column) -> Column:
    """The first index whose cumulative probability reaches ``u``."""
    state = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i"))
    end = F.aggregate(softmax(a), state, lambda s, x: F.struct((s["c"] + x).alias("c"), (s["i"] + (s["c"] + x < u).cast("int")).alias("i")))
    return F.least(end["i"], F.size(a) - 1)


def last_token(values: str, mask: Column) -> Column:
    """The element at the last unmasked place, the first if nothing is."""
    return F.element_at(values, F.greatest(mask, F.lit(1)).cast("int"))


def bleu(df: DataFrame, hypothesis: str, reference: str, order: int = 4) -> DataFrame:
    """Corpus BLEU on white-space and punctuation tokens, one row (bleu, matched lengths); clipped counts are summed in one pass."""
    pieces = lambda c: X.all_matches(F.coalesce(F.col(c), F.lit("")), rf"{X.WORD}|[^\p{{L}}\p{{N}}_{X.WS_CLASS}]")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from collections import Counter

        for hs, rs in batches:
            rows = []
            for h, r in zip(hs, rs):
                a, b = list(h), list(r)
                out = [len(a), len(b)]
                for n in range(1, order + 1):
                    x, y = Counter(zip(*[a[i:] for i in range(n)])), Counter(zip(*[b[i:] for i in range(n)]))
                    out += [sum((x & y).values()), max(len(a) - n + 1, 0)]
                rows.append(out)
            yield pd.Series(rows)

    s = df.select(stats(pieces(hypothesis), pieces(reference)).alias("s")).agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 + 2 * order)])
    logs = sum((F.log(F.greatest(F.col(f"s{2 + 2 * n}"), F.lit(1e-9)) / F.greatest(F.col(f"s{3 + 2 * n}"), F.lit(1))) for n in range(order)), F.lit(0.0)) / order
    brief = F.when(F.col("s0") < F.col("s1"), F.exp(1 - F.col("s1") / F.greatest(F.col("s0"), F.lit(1)))).otherwise(1.0)
    return s.select((100 * brief * F.exp(logs)).alias("bleu"), F.col("s0").alias("hypothesis_tokens"), F.col("s1").alias("reference_tokens"))


def chrf(df: DataFrame, hypothesis: str, reference: str, letters: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """Corpus chrF++: the F score over n-grams of letters (white space left out) and of words, counted over all rows.

    Orders that neither side has are left out of the mean. Counts are summed in one pass.
    """
    orders = letters + words

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from collections import Counter

        def grams(seq, n: int) -> Counter:
            return Counter(zip(*[seq[i:] for i in range(n)]))

        for hs, rs in batches:
            rows = []
            for h, r in zip(hs, rs):
                h, r = h or "", r or ""
                out = []
                for x, y, top in (("".join(h.split()), "".join(r.split()), letters), (_chrf_words(h), _chrf_words(r), words)):
                    for n in range(1, top + 1):
                        a, b = grams(x, n), grams(y, n)
                        out += [sum(a.values()), sum(b.values()), sum((a & b).values())]
                rows.append(out)
            yield pd.Series(rows)

    s = df.select(stats(hypothesis, reference).alias("s")).agg(*[F.coalesce(F.sum(F.col("s")[i]), F.lit(0)).alias(f"s{i}") for i in range(3 * orders)])
    total, count = F.lit(0.0), F.lit(0)
    for i in range(orders):
        h, r, both = (F.col(f"s{3 * i + j}") for j in range(3))
        p, q = both / F.greatest(h, F.lit(1)), both / F.greatest(r, F.lit(1))
        f = F.when(p + q > 0, (1 + beta**2) * p * q / F.greatest(beta**2 * p + q, F.lit(1e-16))).otherwise(0.0)
        used = (h > 0) & (r > 0)
        total, count = total + F.when(used, f).otherwise(0.0), count + used.cast("int")
    return s.select((100 * total / F.greatest(count, F.lit(1))).alias("chrf"))


def _chrf_words(text: str) -> list[str]:
    """Words with a punctuation mark at either end set off."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and not w[-1].isalnum() and w[-1] != "_":
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and not w[0].isalnum() and w[0] != "_":
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out
