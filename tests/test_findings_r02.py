"""Cases of the second round's findings: disk of the near-duplicate queries, rounds of the fold."""

from __future__ import annotations

import random
from functools import partial

import pytest

from textmill.operators import dedup, sequence


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """Columns and rows of what dedup and sequence write by ``cut``."""
    seen = []

    def counted(df, real):
        out = real(df)
        seen.append((out.columns, out.count()))
        return out

    for m in (dedup, sequence):
        monkeypatch.setattr(m, "cut", partial(counted, real=m.cut))
    return seen


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def _texts(n: int, common: int, seed: int) -> list[set]:
    """Sets in which every word is frequent, some of them near copies of others."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if i % 4 == 3:
            w = set(rnd.choice(out))
            for _ in range(rnd.randrange(1, 7)):
                w ^= {f"w{rnd.randrange(common)}"}
        else:
            w = {f"w{rnd.randrange(common)}" for _ in range(rnd.randrange(1, 70))}
        out.append(w)
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.85, 0.9])
def test_similar_classes_equal_brute_force(spark, threshold):
    sets = list({frozenset(w) for w in _texts(400, 90, 3) if w})
    df = spark.createDataFrame([(i, sorted(w)) for i, w in enumerate(sets)], "class_id bigint, words array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.similar_classes(df, threshold).collect()}
    want = {(i, j): _jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if _jaccard(sets[i], sets[j]) >= threshold}
    assert got == want and want


def test_only_keys_and_pairs_are_written_of_frequent_words(spark, written):
    """no words go to disk, and candidates are few though no word is rare."""
    rows = [(i, " ".join(sorted(w))) for i, w in enumerate(_texts(1500, 120, 4)) if w]
    got = {r["id"]: r["kept"] for r in dedup.near_duplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    kept, want = [], {}
    for i, t in rows:
        w = set(t.split())
        want[i] = all(_jaccard(w, k) < 0.85 for k in kept)
        if want[i]:
            kept.append(w)
    assert got == want
    assert not any("words" in c or "w" in c for c, _ in written)
    assert sum(n for _, n in written) < 5 * len(rows)


def test_rounds_of_the_fold_write_states_only(spark, written):
    """the rows are written once, however many rounds the states take to join; rows of no key stay."""
    rnd, rows = random.Random(8), []
    for i in range(1200):
        rows.append((["a", "b", None][i % 3], i, rnd.choice([1.0, 2.0, 5.0, 9.0, 30.0, 80.0, None])))
    step = sequence.spike_step(window=9)
    got = {r["i"]: r["spike"] for r in sequence.sequential(spark.createDataFrame(rows, "k string, i bigint, v double"), "k", ["i"], "v", step, "spike", 3, 16).collect()}
    want, states = {}, {}
    for k, i, v in rows:
        states[k], want[i] = step(states.get(k, []), v)
    assert got == want and any(want.values())
    assert [c for c, _ in written if "_end" in c][1:], "there were rounds"
    assert sum("v" in c for c, _ in written) == 1
    assert not any("spike" in c for c, _ in written)


def test_conversations_are_neither_moved_nor_written(spark, written, tmp_path):
    """an id that is repeated counts once, and neither turns nor words are written."""
    from textmill.plans import corpus

    texts = [" ".join(sorted(w)) for w in _texts(300, 60, 6)]
    rows = [(f"c{i:03}", [("user", t), ("assistant", "ok")]) for i, t in enumerate(texts)]
    rows += rows[::5]
    spark.createDataFrame(rows, "id string, conversation array<struct<role string, content string>>").write.parquet(str(tmp_path / "instruction_examples.parquet"))
    got = {r["id"]: (r["class_id"], r["kept"]) for r in corpus.conversation_near_dedup(spark, str(tmp_path)).collect()}
    first, kept, want = {}, [], {}
    for i, t in enumerate(texts):
        w = frozenset([*t.split(), "ok"])
        c = first.setdefault(w, f"c{i:03}")
        new = c == f"c{i:03}" and all(_jaccard(w, k) < 0.9 for k in kept)
        want[f"c{i:03}"] = (c, new)
        if new:
            kept.append(w)
    assert got == want and len(got) == len(texts)
    assert not any({"words", "text", "conversation"} & set(c) for c, _ in written)


def test_bands_are_not_written(spark, written):
    """of the bands of MinHash only pairs go to disk."""
    rows = [(i, " ".join(sorted(w))) for i, w in enumerate(_texts(600, 120, 7)) if w]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r["id"] for r in dedup.near_duplicates(df, "id", "text", minhash=True).where("links > 0").collect()}
    assert sum(n for _, n in written) < 5 * len(rows) and not any("words" in c for c, _ in written)
    exact = {r["id"] for r in dedup.near_duplicates(df, "id", "text").where("links > 0").collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact) > 0


def _long(sizes: list[int], seed: int) -> list[set]:
    """Sets of about these sizes that share two words of three or more, each with a near copy."""
    rnd, out = random.Random(seed), []
    for n in sizes:
        w = {f"w{i}" for i in rnd.sample(range(n * 17 // 14), n)}
        out += [w, w ^ {f"w{i}" for i in rnd.sample(range(n * 17 // 14), n // 20)}]
    return out


def test_long_sets_are_told_apart_before_words_are_read(spark, written):
    """candidates of long sets are few, though they meet in many bands; each pair that the bands found before stays."""
    sets = _long([350] * 60, 9)
    df = spark.createDataFrame([(i, sorted(w)) for i, w in enumerate(sets)], "class_id bigint, words array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in dedup.minhash_classes(df, 0.85).collect()}
    want = {(i, j): _jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if _jaccard(sets[i], sets[j]) >= 0.85}
    assert got == want and len(want) >= 60
    assert [n for c, n in written if c == ["ka", "kb"]][0] < 2 * len(want)


def test_long_sets_with_sketches_of_several_sizes_are_found(spark):
    """a longer sketch drops no similar pair, also where the other set has a shorter one or none."""
    sets = _long([195, 200, 203, 210, 500, 512, 525, 1000, 1010, 1024, 1030, 2040, 2050] * 4, 10)
    df = spark.createDataFrame([(i, sorted(w)) for i, w in enumerate(sets)], "class_id bigint, words array<string>")
    want = {(i, j): _jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if _jaccard(sets[i], sets[j]) >= 0.85}
    kinds = {tuple(sorted(0 if n < 200 else max(512, 1 << (n.bit_length() - 1)) for n in (len(sets[i]), len(sets[j])))) for i, j in want}
    assert {(0, 512), (512, 1024), (1024, 2048)} <= kinds
    assert {(r["a"], r["b"]): r["similarity"] for r in dedup.minhash_classes(df, 0.85).collect()} == want
