import itertools
import json
import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as X
from textmill.operators import align, convert, dedup, language, numeric, quality, samples, sequence, serving, tokenize
from textmill.operators import conversation as C
from textmill.sources import readers, sinks
from textmill.streaming import operators as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ready(spark):
    from textmill.session import ship

    ship(spark)
    return spark


def _loop(rows, step):
    out = {}
    for key in {r[0] for r in rows}:
        state = []
        for _, at, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            state, out[key, at] = step(state, v)
    return out


@pytest.mark.parametrize("warm,block", [(4, 16), (64, 64), (0, 8)])
def test_sequential_fold_equals_a_loop(ready, warm, block):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(700):
        t += rnd.choice([0, 1, 5, 40])
        rows.append(("hot" if i % 3 else f"k{i % 4}", i, rnd.choice([None, 0.0, 1.0, 2.0, 9.0, 30.0, 500.0]) if i % 11 else float("nan")))
    df = ready.createDataFrame(rows, "k string, at bigint, v double").withColumn("_x", F.lit("clash"))
    got = {(r["k"], r["at"]): r["spike"] for r in sequence.sequential(df, "k", ["at"], "v", sequence.spike_step(), "spike", warm, block).collect()}
    assert got == _loop(rows, sequence.spike_step()) and any(got.values())
    assert sequence.sequential(df.limit(0), "k", ["at"], "v", sequence.spike_step(), "spike", warm, block).count() == 0


def test_requests_of_a_key_that_never_pauses(ready):
    rows = [("a", i, i * 7_000_000) for i in range(900)]
    df = ready.createDataFrame([(k, i, t // 1_000_000) for k, i, t in rows], "k string, i bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["i"]: r["accepted"] for r in sequence.accepted_requests(df, "k", "ts", "i", 3, 60).collect()}
    want = _loop(rows, sequence.accept_step(3, 60))
    assert got == {i: w for (_, i), w in want.items()}


def test_arrivals_in_a_window_equal_brute_force(ready):
    rnd = random.Random(6)
    rows = [(i, "ab"[rnd.random() < 0.9], rnd.randrange(5000)) for i in range(400)]
    df = ready.createDataFrame(rows, "i int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["i"]: r["in_window"] for r in sequence.in_window(df, "k", "ts", 60).collect()}
    assert got == {i: sum(k2 == k and s - 60 <= s2 <= s for _, k2, s2 in rows) for i, k, s in rows}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def sets(ready):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        base = rnd.sample(words, rnd.randrange(1, 30))
        texts.append(base)
        for _ in range(2):
            texts.append([w for w in base if rnd.random() > 0.06] + rnd.sample(words, rnd.randrange(0, 2)))
    df = ready.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(9001, None), (9002, ""), (None, "a b")], "id bigint, text string").withColumn("words", F.lit("clash"))
    return df, {i: frozenset(t) for i, t in enumerate(texts) if t}


@pytest.mark.parametrize("threshold", [0.5, 0.85, 0.9])
def test_similar_classes_equal_brute_force(sets, threshold):
    df, own = sets
    member, classes = dedup.word_sets(df, "id", "text")
    first = {}
    for i, s in sorted(own.items()):
        first.setdefault(s, i)
    got = {(r["a"], r["b"]) for r in dedup.similar_classes(classes, threshold).collect()}
    assert got == {(min(a, b), max(a, b)) for (s, a), (t, b) in itertools.combinations(first.items(), 2) if _jaccard(s, t) >= threshold - 1e-12}
    assert {(r["id"], r["class_id"]) for r in member.collect()} == {(i, first[s]) for i, s in own.items()}


def test_keep_first_and_minhash_recall(ready, sets):
    df, own = sets
    kept, order = [], sorted(own)
    for i in order:
        if all(_jaccard(own[i], own[j]) < 0.85 for j in kept):
            kept.append(i)
    assert {r["id"] for r in dedup.near_duplicates(df, "id", "text", 0.85).where("kept").collect()} == set(kept)
    real = ready.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, classes = dedup.word_sets(real, "doc_id", "text")
    exact = {(r["a"], r["b"]) for r in dedup.similar_classes(classes, 0.85).collect()}
    met = {(r["a"], r["b"]) for r in dedup.minhash_classes(classes, 0.85).collect()}
    assert met <= exact and len(met) >= 0.9 * len(exact) > 0
    assert dedup.near_duplicates(df.limit(0), "id", "text").count() == 0


def test_chrf_equals_a_loop(ready):
    rows = [("the cat sat.", "the cat sat on it."), ("", "x"), (None, "a b"), ("مرحبا بك", "مرحبا بكم"), ("same text", "same text")]
    df = ready.createDataFrame(rows, "h string, r string")
    total = [[0, 0, 0] for _ in range(8)]
    for h, r in rows:
        h, r = h or "", r or ""
        for x, y, off, top in (("".join(h.split()), "".join(r.split()), 0, 6), (numeric._chrf_words(h), numeric._chrf_words(r), 6, 2)):
            for n in range(1, top + 1):
                a, b = (Counter(tuple(z[i : i + n]) for i in range(len(z) - n + 1)) for z in (x, y))
                for j, v in enumerate((sum(a.values()), sum(b.values()), sum((a & b).values()))):
                    total[off + n - 1][j] += v
    f = []
    for h, r, both in total:
        if h and r:
            p, q = both / h, both / r
            f.append(5 * p * q / (4 * p + q) if p + q else 0.0)
    assert numeric.chrf(df, "h", "r").first()[0] == pytest.approx(100 * sum(f) / len(f))
    assert numeric.chrf(df.limit(0), "h", "r").first()[0] == 0
    assert numeric._chrf_words("a, (b c_ !") == ["a", ",", "(", "b", "c_", "!"]


def test_language_probability_and_filter(ready):
    words = language.profile(ready.read.parquet(f"{SF}/lang_samples.parquet"), F.col("lang"))
    rows = [(1, "The library explains how students can save water in the winter months.", "en"), (2, "The library explains how students can save water in the winter months.", "fr"), (3, None, "en"), (4, "", "en"), (5, "zzzz qqqq", "en"), (6, "anything at all", None)]
    df = language.with_probability(ready.createDataFrame(rows, "id int, text string, lang string"), "text", F.col("lang"), words)
    got = {r["id"]: r["probability"] for r in df.collect()}
    assert got[1] > 0.95 and got[2] < 0.05 and got[3] == got[4] == got[5] == 0 and got[6] is None
    kept = {r["id"] for r in df.where(quality.quality_filter(F.col("text"), probability=F.col("probability"))).collect()}
    assert kept == {1}
    assert language.detect(F.col("text"), words.limit(0)) is not None


def test_top_character_share(ready):
    rows = ["", "aab", "😀😀a", "x" * 100_000 + "y", None, "  a"]
    df = ready.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", quality.top_char_share(F.col("t")).alias("s")).collect()}
    assert got == {i: None if t is None else max(Counter(t).values()) / len(t) if t else 0.0 for i, t in enumerate(rows)}


def test_a_system_turn_far_behind_is_found(ready):
    rows = [(1, [("user", "a")] * 150_000 + [("system", "s")]), (2, [("system", "s")] + [("user", "a")] * 5), (3, [])]
    df = ready.createDataFrame(rows, "i int, c array<struct<role:string,content:string>>")
    assert {r["i"]: r["v"] for r in df.select("i", C.is_valid(F.col("c")).alias("v")).collect()} == {1: False, 2: True, 3: True}


def test_trees_of_any_depth(ready):
    rows = [(str(i), str(i - 1) if i else None, f"t{i}", "assistant" if i % 2 else "prompter") for i in range(90)] + [("x", "nowhere", "lost", "user")]
    df = ready.createDataFrame(rows, "message_id string, parent_id string, text string, role string")
    got = convert.flatten_trees(df).collect()
    assert [(r["leaf_id"], len(r["conversation"])) for r in got] == [("89", 90)]
    loop = ready.createDataFrame([("1", "2", "a", "user"), ("2", "1", "b", "assistant"), ("3", "1", "c", "assistant")], df.schema)
    assert {(r["leaf_id"], len(r["conversation"])) for r in convert.flatten_trees(loop).collect()} == {("3", 2)}


def test_tokenizer(ready):
    texts = ["hello world", "مرحبا بالعالم 😀", "", None, "<|end_turn|> x", "a" * 50_000]
    df = ready.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    end = tokenize.resolve(ready, "<|end_turn|>")
    rows = df.select("i", "t", tokenize.encode(ready, F.col("t")).alias("plain"), tokenize.encode(ready, F.col("t"), special=True, ends=True).alias("ends"))
    rows = rows.withColumns({"back": tokenize.decode(ready, F.col("plain")), "bare": tokenize.decode(ready, F.col("ends"), special=False)}).collect()
    for r in rows:
        assert r["back"] == r["t"] and r["bare"] == (r["t"].replace("<|end_turn|>", "") if r["t"] is not None else None)
    assert end in rows[4]["ends"] and end not in rows[4]["plain"] and rows[3]["plain"] is None
    with pytest.raises(KeyError):
        tokenize.resolve(ready, "<|none|>")


def test_packed_and_collated_samples(ready):
    docs = [(1, [1, 2, 3]), (2, []), (3, None), (4, [4] * 7), (5, [5])]
    df = ready.createDataFrame(docs, "d int, ids array<int>")
    got = {r["sample"]: (r["input_ids"], r["doc_uids"]) for r in samples.packed_samples(df, ["d"], "ids", 4).collect()}
    assert got == {0: ([1, 2, 3, 4], [0, 0, 0, 3]), 1: ([4, 4, 4, 4], [3] * 4), 2: ([4, 4, 5], [3, 3, 4])}
    assert samples.packed_samples(df, ["d"], "ids", 4, drop_last=True).count() == 2
    b = ready.createDataFrame([(0, [1, 2], [9, 9]), (0, [3], [9]), (1, [4], [9])], "batch int, ids array<int>, labels array<int>")
    got = sorted((r["batch"], r["ids"], r["labels"], r["attention_mask"]) for r in samples.collate(b, "batch", {"ids": 0, "labels": -100}).collect())
    assert got == [(0, [1, 2], [9, 9], [1, 1]), (0, [3, 0], [9, -100], [1, 0]), (1, [4], [9], [1])]
    with pytest.raises(ValueError):
        samples.identity_examples(ready, {"a": ["x"]}, 10)


def test_latest_checkpoint(ready):
    names = ["pretrain_step_9.pt", "pretrain_step_120.pt", "pretrain_best.pt", "pretrain_step_x.pt", None]
    row = samples.latest_checkpoint(ready.createDataFrame([(n,) for n in names], "n string"), "n").first()
    assert (row["path"], row["step"]) == ("pretrain_step_120.pt", 120)
    assert samples.latest_checkpoint(ready.createDataFrame([("pretrain_best.pt",)], "n string"), "n").first()["step"] == -1


def test_manifest_keeps_other_errors(ready, tmp_path):
    path = str(tmp_path / "manifest")
    new = ready.createDataFrame([("a", "x")], "name string, license string")
    assert sinks.write_manifest(ready, path, new).count() == 1
    again = ready.createDataFrame([("a", "y"), ("b", "z")], "name string, license string")
    assert {tuple(r) for r in sinks.write_manifest(ready, path, again).collect()} == {("a", "y"), ("b", "z")}
    (tmp_path / "manifest" / "broken.json").write_text("{broken\n")
    assert sinks.write_manifest(ready, path, new).count() == 2
    with pytest.raises(Exception, match="(?i)scheme|filesystem|bucket"):
        sinks.write_manifest(ready, "nofs://host/manifest", new)


def test_line_numbers_over_files(ready, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("\n".join(f"{k}-{i}" if i % 4 else " " for i in range(10)))
    lines = [f"{k}-{i}" for k in range(3) for i in range(10) if i % 4]
    got = {r["line_no"]: r["value"] for r in readers.numbered_lines(ready, str(tmp_path)).collect()}
    assert got == dict(enumerate(lines))
    assert readers.hub_dataset(ready, str(tmp_path.parent), tmp_path.name, fmt="text").count() == 30
    (tmp_path / "c.json").write_text(json.dumps({"a": 1}))
    assert readers.load_config(str(tmp_path / "c.json")) == {"a": 1}
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(TypeError):
        readers.load_config(str(tmp_path / "c.json"))


def test_counted_writes_and_metadata(ready, tmp_path):
    df = ready.range(57).select("id", (F.col("id") % 3).cast("string").alias("s"))
    assert sinks.write_counted(df, str(tmp_path / "out"), "s") == 57
    sinks.append_log(df.limit(2), str(tmp_path / "log"))
    sinks.append_log(df.limit(3), str(tmp_path / "log"))
    assert ready.read.json(str(tmp_path / "log")).count() == 5
    told = json.loads(sinks.tokenizer_metadata(str(tmp_path / "t"), tokenize.VOCABULARY, [("<unk>", 7)], 8).read_text())
    assert told["special_tokens"] == {"<unk>": 7}


def test_principles(ready):
    known = align.principles(ready)
    rows = ready.createDataFrame([(1, "no_illegal_harm"), (2, "none")], "id int, principle_id string")
    assert align.lookup(rows.where("id = 1"), known).first()["category"] == "harmlessness"
    with pytest.raises(Exception, match="no principle"):
        align.lookup(rows, known).collect()


def test_violations_and_registration(ready):
    rows = [(1, "user", "x", ["t"] * 50, 200, 0), (2, "system", "", ["t"] * 51, 201, -1), (3, None, None, None, None, None)]
    df = ready.createDataFrame(rows, "id int, role string, message string, tags array<string>, lim int, off int")
    got = {r["id"]: r["v"] for r in df.select("id", serving.violations(role=F.col("role"), message=F.col("message"), tags=F.col("tags"), limit=F.col("lim"), offset=F.col("off")).alias("v")).collect()}
    assert got == {1: [], 2: ["role", "message", "tags", "limit", "offset"], 3: ["role", "message"]}


def test_streaming_spikes_equal_the_batch(ready, tmp_path):
    rnd = random.Random(1)
    rows = [(i, "ab"[i % 2], rnd.choice([1.0, 2.0, 90.0])) for i in range(300)]
    kind = T.StructType([T.StructField("i", T.LongType()), T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
    for n in range(3):
        (tmp_path / f"in{n}.json").write_text("\n".join(json.dumps(dict(zip("ikv", r))) for r in rows[n * 100 : n * 100 + 100]))
        import os

        os.utime(tmp_path / f"in{n}.json", (n + 1, n + 1))
    s = ready.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = stream.loss_spikes(s, "k", "i", "v").writeStream.format("memory").queryName("spikes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {r["i"]: r["spike"] for r in ready.table("spikes").collect()}
    want = _loop([(k, i, v) for i, k, v in rows], sequence.spike_step())
    assert got == {i: w for (_, i), w in want.items()} and any(got.values())
    assert sum(1 for _ in stream.iterate(ready.range(100))) == 100


def test_median_of_spikes_is_pythons():
    step, seen = sequence.spike_step(), []
    for v in (1.0, 2.0, 3.0, 4.0):
        seen, hit = step(seen, v)
        assert not hit
    assert step(seen, 3 * median(seen) + 0.1)[1] and not step(seen, 3 * median(seen))[1]


def test_words_of_profiles_are_lower(ready):
    df = ready.createDataFrame([("en", "The THE cat"), (None, "x"), ("en", None)], "lang string, text string")
    assert {tuple(r) for r in language.profile(df, F.col("lang")).collect()} == {("en", "the", 2), ("en", "cat", 1)}
    assert X.words is not None
