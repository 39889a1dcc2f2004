import json
import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import align, convert, dedup, numeric, quality, retrieval, sequence
from textmill.operators import conversation as C
from textmill.operators.prefix import prefix_sums
from textmill.plans import corpus, numbers
from textmill.sources import readers, sinks
from textmill.streaming import operators as stream


def one(spark, column, **values):
    names = list(values) or ["x"]
    return spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{n} string" for n in names)).select(column.alias("r")).first()["r"]


def test_prefix_sums_equal_a_loop(spark):
    rows = [(random.Random(i).choice("aab"), i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {r["i"]: (r["s"], r["s_total"]) for r in prefix_sums(df, ["g"], ["i"], {"s": F.col("v")}, n=4).collect()}
    for g in "ab":
        run, own = 0, [r for r in rows if r[0] == g]
        for _, i, v in own:
            assert got[i] == (run, sum(r[2] for r in own))
            run += v
    assert prefix_sums(df.limit(0), ["g"], ["i"], {"s": F.col("v")}).count() == 0


def test_cleaning_and_words(spark):
    assert one(spark, X.clean_arabic(F.col("x")), x="أهلاً،إسلام ـ") == "اهلا ، اسلام"
    assert one(spark, X.strip_tags(F.col("x")), x="<b>a</b>&lt;i&gt;  z") == "a &lt;i&gt; z"
    assert one(spark, X.collapse(F.col("x")), x="　 a\t\u001cb ") == "a b"
    assert one(spark, X.lower_words(F.col("x")), x="A_b é3 ²") == ["a_b", "é3", "²"]
    assert one(spark, X.detect_language(F.col("x")), x="عايز كده") == "ar-dialect"


def test_cleaning_normalises(spark, tmp_path):
    docs = [(1, "ar", "ﻻ ﷲ ＡＢ"), (2, "en", "<p>caf\u0065\u0301 &amp; &lt;b&gt;&nbsp;x</p>"), (3, "en", None), (4, "ar", None), (5, "en", "plain")]
    spark.createDataFrame(docs, "doc_id int, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["cleaned"] for r in corpus.corpus_clean(spark, str(tmp_path)).collect()}
    assert got == {1: "لا الله AB", 2: "café & <b> x", 3: "", 4: "", 5: "plain"}


def test_fingerprints_see_through_widths(spark):
    rows = [(1, [("user", " ＡＢ  ﻻ"), ("assistant", None)]), (2, [("user", "ab لا"), ("assistant", "")]), (3, [("user", "ab"), ("assistant", "")]), (4, [("user", "AB"), ("assistant", "")])]
    got = {r["id"]: r["fp"] for r in spark.createDataFrame(rows, "id int, c array<struct<role: string, content: string>>").select("id", C.fingerprint(F.col("c")).alias("fp")).collect()}
    assert got[1] == got[2] != got[3] == got[4]


@pytest.mark.parametrize(("text", "keep"), [("a" * 29, False), ("the quick brown fox jumps over it", True), ("ab cd " * 40, False), ("1234 5678 9012 3456 7890 1234 ab", False), (None, False), ("", False)])
def test_quality_filter(spark, text, keep):
    assert bool(one(spark, quality.quality_filter(F.col("x")), x=text)) is keep


def test_harm_and_help(spark):
    assert one(spark, quality.is_harmful(F.col("x")), x="SKILLful work") is True
    assert one(spark, align.harmlessness(F.col("p"), F.col("r")), p="a bomb", r="a bomb") == 0
    assert one(spark, align.helpfulness(F.col("r")), r="because " * 12) == 3
    assert align.critique_rows(spark.createDataFrame([("hello",), ("a bomb",)], "prompt string")).count() == 10


def test_deficit_cycle_and_interleave(spark):
    assert sequence.deficit_cycle({"a": 0.5, "b": 0.5, "c": 0}, 4) == ["a", "b", "a", "b"]
    with pytest.raises(ValueError):
        sequence.deficit_cycle({"a": 0}, 3)
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(40)], "i int, b string")
    got = [r["b"] for r in sequence.interleave(df, "b", ["i"], {"a": 0.75, "b": 0.25}, 100).orderBy("slot").collect()]
    cycle, want, left = sequence.deficit_cycle({"a": 0.75, "b": 0.25}, 100), [], {"a": 32, "b": 8}
    for s in cycle:
        if left[s]:
            left[s] -= 1
            want.append(s)
    assert got == want


def test_shards_take_whole_tables_and_stop_at_the_cap(spark, tmp_path):
    text = "plain words of a document " * 4_000  # 104,000 bytes
    spark.createDataFrame([(i, text, "en", "web") for i in range(30)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(corpus.shard_assignment(spark, str(tmp_path)).collect())
    assert [r["doc_id"] for r in got] == list(range(30)) and {r["shard"] for r in got} == {0}
    rows = spark.createDataFrame([(i, 10) for i in range(10)], "i int, n int")
    capped = sequence.shards(rows, ["i"], F.col("n"), 25, 70)
    assert sorted((r["i"], r["shard"]) for r in capped.collect()) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2)]


def test_packing_keeps_every_token(spark):
    sizes = [0, 3, 10, 25, 1, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n bigint")
    rows = sequence.pack(df, ["i"], "n", 10).collect()
    assert sum(r["to"] - r["from"] for r in rows) == sum(sizes)
    fill = {}
    for r in rows:
        fill[r["sample"]] = fill.get(r["sample"], 0) + r["to"] - r["from"]
    assert all(v == 10 for k, v in fill.items() if k < max(fill))


def test_history_crosses_days_and_blocks(spark, tmp_path):
    from statistics import median

    r = random.Random(5)
    rows = [(i, i % 3, f"2025-01-{1 + i // 4:02d} 10:00:00", "ab"[i % 2], r.choice([1.0, 1.5, 2.0, 9.0])) for i in range(120)]
    spark.createDataFrame(rows, "event_id bigint, user_id int, t string, event_type string, value double").withColumn("ts", F.expr("try_cast(t as timestamp)")).drop("t").write.parquet(f"{tmp_path}/events.parquet")
    want, seen = {}, {"a": [], "b": []}
    for i, _, t, kind, v in rows:
        if int(t[8:10]) <= 31:
            past = seen[kind][-50:]
            want[i] = len(past) >= 3 and v > 3 * median(past)
            seen[kind].append(v)
    got = {x["event_id"]: x["spike"] for x in numbers.loss_spikes(spark, str(tmp_path)).collect()}
    assert got == want and any(want.values())
    cut = sequence.with_history(spark.createDataFrame([(i, "k") for i in range(20)], "i int, k string"), "k", "i", 3, block=8)
    assert sorted((x["_block"], x["i"]) for x in cut.where("_old").collect()) == [(1, 5), (1, 6), (1, 7), (2, 13), (2, 14), (2, 15)]


def test_accepted_requests_equal_a_loop(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("xxxy"), 1_700_000_000 + rnd.randrange(20_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["i"]: r["accepted"] for r in sequence.accepted_requests(df, "k", "ts", "i", 2, 600).collect()}
    for k in "xy":
        held = []
        for i, _, t in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            held = [h for h in held if h >= t - 600]
            assert got[i] is (len(held) < 2)
            if got[i]:
                held.append(t)


def test_near_duplicates_equal_the_greedy_loop(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(60):
        w = base[:]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(30)] = f"v{rnd.randrange(12)}"
        texts.append(" ".join(w))
    texts += ["", None, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["id"]: r["kept"] for r in dedup.near_duplicates(df, "i", "t", 0.85).collect()}
    kept = []
    for i, t in enumerate(texts):
        w = set((t or "").split())
        if not w:
            assert i not in got
            continue
        new = all(len(w & k) / len(w | k) < 0.85 for k in kept)
        assert got[i] is new
        if new:
            kept.append(w)


def test_conversation_expressions(spark):
    conv = [{"role": "system", "content": "be good"}, {"role": "user", "content": " hi  there "}, {"role": "assistant", "content": "ok"}]
    df = spark.createDataFrame([(conv,), ([],), (None,)], "c array<struct<role:string,content:string>>")
    rows = df.select(C.quality_score(F.col("c"), F.lit("en")).alias("q"), C.last_assistant(F.col("c")).alias("l"), C.is_valid(F.col("c")).alias("v")).collect()
    assert rows[0]["l"] == 2 and rows[0]["v"] and rows[0]["q"] > 0.7 and rows[1]["q"] == 0 and rows[2]["q"] == 0
    s = C.training_sample(F.col("c"), 6)
    r = df.limit(1).select(s["input_tokens"].alias("i"), s["label_tokens"].alias("l")).first()
    assert r["i"][-2:] == ["ok", C.END_TURN] and r["l"][-2:] == ["ok", C.END_TURN] and len(r["i"]) == len(r["l"]) == 6


def test_trees(spark):
    rows = [("r", None, "q", "prompter"), ("a", "r", "x", "assistant"), ("b", "r", "", "assistant"), ("c", "b", "more", "prompter"), ("o", "lost", "y", "assistant"), ("s", "", "alone", "prompter")]
    got = {r["leaf_id"]: [t["content"] for t in r["conversation"]] for r in convert.flatten_trees(spark.createDataFrame(rows, "message_id string, parent_id string, text string, role string")).collect()}
    assert got == {"a": ["q", "x"], "c": ["q", "more"]}


def test_converters(spark):
    d = convert.from_dolly(spark.createDataFrame([("do", "ctx", "done", None), ("", "", "x", "B")], "instruction string, context string, response string, category string"), "sys", "20250101000000").collect()
    assert len(d) == 1 and d[0]["category"] == "A" and d[0]["conversation"][1]["content"] == "do Context: ctx"
    a = convert.from_alpaca(spark.createDataFrame([("x", "", "الرد: نعم!!!")], "instruction string, input string, output string"), "s", "t").first()
    assert a["conversation"][2]["content"] == "نعم!"


def test_retrieval(spark):
    assert one(spark, retrieval.tags_to_csv(F.split("x", ";")), x=" A;b,c;a; ;B") == "A,b c,B"
    m = spark.createDataFrame([(1, "a%b", 5), (2, "AxB", 6)], "id int, q string, n int")
    assert [r["id"] for r in retrieval.like_search(m, ["q"], "a_b").collect()] == [1, 2]
    assert {r["id"]: r["n"] for r in retrieval.upsert(m, spark.createDataFrame([(2, "z", 9)], "id int, q string, n int"), "id").collect()} == {1: 5, 2: 9}
    assert sorted(r["id"] for r in retrieval.append_rows(m, m.drop("id"), "id").collect()) == [1, 2, 3, 4]
    assert retrieval.add_missing(m, "user_id", "bigint").columns[-1] == "user_id"


def test_numbers(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 3.0, 0.0])], "k int, v array<double>")
    assert numeric.top_k(numeric.long_form(df, "k", "v"), "k", 1).count() == 2
    assert abs(sum(df.select(numeric.softmax(F.col("v")).alias("s")).first()["s"]) - 1) < 1e-12
    assert numeric.top_p(numeric.long_form(df, "k", "v"), "k", 0.0).count() == 1
    same = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat")], "h string, r string")
    assert abs(numeric.bleu(same, "h", "r").first()["bleu"] - 100) < 1e-6


def test_files(spark, tmp_path):
    p = tmp_path / "dolly_x.jsonl"
    p.write_text('{"text": "a", "language": "en"}\n\n[1]\nnot json\n"str"\n{"text": null}\n')
    rows = readers.read_jsonl(spark, str(p), readers.CORPUS).collect()
    assert [r["text"] for r in rows] == ["a", None]
    (tmp_path / "l.json").write_text(json.dumps([{"text": "x"}, 3]))
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"text": "y"}]}))
    (tmp_path / "o.json").write_text(json.dumps({"text": "z"}))
    assert [readers.read_json(spark, str(tmp_path / f"{n}.json"), readers.CORPUS).first()["text"] for n in "ldo"] == ["x", "y", "z"]
    assert readers.read_json(spark, str(tmp_path / "q.txt"), readers.CORPUS).count() == 0
    total = readers.corpus_stats(spark, str(p)).where("file is null").first()
    assert total["lines"] == 5
    sinks.write_jsonl(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    m = spark.createDataFrame([("a", 1)], "name string, n int")
    sinks.write_manifest(spark, str(tmp_path / "m"), m)
    assert sinks.write_manifest(spark, str(tmp_path / "m"), spark.createDataFrame([("a", 2), ("b", 1)], "name string, n int")).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, [str(tmp_path / "none")])
    frames = one(spark, sinks.parse_sse(F.col("x")), x='event: a\ndata: {"k": 1}\n\ndata: bad\n\n')
    assert frames == ['{"k": 1}']


def test_streaming_rate_limit(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(i, "k", 1_700_000_000 + i) for i in range(6)], "i int, k string, t bigint").withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(str(src))
    s = spark.readStream.schema("i int, k string, ts timestamp").parquet(str(src))
    q = stream.rate_limit(s, "k", "ts", 2, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["i"] for r in spark.table("limited").where("accepted").collect()) == [0, 1]


def test_stream_joins_chunks(spark):
    rows = [(1, 2, "chunk", "lo"), (1, 1, "chunk", "hel"), (1, 3, "done", None)]
    assert stream.join_chunks(spark.createDataFrame(rows, "message_id int, seq int, type string, text string")).first()["text"] == "hello"


def test_registry_is_whole():
    from textmill.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 60
