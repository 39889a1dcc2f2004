import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import boilerplate, cutoff, garbled, lang, lookalike, mixture, packing, pairs, personal, queries, rebuild, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ready(spark):
    from textmill.session import ship

    ship(spark)
    return spark


CONV = "id string, language string, conversation array<struct<role:string,content:string>>, lang string, turn_no int, kind string"
EN = "The printed timetable helps small workshops keep their notes in good order."
FR = "Le guide de la bibliothèque explique comment les élèves peuvent réduire l'attente."
AR = "يساعد دليل المكتبة الطلاب على ترتيب الملاحظات في نهاية كل يوم."


@pytest.fixture(scope="module")
def samples(ready):
    return ready.read.parquet(f"{SF}/lang_samples.parquet")


@pytest.fixture(scope="module")
def model(samples):
    return lang.fit(samples)


# 1


def test_languages_of_held_out_sentences(samples):
    rows = [(r["lang"], r["text"]) for r in samples.orderBy(F.md5(F.col("sample_id").cast("string"))).collect()]
    m = lang.train(rows[:240])
    held = rows[240:]
    best, sure = lang.classify(m, [(t, bool(lang._AR.search(t))) for _, t in held])
    assert np.mean([lang.LANGS[b] == x for b, (x, _) in zip(best, held)]) >= 0.97
    assert ((sure > 0) & (sure <= 1)).all()


def test_scores_equal_the_kernel(model):
    texts = ["abc abd", EN, "", "x"]
    row, gram, n = lang.presence(texts)
    for i in range(len(texts)):
        own = gram[row == i]
        assert len(set(own)) == len(own) == n[i]
        want = model.table[own].sum(0)[: len(lang.LANGS)] / np.sqrt(max(n[i], 1))
        assert np.allclose(model.scores(texts)[i], want, atol=1e-5)


def test_label_turns_edges(ready, model):
    rows = [
        ("a", "EN ", [("user", EN), ("assistant", EN)], "x", 1, "k"),
        ("b", "fr", [("user", EN), ("assistant", FR + " " + AR)], None, None, None),
        ("b", "fr", [("user", EN), ("assistant", FR + " " + AR)], None, None, None),
        ("c", None, None, None, None, None), ("d", "en", [], None, None, None), ("e", "en", [(None, None), ("user", "n/a"), ("assistant", "```\nx = 1\n```")], None, None, None),
        ("f", None, [("human", EN * 3000)], None, None, None), (None, "en", [("user", FR)], None, None, None), ("g", "en", [("user", 'Translate it. (in Arabic: "دليل القياس")')], None, None, None),
    ]
    df = ready.createDataFrame(rows, CONV)
    got = {(r["id"], r["turn_no"], r["lang"], r["wrong"]) for r in lang.label_turns(df, model).collect()}
    assert {("a", 0, "en", False), ("a", 1, "en", False), ("b", 0, "en", True), ("b", 1, "fr", True), ("b", 1, "ar", True), ("f", 0, "en", True)} <= got
    assert not [g for g in got if g[0] in ("c", "d", "e")] and not [g for g in got if g[0] == "g" and g[2] != "en"]
    assert lang.label_turns(df.limit(0), model).count() == 0
    assert lang.label_turns(df, lang.fit(ready.createDataFrame([], "sample_id bigint, lang string, text string"))).count() >= 0


def test_segments_cover_mixed_turns(ready, model):
    text = EN + " " + AR + " " + FR + " `x`\n```\ncode = 1\n```\n" + EN
    rows = [("a", "en", [("user", text), ("assistant", EN)]), ("a", "en", [("user", text), ("assistant", EN)]), ("b", None, None), ("c", "en", [("user", None), ("assistant", "none")]), ("d", "en", [("user", (EN + " " + AR + "\n") * 2000)])]
    df = ready.createDataFrame(rows, "id string, language string, conversation array<struct<role:string,content:string>>").withColumn("start", F.lit("clash"))
    got = lang.label_segments(df, model).distinct().orderBy("id", "turn_no", "segment_no").collect()
    own = [r for r in got if r["id"] == "a" and r["turn_no"] == 0]
    assert [r["lang"] for r in own] == ["en", "ar", "fr", "en"] and [r["segment_no"] for r in own] == [0, 1, 2, 3]
    for r, t in zip(own, (EN, AR, FR, EN)):
        assert text[r["start"] : r["end"]].strip().startswith(t) and 0.5 < r["confidence"] <= 1
    assert len([r for r in got if r["id"] == "d"]) == 4000 and not {"b", "c"} & {r["id"] for r in got}
    assert lang.label_segments(df.limit(0), model).count() == 0


def test_landmarks_are_a_subset_and_confidence_is_calibrated(samples):
    rows = sorted((r["lang"], r["text"]) for r in samples.collect())
    m = lang.train(rows)
    assert 0 <= m.error < 0.05
    sharp = lang.calibrate(rows)
    assert 1 <= sharp <= 40
    m2 = lang.train(rows[::2])
    segs = [(s, x) for x, t in rows[1::2] for s in lang.segments(t)]
    score = lang.masked_scores(m2, [s for s, _ in segs])
    right = np.array([lang.LANGS[b] == x for b, (_, x) in zip(score.argmax(1), segs)])
    assert abs(lang._softmax_top(score, sharp).mean() - right.mean()) < 0.03


def test_a_short_sentence_of_another_script_counts():
    segs = [("a longer sentence in one language is written here", False), ("هذا هو الجواب الصحيح", True)]
    assert set(lang.turn_languages(segs, np.array([3, 0]), np.array([0.9, 0.9]), None)) == {3, 0}


# 2


PERSONAL = [
    ("You can reach me at ordan.elmham+x@mailbay.example, or 555-0123 ext. 4.", ["email", "phone"]),
    ("mail ordan [at] mailbay [dot] test", ["email"]),
    ("My name is Samira Dunamund and I live at 12 Fennel Road, Norvane.", ["address", "name"]),
    ("Passport no. ZX 1234567 was issued; my national ID is 99/1234567/1.", ["id_number", "id_number"]),
    ("رقم الهوية ٩١٢٣٤٥٦٧٨٩٠١٢٣ ورقم الجوال +٢٠ ١٠٠ ٥٥٥ ٠١٥٤", ["id_number", "phone"]),
    ("اتصل بالسيد ريمان السهلواني", ["name"]),
    ("أسكن في صندوق بريد ٩٤٩٧، كويلمير", ["address"]),
    ("Order 4006-8131-24 is open, the build is 4.4.7050182, see https://docs.x.example/v1/setup@latest at 2024-06-13.", []),
    ("The Copperwell Road junction was closed. Mark it with @dataclass.", []),
    (None, []), ("", []), ("x " * 40_000, []),
]


def test_personal_information(ready):
    rows = [(i, t) for i, (t, _) in enumerate(PERSONAL)] + [(0, PERSONAL[0][0]), (None, PERSONAL[0][0])]
    df = ready.createDataFrame(rows, "id bigint, content string").withColumn("kind", F.lit("clash")).withColumn("start", F.lit(1))
    texts = personal._texts(df, "t", "id", ["content"])
    names = ready.read.parquet(f"{SF}/person_names.parquet")
    spans = personal.find(texts, names)
    got = {}
    for r in personal.numbered(spans).collect():
        got.setdefault(r["row_id"], []).append(r["kind"])
    for i, (t, want) in enumerate(PERSONAL):
        assert sorted(got.get(i, [])) == sorted(want), t
    masked = {r["row_id"]: r["text"] for r in personal.mask(texts, spans).collect()}
    assert masked[0] == "You can reach me at [EMAIL], or [PHONE]."
    assert personal.find(texts.limit(0), names).count() == 0
    assert personal.find(texts, names.limit(0)).where("kind = 'email'").count() == 2


UNSEEN = {
    "Contact Olivia Hartwell about it.": "Olivia Hartwell", "I met Priya Natarajan there.": "Priya Natarajan", "Her name is Łucja Nowak.": "Łucja Nowak", "Mr. O'Brien is away.": "O'Brien", "My name is Zhang Wei.": "Zhang Wei",
    "My name is Nguyễn Văn An.": "Nguyễn Văn An", "Je m'appelle Élodie Fâcheux.": "Élodie Fâcheux", "Ich heiße Jürgen Groß.": "Jürgen Groß", "Me llamo Íñigo Muñoz.": "Íñigo Muñoz", "Dr Keller called.": "Keller",
}


def test_unseen_names_and_rejected_candidates(ready):
    rows = [(i, t) for i, t in enumerate(UNSEEN)]
    df = ready.createDataFrame(rows, "id bigint, content string")
    real = personal._texts(ready.read.parquet("/root/testdata/sf0.01/chat_messages.parquet"), "chat_messages", "id", ["content"])
    spans = personal.scored(personal._texts(df, "probe", "id", ["content"]).unionByName(real), ready.read.parquet(f"{SF}/person_names.parquet")).collect()
    texts = dict(rows)
    got = {texts[r["row_id"]][r["start"] : r["end"]] for r in spans if r["tbl"] == "probe" and r["p"] >= 0.5 and r["kind"] == "name"}
    assert got == set(UNSEEN.values())
    assert any(r["p"] < 0.5 for r in spans if r["kind"] == "name") and any(r["p"] < 0.5 for r in spans if r["kind"] == "phone")


def test_candidates_have_no_narrow_gate(ready):
    names = personal.Names([(r["name"], r["name_part"], r["script"]) for r in ready.read.parquet(f"{SF}/person_names.parquet").collect()])
    kinds = lambda t: {c[2] for c in personal.candidates(t, names)}
    for w in personal._NUMBER_WORDS:
        assert "phone" in kinds(" ".join([w] * 7)), w
    for t in ("12 Fennel St", "P.O. Box 12", "PO Box 12", "BP 1234", "B.P. 1234", "Postfach 1234", "Boîte postale 123", "Apartado 123", "Casilla 1234", "Gartenstraße 5", "Lindenweg 5", "Marktplatz 5", "12 rue Lumen", "12 bis, avenue Lumen", "calle Mayor 5", "c/ Mayor 5", "avda. Mayor 12", "عمارة 5، شارع النيل", "12، شارع النيل", "شارع النيل، رقم 5", "ص.ب 123", "صب 123", "صندوق بريد 12"):
        assert "address" in kinds(t), t
    assert "email" in kinds("mark it with @dataclass")
    # a letter that changes its number when lower-cased doesn't shift the spans
    t = "İİİ write to ordan@mailbay.example or 12 Fennel Road"
    assert {t[c[0] : c[1]] for c in personal.candidates(t, names) if c[2] in ("email", "address")} == {"ordan@mailbay.example", "12 Fennel Road"}


def test_a_gazetteer_beyond_its_bound_is_an_error(ready, monkeypatch):
    monkeypatch.setattr(personal, "MAX_NAMES", 2)
    with pytest.raises(ValueError):
        personal.find(personal._texts(ready.createDataFrame([(1, "x")], "id bigint, content string"), "t", "id", ["content"]), ready.read.parquet(f"{SF}/person_names.parquet"))


# 3

PAGE = ["Home · Maps · Help · Shop", "The quiet lantern explained", "By the Reader desk | 3 March 2024 | 2 min read", "You should test the lantern in a quiet room, because the first result is rarely final.", "Read also: Another page", "- Save water", "Share | Print | Save", "You may also like", "The final loom explained", "Leave a comment", "tide7 says:", "We measured the lantern twice and the answer stayed reliable.", "© 2024 Reader. All rights reserved."]


def test_boilerplate(ready):
    rows = [("a", "\n".join(PAGE), "The quiet lantern explained"), ("a", "\n".join(PAGE), "The quiet lantern explained"), ("b", None, None), ("c", " \n ", None), ("d", "", None), ("e", "\n".join(PAGE[:1] + PAGE[7:]), None), ("f", "\n".join([PAGE[1]] + [PAGE[3]] * 5000), None), (None, "x", "y")]
    pages = ready.createDataFrame(rows, "id string, text string, title string").withColumn("line_no", F.lit(1))
    real = boilerplate.pages_of(ready.read.parquet(f"/root/testdata/sf0.01/corpus_pages.parquet"))
    m = boilerplate.fit(real)
    got = {}
    for r in boilerplate.boilerplate_lines(pages, m).distinct().collect():
        got.setdefault(r["id"], set()).add(r["line_no"])
    assert got["a"] == {0, 2, 4, 6, 7, 8, 9, 10, 11, 12}
    assert got["e"] == set(range(7)) and "f" not in got and not {"b", "c", "d"} & set(got)
    text = {r["id"]: r["text"] for r in boilerplate.main_content(pages, m).collect()}
    assert text["a"].split("\n") == [PAGE[1], PAGE[3], PAGE[5]]
    assert boilerplate.boilerplate_lines(pages.limit(0), boilerplate.fit(pages.limit(0))).count() == 0


def test_a_long_line_of_the_site_is_boilerplate(ready):
    long = "We use cookies and similar small files to remember your choices on this page. " * 6
    rnd = random.Random(3)
    say = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(n))
    rows = []
    for h, i in itertools.product("abcd", range(12)):
        title = say(4)
        rows.append((f"{h}{i}", "\n".join([f"Home · Maps {h}", title, *[say(15) + "." for _ in range(3)], long]), title, h))
    pages = ready.createDataFrame(rows, "id string, text string, title string, host string")
    got = {}
    for r in boilerplate.boilerplate_lines(pages, boilerplate.fit(pages)).collect():
        got.setdefault(r["id"], set()).add(r["line_no"])
    assert set(map(frozenset, got.values())) == {frozenset({0, 5})} and len(got) == 48


def test_trees_decide_on_hosts_held_out(ready):
    told = boilerplate.report(boilerplate.pages_of(ready.read.parquet("/root/testdata/sf0.01/corpus_pages.parquet")))
    assert told["lines"] > 1000 and 0 < told["differ"] < 0.03


def test_trees_learn_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((boilerplate.boost(x, y).predict(x) > 0.5) == y).mean() > 0.95


# 4


def test_conversations(ready):
    m = [
        (1, 1, "user", "hi", 10), (2, 1, "Assistant ", "yes", 20), (2, 1, "Assistant ", "yes", 20), (3, 1, "assistant", "yes", 25), (4, 1, "human", "​", 30),
        (5, 2, "assistant", "x", 1), (6, 2, "user", "y", 1), (7, 3, "userr", "y", 1), (8, None, "user", "z", 1), (9, 9, "user", "z", 1),
        (10, 4, "user", "q", 50), (11, 4, "assistant", "late", None), (12, 4, "user", "q2", 60), (13, 4, "bot", "a2", 70), (14, 5, "user", None, 1), (15, 6, "user", "a", 1), (16, 6, "system", "s", 2), (17, 6, "ai", "b", 3),
    ]
    df = ready.createDataFrame(m, "id bigint, conversation_id bigint, role string, content string, t bigint").withColumn("created_at", F.timestamp_seconds("t")).withColumn("ts", F.lit(1)).withColumn("conv", F.lit(2))
    conv = ready.createDataFrame([(i,) for i in range(1, 8)], "id bigint")
    got = {tuple(r) for r in rebuild.defects(df, conv).collect()}
    assert got == {(2, "broken"), (2, "no_reply"), (3, "broken"), (3, "empty"), (5, "empty"), (6, "broken"), (7, "empty"), (9, "orphan")}
    turns = [(r["conversation_id"], r["turn_no"], r["id"]) for r in rebuild.rebuild(df).where("conversation_id in (1, 4)").orderBy("conversation_id", "turn_no").collect()]
    assert turns == [(1, 0, 1), (1, 1, 2), (4, 0, 10), (4, 1, 11), (4, 2, 12), (4, 3, 13)]
    assert rebuild.defects(df.limit(0), conv.limit(0)).count() == 0
    assert rebuild.sessions(df).count() > 0


def test_sessions_keep_messages_without_a_time(ready):
    m = [(1, 1, "user", "a", 0), (2, 1, "assistant", "b", None), (3, 1, "user", "c", 30), (4, 1, "assistant", "d", 9000), (5, 2, "user", "e", None), (6, 2, "assistant", "f", None)]
    m += [(100 + i, 3, "user" if i % 2 == 0 else "assistant", str(i), 30 * i) for i in range(60)]
    df = ready.createDataFrame(m, "id bigint, conversation_id bigint, role string, content string, t bigint").withColumn("created_at", F.timestamp_seconds("t"))
    got = {(r["conversation_id"], r["session_no"]): (r["turns"], r["users"], r["assistants"], r["replied"], r["started"] is None) for r in rebuild.sessions(df, replied_only=False).collect()}
    assert got == {(1, 0): (3, 2, 1, True, False), (1, 1): (1, 0, 1, False, False), (2, 0): (2, 1, 1, True, True), (3, 0): (60, 30, 30, True, False)}
    assert {(r["conversation_id"], r["session_no"]) for r in rebuild.sessions(df).collect()} == {(1, 0), (2, 0), (3, 0)}


def test_a_hot_conversation_is_cut_into_ranges(ready):
    ready.conf.set("spark.sql.shuffle.partitions", "4")
    df = ready.range(4000).select("id", F.lit(1).cast("bigint").alias("conversation_id"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("content"), F.timestamp_seconds(F.col("id") * 60).alias("created_at"))
    conv = ready.createDataFrame([(1,)], "id bigint")
    assert rebuild.defects(df, conv).count() == 0
    assert {r["defect"] for r in rebuild.defects(df.where("id <> 2001"), conv).collect()} == {"no_reply"}
    assert rebuild._sorted(rebuild.counted(df), ["conv"]).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    turns = rebuild.rebuild(df, conv)
    assert turns.count() == 4000 and turns.where("turn_no <> id").count() == 0


def test_edges_between_batches_and_ranges(ready):
    rnd = random.Random(9)
    m = []
    for conv in range(1, 9):
        t = 0
        for k in range(rnd.randrange(1, 60)):
            t += rnd.randrange(11, 90)
            m.append((len(m) + 1, conv, rnd.choice(["user", "user", "assistant", "assistant", "system", "x"]) if conv < 3 else ("user", "assistant")[k % 2], f"m{k}", t if rnd.random() < 0.8 else None))
    df = ready.createDataFrame(m, "id bigint, conversation_id bigint, role string, content string, t bigint").withColumn("created_at", F.timestamp_seconds("t"))
    conv = ready.range(1, 9)
    want = {tuple(r) for r in rebuild.defects(df, conv).collect()}
    ready.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {tuple(r) for r in rebuild.defects(df, conv).collect()} == want
        assert rebuild.sessions(df, replied_only=False).agg(F.sum("turns")).first()[0] == len(m)
    finally:
        ready.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_roles_are_inferred(ready):
    m = [(1, 1, "user", "a?", 0, None), (2, 1, None, "b", 1, None), (3, 1, "assistnt", "c", 30, None), (4, 1, "Usr", "d", 60, None), (5, 1, "??", "e", 90, "7,8"), (6, 2, "bla", "what?", 0, None), (7, 2, "bla", "that", 20, None), (8, 3, "user", "q", 0, None), (9, 3, "zzz", "q", 20, None), (10, 3, "assistant", "r", 40, None)]
    df = ready.createDataFrame(m, "id bigint, conversation_id bigint, role string, content string, t bigint, used_memory_ids string").withColumn("created_at", F.timestamp_seconds("t"))
    rows = rebuild.range_chunks(rebuild.counted(df).join(rebuild._evidence(df), ["conv", "id", "h"], "left").drop("h"), ["conv"], rebuild.ORDER)
    got = {r["id"]: rebuild.ROLES[r["role"]] for r in rebuild.infer_roles(rows).collect()}
    assert got == {1: "user", 2: "assistant", 3: "assistant", 4: "user", 5: "assistant", 6: "user", 7: "other", 8: "user", 9: "other", 10: "assistant"}
    assert rebuild.sessions(df.limit(0)).count() == 0


# 5


def test_look_alikes():
    c = lookalike.canonical
    assert c("ｆｕｌｌ ﬁne​ é") == "full fine é" and c("раѕѕ") == "pass" and c("ﻻ") == "لا" and c("توفیر") == "توفير"
    assert c("أ") == "أ" and c("ё") == "ë"
    for a, b in (("a", "A"), ("2", "²"), ("2", "٢"), ("e", "é"), ("ا", "أ"), ("سلام", "سـلام"), ("a b", "a  b"), ("a b", "a\nb")):
        assert c(a) != c(b)
    for t in ("", EN, FR, AR, "ｘ́" * 5, "ạ̇"):
        assert c(c(t)) == c(t)


def test_more_shapes_look_the_same():
    c = lookalike.canonical
    assert c("ᎪᏴᏟ") == c("ꓮꓐꓚ") == "ABC" and c("Ммв") == c("Mᴍʙ") and c("a\u2011b") == c("a\u2010b")
    assert c("كُّ") == c("كُّ") and c("ё") == c("е\u0308") == c("ë")


def test_readable_keeps_sound_words():
    r = lookalike.readable
    for t in ("Москва", "Это сор и рис", "το νερό", "کتاب پدر", "", EN, FR, AR):
        assert r(t) == t
    assert r("раураl") == "paypal" and r("pаss сор") == "pass cop" and r("Моcква") == "Москва" and r("توفیر الكتاب") == "توفير الكتاب" and r("ｆｕｌｌ\u200b ﬁne") == "full fine"


def test_transducer_has_no_conflict():
    t = lookalike.transducer()
    assert len(t.one) > 2000 and len(t.clusters) > 1000
    assert all(t.cluster(x) == x for x in [*t.one.values(), *t.clusters.values()])


def test_look_alike_pairs_equal_brute_force(ready):
    rows = [("1", "pass"), ("2", "раss"), ("3", "pass"), ("4", "ｐass"), ("5", None), ("6", ""), ("7", "​"), ("1", "pass"), (None, "pass"), ("8", "other"), ("9", "x" * 100_000), ("10", "х" + "x" * 99_999)]
    df = ready.createDataFrame(rows, "id string, text string").withColumns({"form": F.lit("clash"), "raw": F.lit(1), "tbl": F.lit(2)})
    prints = lookalike.fingerprints(df, "t", "id", F.col("text"))
    got = {(r["id_a"], r["id_b"]) for r in lookalike.look_alike_pairs(prints).collect()}
    good = {(i, t) for i, t in rows if i and t and lookalike.canonical(t).strip()}
    want = {(a, b) for (a, s), (b, t) in itertools.product(good, good) if a < b and s != t and lookalike.canonical(s) == lookalike.canonical(t)}
    assert got == want and len(got) == 6
    classes = {(r["id"], r["class_id"], r["variants"], r["links"]) for r in lookalike.look_alike_classes(prints).collect()}
    assert classes == {("1", "1", 3, 2), ("3", "1", 3, 2), ("2", "1", 3, 3), ("4", "1", 3, 3), ("9", "10", 2, 1), ("10", "10", 2, 1)}
    empty = lookalike.fingerprints(df.limit(0), "t", "id", F.col("text"))
    assert lookalike.look_alike_pairs(empty).count() == 0 and lookalike.look_alike_classes(empty).count() == 0


# 6

PAIRS = [
    ("How do I save water?", None, {"empty"}), ("How do I save water?", " — ", {"empty"}), ("How do I save water?", "(no answer)", {"empty"}), ("", "x", set()), (None, "x", set()),
    ("How do I save water?", "Only in winter", set()), ("How do I save water?", "You can store the rain in a tank,", {"truncated"}), ("How do I save water?", "Run this:\n```python\nx = 1", {"truncated"}), ("How do I save water?", "Put the rain in (a tank", {"truncated"}),
    ("How do I save water?", "I'm sorry, but I can't help with that request.", {"refusal"}), ("How do I save water?", 'If asked, say "I can\'t help with that" and walk away. Store the rain in a large tank behind the house.', set()), ("How do I save water?", "I cannot give exact numbers, but a tank of rain is the best start for a garden.", set()),
    ("How do I save water?", "How do I save water", {"copied"}), ("How do I save water?", "Question: How do I save water?", {"copied"}), ("How do I save water in the garden?", FR, {"other_language"}), ("Please answer in French: how do I save water?", FR, set()), ("How do I save water in my garden?", EN + " " + FR, set()),
    ("ما الفرق بين الدليل والدفتر؟", "معلش، مش هقدر أساعدك في الموضوع ده.", {"refusal"}), ("How do I save water?", EN * 2000, set()),
]


def test_pair_defects(ready, model):
    rows = [(str(i), q, a) for i, (q, a, _) in enumerate(PAIRS)] + [("9", *PAIRS[9][:2])]
    df = ready.createDataFrame(rows, "id string, question string, answer string")
    texts = df.select(F.col("answer").alias("text"))
    got = {}
    for r in pairs.defects(df, texts, model).collect():
        got.setdefault(r["id"], []).append(r["defect"])
    for i, (q, a, want) in enumerate(PAIRS):
        assert sorted(got.get(str(i), [])) == sorted(want), (q, (a or "")[:60])
    assert pairs.defects(df.limit(0), texts.limit(0), model).count() == 0


def test_conversation_pairs(ready):
    c = [("system", "s"), ("human", "q"), ("Assistant", None), ("user", "r"), ("user", "q2"), ("assistant", "a2")]
    df = ready.createDataFrame([("a", "en", c, None, None, None), ("b", None, None, None, None, None), ("c", None, c[:1], None, None, None)], CONV)
    assert {(r["turn_no"], r["question"], r["answer"]) for r in pairs.conversation_pairs(df).collect()} == {(1, "q", None), (4, "q2", "a2")}


# 7


def test_cutoffs_equal_brute_force(ready):
    rnd = random.Random(2)
    rows = [(f"i{i}", rnd.choice([" A", "a", "b", "C", None]), rnd.choice([None, float("nan"), 1.5, -0.1, *[round(rnd.random(), 1) for _ in range(6)]])) for i in range(400)]
    df = ready.createDataFrame(rows + rows[:40], "id string, source string, quality_score double").withColumn("score", F.lit("clash"))
    targets = {"a": 0.35, "b": 0.5, "d": 0.9}
    t = ready.createDataFrame(list(targets.items()) + [("e", None)], "source string, target_fraction double")
    good = cutoff.countable(df)
    cuts = cutoff.cutoffs(good, t)
    kept = {(r["source"], r["id"]) for r in cutoff.keep(good, cuts).collect()}
    want = set()
    for s, f in targets.items():
        own = [(i, v) for i, x, v in set(rows) if x and x.strip().lower() == s and v is not None and v == v and 0 <= v <= 1]
        if own:
            c = min({v for _, v in own}, key=lambda v: (round(abs(sum(w >= v for _, w in own) - f * len(own)), 6), -v))
            want |= {(s, i) for i, v in own if v >= c}
    assert kept == want
    assert cutoff.cutoffs(cutoff.countable(df.limit(0)), t).count() == 0


# 8


def test_packing(ready):
    rnd = random.Random(4)
    sizes = {i: int(rnd.lognormvariate(4.5, 1.2)) for i in range(3000)} | {5000: 0, 5001: 10_000}
    df = ready.createDataFrame(list(sizes.items()) + [(None, 5), (7, sizes[7])], "doc_id bigint, tokens bigint").withColumn("capacity", F.lit("clash"))
    limits = ready.createDataFrame([(1, 256), (2, 1000), (3, None), (None, 5)], "limit_id int, capacity_tokens int")
    rows = packing.pack(df, limits).collect()
    for limit, cap in ((1, 256), (2, 1000)):
        own = [r for r in rows if r["limit_id"] == limit]
        fill, docs = {}, {}
        for r in own:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
            docs.setdefault(r["doc_id"], []).append(r["size"])
        assert max(fill.values()) <= cap
        assert {k: sum(v) for k, v in docs.items()} == sizes
        assert all(len(v) == 1 for k, v in docs.items() if sizes[k] <= cap)
        assert len(fill) <= 1.05 * sum(sizes.values()) / cap + 2
    assert packing.pack(df.limit(0), limits).count() == 0


def test_configurations_place_every_item():
    s, n = np.array([90, 60, 40, 35]), np.array([10, 17, 23, 5])
    plan = packing.solve(s, n, 100)
    assert (sum(r * m for r, m in plan) >= n).all() and all((r * s).sum() <= 100 for r, _ in plan)
    assert sum(m for _, m in plan) <= np.ceil((s * n).sum() / 100) + 6


def test_token_counts(ready):
    df = ready.createDataFrame([(1, "hello hello"), (2, None), (3, "")], "i int, text string")
    enc = tokens._encoding(open(tokens.VOCABULARY, "rb").read())
    assert enc.decode(enc.encode_ordinary(AR + EN)) == AR + EN
    assert [r["tokens"] for r in tokens.with_tokens(df).orderBy("i").collect()] == [len(enc.encode_ordinary("hello hello")), 0, 0]


# 9


def test_mixture(ready):
    rnd = random.Random(6)
    docs = [(i, rnd.choice([" A", "a", "b", "c", "x", None]), rnd.randrange(1, 50)) for i in range(3000)] + [(9001, "a", 0), (None, "a", 5)]
    df = ready.createDataFrame(docs + docs[:50], "doc_id bigint, source string, tokens bigint").withColumn("share", F.lit("clash"))
    t = ready.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", None, 1), ("gone", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixed, plan = mixture.mix(df, t)
    rows = mixed.collect()
    for s in mixture.shares(mixed, plan).collect():
        assert abs(s["actual_share"] - s["target_share"]) < 0.005 and s["most_repeats"] <= s["max_repeats"]
    assert all(0 <= r["position"] <= 1 for r in rows) and [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert len({(r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    assert mixture.mix(df.limit(0), t)[0].count() == 0


# 10


@pytest.mark.parametrize("text", ["Le café d'été à la plage", "“Don’t rush,” she says…", AR, "Schöne Grüße"])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman", "cp437", "cp1251", "cp1256"])
def test_garbled_text_is_found_and_restored(text, wrong):
    table = garbled._byte_table(wrong)
    bad = "".join(table[b] for b in text.encode())
    fixed, spans = garbled.repair("Sound before. " + bad + " Sound after.")
    assert spans
    if wrong in ("latin-1", "cp1252"):
        assert fixed == "Sound before. " + text + " Sound after."


def test_twice_garbled_and_escaped():
    once = "café".encode().decode("latin-1")
    assert garbled.repair(once.encode().decode("latin-1"))[0] == "café"
    assert garbled.repair("caf&#195;&#169; ok")[0] == "café ok"
    assert garbled.repair(AR.encode("cp1256").decode("cp1252"))[0] == AR
    assert garbled.repair("caf�")[1]


@pytest.mark.parametrize("wrong", ["cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "koi8-r"])
@pytest.mark.parametrize("true", ["cp1256", "iso8859-6"])
def test_arabic_bytes_read_under_any_encoding(true, wrong):
    table = garbled._byte_table(wrong)
    bad = "".join(table[b] for b in AR.encode(true))
    assert garbled.repair("Sound before. " + bad)[1]


@pytest.mark.parametrize("c", "😀→✅🚀ﻻﷲ")
@pytest.mark.parametrize("wrong", garbled.WRONG_FOR_UTF8)
def test_symbols_alone_are_found(c, wrong):
    if wrong == "cp850" and c in "→✅":
        pytest.skip("letters that Arabic bytes also show; found only beside others")
    table = garbled._byte_table(wrong)
    fixed, spans = garbled.repair("done " + "".join(table[b] for b in c.encode()) + " now")
    assert spans and (wrong not in ("latin-1", "cp1252") or fixed == f"done {c} now")


@pytest.mark.parametrize("text", ["Где находится библиотека? Сегодня мы будем читать.", "ГДЕ ЭТО", "Πού είναι η βιβλιοθήκη; ΣΗΜΕΡΑ", "┌──┬── a ══ b", "→ ✅ done 😀", "ﷲ ﻻ"])
def test_other_scripts_and_symbols_are_left_alone(text):
    assert garbled.repair(text) == (text, [])


@pytest.mark.parametrize("text", ["", EN, FR, AR, "It’s the café’s résumé — “for later”.", "SÃO, PÃO, CHÂTEAU, ÎLE", "signs Σ, Δ and √, £, ©, ® and °", "Ångström and Øresund", "« déjà » très chaud…", "الحفظ، والخط؟", "&eacute; &amp; x", "x " * 50_000])
def test_sound_text_is_left_alone(text):
    assert garbled.repair(text) == (text, [])


def test_restore_edges(ready):
    df = ready.createDataFrame([(1, None), (2, ""), (3, "cafÃ©"), (3, "cafÃ©"), (4, EN)], "doc_id bigint, text string").withColumn("restored", F.lit("clash"))
    rows = garbled.restore(df).collect()
    assert [r["garbled"] for r in rows] == [False, False, True, True, False] and rows[2]["restored"] == "café" and rows[0]["restored"] is None
    assert garbled.restore(df.limit(0)).count() == 0


def test_all_queries_are_there():
    names = list(queries.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= set(names) and set(queries.oracle_sql()) <= set(names)
    for n in range(1, 11):
        assert any(q.startswith(f"p{n}_") for q in names)


@pytest.mark.parametrize("times", [5, 8])
def test_text_garbled_many_times_is_restored(times):
    text = "café à côté"
    for _ in range(times):
        text = text.encode().decode("latin-1")
    assert garbled.repair(text)[0] == "café à côté"


def test_a_long_garbled_text_takes_linear_time():
    import time

    bad = "Où est l'été déjà passé ? ".encode().decode("latin-1") + AR.encode("cp1256").decode("cp1252") + " \n sound text in between. "
    began = time.time()
    fixed, spans = garbled.repair(bad * 5000)
    assert time.time() - began < 60 and len(spans) >= 10_000 and "Ã" not in fixed


@pytest.mark.parametrize("n", [1, 60, 400])
def test_refusals_and_stand_ins_of_any_length(n):
    assert pairs.is_refusal("I'm sorry, but I can't help with that request. " * n)
    assert not pairs.is_refusal("I'm sorry, but I can't help with that request. " * n + "Store the rain in a tank behind the house.")
    assert pairs.is_empty("(" * n + "no answer" + ")" * n)


def test_refusal_patterns_are_all_kept():
    for group, rx in ((pairs._REFUSE, pairs._LATIN_REFUSAL), (pairs._REFUSE_ARABIC, pairs._ARABIC_REFUSAL)):
        parts = [b for p in group for b in pairs._branches(p)]
        assert "|".join(pairs._branches("|".join(group))) == "|".join(group)
        assert len(rx.pattern) >= sum(len(b) - 2 for b in parts)


def test_answers_without_a_last_word_are_spread(ready, model):
    df = ready.range(300).select(F.col("id").cast("string").alias("id"), F.lit("How do I save water?").alias("question"), F.lit("Store the rain in a tank.").alias("answer"))
    assert pairs.defects(df, df.select(F.col("answer").alias("text")), model).count() == 0
