"""Queries over tokenizer encodings, training samples, converters and record files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions import text as X
from textmill.operators import conversation as C
from textmill.operators import convert, retrieval, samples, sequence, tokenize
from textmill.operators.prefix import ranges_for
from textmill.plans import assistant, corpus
from textmill.plans import sqltext as S
from textmill.session import ensure_checkpoint_dir, ship
from textmill.sources import readers, sinks

SYSTEM = "You are a helper that keeps answers short and safe."
RUN = "20250101000000"
SEEDS = {"identity": ["من أنت؟", "Who are you?"], "culture": ["ما معنى هذا المثل؟"], "safety": ["كيف أحمي حسابي؟", "How do I stay safe?", "ما كلمة السر الجيدة؟"]}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark) -> str:
    """A folder of its own for files that a query writes and reads, where all executors reach it."""
    return f"{ensure_checkpoint_dir(spark)}/textmill-{uuid.uuid4().hex}"


# Tokenizer


def encode_decode(spark, sf):
    """Texts encoded with the ends' tokens and decoded without them."""
    d = _t(spark, sf, "documents").where("text is not null")
    ids = tokenize.encode(spark, F.col("text"), ends=True)
    return d.select("doc_id", F.md5(tokenize.decode(spark, ids, special=False)).alias("text"))


def encode_conversations(spark, sf):
    """Conversations written as turns, encoded with their special tokens and decoded."""
    e = assistant._examples(spark, sf).where("size(conversation) > 0")
    ids = tokenize.encode(spark, C.format_turns(F.col("conversation")), special=True)
    return e.select("id", F.md5(tokenize.decode(spark, ids)).alias("formatted"))


def encode_raw(spark, sf):
    """Arabic texts normalised as the tokenizer does, encoded without special tokens, and decoded."""
    d = _t(spark, sf, "documents").where("lang in ('ar', 'ar-dialect')")
    raw = X.tokenizer_arabic(X.normal_form(F.col("text"), "NFC"))
    return d.select("doc_id", F.md5(tokenize.decode(spark, tokenize.encode(spark, raw))).alias("text"))


def special_tokens(spark, sf):
    """The special tokens with their places behind the first."""
    t = tokenize.special_tokens(spark)
    return t.select("token", "place", (F.col("id") - F.min("id").over(_whole())).alias("behind"))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # seven rows


def fragmentation(spark, sf):
    """Tokens for each word of each document."""
    d = _t(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", tokenize.fragmentation(spark, F.col("text")).alias("ratio"))


# Samples


def _ids(text):
    """A number for each word; stands for a token's id where SQL has to follow."""
    return F.transform(X.lower_words(F.coalesce(text, F.lit(""))), lambda w: X.hash32(w))


def pretrain_samples(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", _ids(F.col("text")).alias("ids"))
    s = samples.packed_samples(d, ["doc_id"], "ids", 256)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return s.select("sample", F.size("input_ids").alias("n"), text("input_ids").alias("input_ids"), text("labels").alias("labels"), text("doc_uids").alias("doc_uids"))


def pretrain_encoded(spark, sf):
    """Packed samples of a public tokenizer's ids; the last part is dropped."""
    d = _t(spark, sf, "documents").where("text is not null")
    ids = d.select("doc_id", tokenize.encode(spark, F.col("text"), ends=True).alias("ids"))
    s = samples.packed_samples(ids, ["doc_id"], "ids", 512, drop_last=True)
    return s.select("sample", "input_ids", F.array_distinct("doc_uids").alias("docs"))


def _supervised(spark, sf):
    """Prompt and last answer as numbers of words, of examples with an answer."""
    e = assistant._examples(spark, sf).withColumn("k", C.last_assistant(F.col("conversation"))).where("k is not null")
    before = F.filter(F.slice("conversation", 1, F.col("k")), lambda t: C.map_role(t["role"]).isNotNull())
    prompt = F.flatten(F.transform(before, lambda t: F.concat(F.array(X.hash32(C.map_role(t["role"]))), _ids(t["content"]), F.array(X.hash32(F.lit(C.END_TURN))))))
    prompt = F.concat(F.array(X.hash32(F.lit(C.BOS))), prompt, F.array(X.hash32(F.lit("assistant"))))
    answer = F.concat(_ids(F.get("conversation", "k")["content"]), F.array(X.hash32(F.lit(C.END_TURN))))
    ids, labels = samples.supervised(prompt, answer, 128)
    return e.select("id", ids.alias("input_ids"), labels.alias("labels"))


def sft_samples(spark, sf):
    s = _supervised(spark, sf)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return s.select("id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != samples.IGNORED)).alias("trained"), text("input_ids").alias("input_ids"), text("labels").alias("labels"))


def collated_batches(spark, sf):
    """Batches of sixteen supervised samples, padded to their longest."""
    b = sequence.batches(_supervised(spark, sf), ["id"], 16)
    c = samples.collate(b, "batch", {"input_ids": 0, "labels": samples.IGNORED})
    text = lambda x: F.md5(F.array_join(F.transform(x, lambda v: v.cast("string")), ","))
    return c.select("id", F.col("batch").cast("bigint").alias("batch"), F.size("input_ids").alias("width"), text("input_ids").alias("input_ids"), text("labels").alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("seen"))


def shuffled_share(spark, sf):
    """A tenth of the documents in a drawn order; a sampling operator."""
    return samples.shuffle_take(_t(spark, sf, "documents").select("doc_id", "source"), "doc_id", 0.1, 42)


def first_examples(spark, sf):
    """The first 32 examples of an evaluation; the limit is the feature."""
    return samples.first_n(_t(spark, sf, "instruction_examples").dropDuplicates(["id"]).select("id", "source"), ["id"], 32)


def capped_download(spark, sf):
    """The first 500 records with text, by number; the cap is the feature and counts written rows only."""
    return samples.cap_written(_t(spark, sf, "documents").select("doc_id", "source", "text"), F.col("text") != "", ["doc_id"], 500).select("doc_id", "source")


def latest_checkpoint(spark, sf):
    d = _t(spark, sf, "documents")
    name = F.when(F.col("doc_id") % 7 == 0, F.lit("pretrain_best.pt")).when(F.col("doc_id") % 7 == 1, F.lit("pretrain_step_x.pt")).otherwise(F.concat(F.lit("pretrain_step_"), F.col("doc_id").cast("string"), F.lit(".pt")))
    return samples.latest_checkpoint(d.select(name.alias("name")), "name")


def identity_questions(spark, sf):
    return samples.identity_examples(spark, SEEDS, 500)


def synthetic_prompts(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return convert.synthetic(d, "Explain {topic} in {style}.", {"topic": ["water", "light", "code", "history", "maps"], "style": ["short", "simple", "formal"]}).select("id", "text")


# Converters


def _dolly(spark, sf):
    return _t(spark, sf, "memory_items").distinct().select("id", F.col("question").alias("instruction"), F.col("tags_csv").alias("context"), F.col("answer").alias("response"), F.when(F.col("id") % 3 == 0, "B").alias("category"))


def _shown(df):
    c = F.col("conversation")
    return df.select(F.col("id"), "source", "language", "category", F.md5(F.array_join(F.transform(c, lambda t: F.concat(t["role"], F.lit("|"), t["content"])), "\n")).alias("turns"))


def dolly_examples(spark, sf):
    out = convert.from_dolly(_dolly(spark, sf), SYSTEM, RUN)
    return _shown(out).drop("id")


def alpaca_examples(spark, sf):
    d = _t(spark, sf, "memory_items").distinct()
    rows = d.select(F.col("question").alias("instruction"), F.when(F.col("id") % 4 == 0, F.col("tags_csv")).alias("input"), F.concat(F.when(F.col("id") % 5 == 0, "الرد: ").when(F.col("id") % 5 == 1, " ### RESPONSE: ").otherwise(""), F.coalesce("answer", F.lit("")), F.when(F.col("id") % 3 == 0, "!!").otherwise("")).alias("output"))
    return _shown(convert.from_alpaca(rows, SYSTEM, RUN)).drop("id")


def message_trees(spark, sf):
    """Replies form trees over documents; every path from a root to a leaf is a conversation."""
    d = _t(spark, sf, "documents")
    m = d.select(F.col("doc_id").cast("string").alias("message_id"), F.when(F.col("doc_id") % 97 > 1, F.floor(F.col("doc_id") / 97).cast("bigint") * 97 + F.floor(F.col("doc_id") % 97 / 2)).cast("string").alias("parent_id"), F.col("title").alias("text"), F.when(F.col("doc_id") % 2 == 0, "Assistant").otherwise("prompter").alias("role"))
    out = convert.flatten_trees(m, SYSTEM)
    return out.select("leaf_id", F.size("conversation").alias("turns"), F.array_join(F.transform("conversation", lambda t: F.substring(t["role"], 1, 1)), "").alias("roles"))


# Files


RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])


def _jsonl(spark, sf) -> str:
    """Documents as JSON lines, with a line that is blank, broken or no object beside every tenth."""
    path = _folder(spark)
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    good = d.select(F.to_json(F.struct("id", "source", "text")).alias("value"))
    bad = d.where("id % 10 = 0").select(F.element_at(F.array(F.lit("  "), F.lit("{broken"), F.lit("[1, 2]"), F.lit("3")), (F.col("id") / 10 % 4 + 1).cast("int")).alias("value"))
    good.unionByName(bad).write.text(path)
    return path


def jsonl_tolerant(spark, sf):
    """JSON lines written and read again; what isn't an object is left out."""
    return readers.read_jsonl(spark, _jsonl(spark, sf), RECORD).select("id", "source", F.md5("text").alias("text"))


def jsonl_bad_lines(spark, sf):
    """How many lines a tolerant reader leaves out, by kind."""
    return readers.bad_lines(spark, _jsonl(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


def jsonl_by_source(spark, sf):
    """One folder of JSON lines for each source, read again with the number of written rows."""
    path = _folder(spark)
    d = _t(spark, sf, "documents").where("source is not null").select("doc_id", "source")
    n = sinks.write_counted(d, path, "source")
    return spark.read.json(path).groupBy("source").agg(F.count("*").alias("n")).withColumn("written", F.lit(n))


def numbered_lines(spark, sf):
    """Lines of record files with their number in (file, line) order, by which they can be looked up."""
    path = _folder(spark)
    lines = _t(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("value"))
    lines.repartitionByRange(ranges_for(spark), "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return readers.numbered_lines(spark, path)


def eval_texts(spark, sf):
    return readers.eval_text(_t(spark, sf, "corpus_pages").select("text")).groupBy(F.md5("text").alias("text")).agg(F.count("*").alias("n"))


def choice_items(spark, sf):
    m = _t(spark, sf, "memory_items").distinct().select(F.when(F.col("id") % 2 == 0, "").otherwise(F.col("question")).alias("ctx"), F.col("question").alias("context"), F.array("answer", "tags_csv").alias("choices"), F.when(F.col("id") % 3 == 0, "x").otherwise((F.col("id") % 2).cast("string")).alias("label"))
    return readers.choice_items(m).select(F.md5("ctx").alias("ctx"), F.size("endings").alias("endings"), "label")


def arabic_questions(spark, sf):
    m = _t(spark, sf, "memory_items").distinct().select("id", F.when(F.col("id") % 3 == 0, "Arabic").when(F.col("id") % 3 == 1, "english").alias("language"), F.col("tags_csv").alias("context"), "question", F.struct(F.array("answer").alias("text")).alias("answers"))
    m = m.withColumn("id", F.concat(F.when(F.col("id") % 2 == 0, "ar-").otherwise("en-"), F.col("id").cast("string")))
    return readers.qa_items(m).select(F.md5("question").alias("question"), F.size("answers").alias("answers"))


def parallel_texts(spark, sf):
    return readers.parallel_pairs(_t(spark, sf, "memory_items").distinct(), "question", "answer").select(F.md5("source_text").alias("source_text"), F.md5("target_text").alias("target_text"))


def normalized_records(spark, sf):
    """Records of another make in the corpus' form; ``text``, ``content`` or ``document`` holds the text."""
    d = _t(spark, sf, "documents")
    rows = d.select(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("r"), F.col("doc_id").cast("string"))).alias("id"), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("content"), "title", F.col("lang").alias("language"))
    return readers.normalize_record(rows, "wikipedia_ar").select("id", "source", "language", F.md5("text").alias("text"), "metadata.title")


def manifest_upsert(spark, sf):
    """A manifest with one entry replaced and one new."""
    c = readers.catalog(spark).select("name", "license")
    new = spark.createDataFrame([("c4_en", "CC0"), ("own_ar", "CC-BY")], "name string, license string")
    return retrieval.upsert(c, new, "name")


def config_merge(spark, sf):
    """Settings of a stage over shared ones, as a map."""
    d = _t(spark, sf, "documents").select("doc_id", F.create_map(F.lit("source"), F.coalesce("source", F.lit("?")), F.lit("kind"), F.lit("shared")).alias("a"), F.create_map(F.lit("kind"), F.lit("own"), F.lit("lang"), F.coalesce("lang", F.lit("?"))).alias("b"))
    m = retrieval.merged(F.col("a"), F.col("b"))
    return d.select("doc_id", m["source"].alias("source"), m["kind"].alias("kind"), m["lang"].alias("lang"))


QUERIES = {f.__name__: f for f in (
    encode_decode, encode_conversations, encode_raw, special_tokens, fragmentation, pretrain_samples, pretrain_encoded, sft_samples, collated_batches, shuffled_share, first_examples, capped_download, latest_checkpoint, identity_questions, synthetic_prompts,
    dolly_examples, alpaca_examples, message_trees, jsonl_tolerant, jsonl_bad_lines, jsonl_by_source, numbered_lines, eval_texts, choice_items, arabic_questions, parallel_texts, normalized_records, manifest_upsert, config_merge,
)}

_M = "(SELECT DISTINCT * FROM memory_items)"
_H = lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"
_HW = lambda x: f"list_transform({S.words(f'''lower(coalesce({x}, ''))''')}, lambda w: {_H('w')})"
_DET = lambda x: f"CASE WHEN regexp_matches({x}, '{X.ARABIC}') THEN CASE WHEN {S.any_of(x, X.DIALECT)} THEN 'ar-dialect' ELSE 'ar' END ELSE 'en' END"
_ROLE = assistant._ROLE
_TR = _ROLE.format(S.strip("t.role"))
_SFT = f"""{assistant._CLEAN}, a AS (SELECT id, conversation, list_max(list_transform(range(len(conversation)), lambda i: CASE WHEN lower({S.strip('conversation[i + 1].role')}) = 'assistant' THEN i END)) AS k FROM e),
b AS (SELECT id, list_concat(list_concat([{_H(S.lit(C.BOS))}], flatten(list_transform(list_filter(conversation[:k], lambda t: {_TR} IS NOT NULL), lambda t: list_concat(list_concat([{_H(_TR)}], {_HW('t.content')}), [{_H(S.lit(C.END_TURN))}])))), [{_H("'assistant'")}]) AS p,
  list_concat({_HW('conversation[k + 1].content')}, [{_H(S.lit(C.END_TURN))}]) AS a FROM a WHERE k IS NOT NULL),
s AS (SELECT id, list_concat(p, a)[-128:] AS ids, list_concat(list_transform(p, lambda x: -100::BIGINT), a)[-128:] AS labels FROM b)"""
_J = lambda x: f"md5(array_to_string({x}, ','))"


def _example_sql(rows: str, source: str) -> str:
    """Converted rows (ask, answer, category): the texts are normalised one by one."""
    return f"""WITH r0 AS (SELECT row_number() OVER () AS r, * FROM ({rows})), x0 AS (SELECT r, 1 AS i, ask AS content FROM r0 UNION ALL SELECT r, 2, answer FROM r0), x1 AS ({S.nfkc_of('x0', 'r, i', 'content')}),
y AS (SELECT r, max(CASE WHEN i = 1 THEN {S.collapse('nfkc')} END) AS ask, max(CASE WHEN i = 2 THEN {S.collapse('nfkc')} END) AS answer FROM x1 GROUP BY r),
z AS (SELECT category, {S.lit(SYSTEM)} || ' ' || y.ask || ' ' || y.answer AS blob, y.ask, y.answer FROM y JOIN r0 USING (r))
SELECT {S.lit(source)} AS source, {_DET('blob')} AS language, category, md5('system|' || {S.lit(SYSTEM)} || chr(10) || 'user|' || ask || chr(10) || 'assistant|' || answer) AS turns FROM z"""


_ALPACA = "regexp_replace(output, '(?i)^[\\t-\\r\\x20]*(?:### Response:|الإجابة:|الرد:)[\\t-\\r\\x20]*', '')"
for _c in "!؟?.،":
    _ALPACA = f"regexp_replace({_ALPACA}, '{'[' + _c + ']'}{{2,}}', '{_c}', 'g')"
_OUT = "CASE WHEN id % 5 = 0 THEN 'الرد: ' WHEN id % 5 = 1 THEN ' ### RESPONSE: ' ELSE '' END || coalesce(answer, '') || CASE WHEN id % 3 = 0 THEN '!!' ELSE '' END"
_SEEDS = "(VALUES " + ", ".join(f"({S.lit(c)}, [{', '.join(map(S.lit, p))}])" for c, p in SEEDS.items()) + ") s(category, prompts)"
_DIRTY = "SELECT doc_id // 10 % 4 AS k FROM documents WHERE doc_id % 10 = 0"

SQL = {
    "encode_decode": "SELECT doc_id, md5(text) AS text FROM documents WHERE text IS NOT NULL",
    "encode_conversations": assistant.SQL["conversation_format"],
    "encode_raw": "SELECT doc_id, md5(coalesce(normalized, '')) AS text FROM (" + corpus.SQL["tokenizer_normalize"] + ")",
    "special_tokens": "SELECT * FROM (VALUES " + ", ".join(f"({S.lit(t)}, {i}, {i})" for i, t in enumerate(tokenize.SPECIAL)) + ") v(token, place, behind)",
    "pretrain_samples": f"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS uid, {_HW('text')} AS ids FROM documents),
w AS (SELECT uid, unnest(ids) AS x, unnest(range(len(ids))) AS i FROM d WHERE len(ids) > 0), n AS (SELECT uid, x, row_number() OVER (ORDER BY uid, i) - 1 AS p FROM w),
s AS (SELECT p // 256 AS sample, count(*)::INT AS n, md5(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS ids, md5(string_agg(CAST(uid AS VARCHAR), ',' ORDER BY p)) AS uids FROM n GROUP BY 1)
SELECT sample, n, ids AS input_ids, ids AS labels, uids AS doc_uids FROM s""",
    "sft_samples": f"{_SFT} SELECT id, len(ids)::INT AS n, len(list_filter(labels, lambda x: x <> -100))::INT AS trained, {_J('ids')} AS input_ids, {_J('labels')} AS labels FROM s",
    "collated_batches": f"""{_SFT}, g AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM s), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM g)
SELECT id, batch::BIGINT AS batch, width::INT AS width, {_J('list_resize(ids, width, 0)')} AS input_ids, {_J('list_resize(labels, width, -100)')} AS labels, len(ids)::INT AS seen FROM w""",
    "shuffled_share": "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT (SELECT greatest(1, floor(count(*) * 0.1)::BIGINT) FROM documents)",
    "first_examples": "SELECT DISTINCT id, source FROM instruction_examples ORDER BY id LIMIT 32",
    "capped_download": "SELECT doc_id, source FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 500",
    "latest_checkpoint": "SELECT 'pretrain_step_' || max(doc_id) || '.pt' AS path, max(doc_id) AS step FROM documents WHERE doc_id % 7 > 1",
    "identity_questions": f"SELECT category, idx, prompts[idx % len(prompts) + 1] || ' ' || [{', '.join(map(S.lit, samples.STYLES))}][{_H("'42|' || category || '|' || idx")} % 4 + 1] AS \"user\" FROM range(500) r(idx), {_SEEDS}",
    "synthetic_prompts": "SELECT doc_id AS id, 'Explain ' || ['water', 'light', 'code', 'history', 'maps'][doc_id % 5 + 1] || ' in ' || ['short', 'simple', 'formal'][doc_id % 3 + 1] || '.' AS text FROM documents",
    "dolly_examples": _example_sql(f"SELECT CASE WHEN tags_csv <> '' THEN question || chr(10) || chr(10) || 'Context: ' || tags_csv ELSE question END AS ask, answer, CASE WHEN id % 3 = 0 THEN 'B' ELSE 'A' END AS category FROM {_M} WHERE question <> '' AND answer <> ''", "dolly"),
    "alpaca_examples": _example_sql(f"SELECT CASE WHEN id % 4 = 0 AND tags_csv <> '' THEN question || chr(10) || tags_csv ELSE question END AS ask, {_ALPACA} AS answer, 'C' AS category FROM (SELECT *, {_OUT} AS output FROM {_M}) WHERE question <> '' AND output <> ''", "arabic_alpaca"),
    "message_trees": f"""WITH RECURSIVE m AS (SELECT doc_id AS id, CASE WHEN doc_id % 97 > 1 THEN doc_id // 97 * 97 + doc_id % 97 // 2 END AS parent, {S.strip("coalesce(title, '')")} <> '' AS told, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'u' END AS c FROM documents),
p AS (SELECT id, CASE WHEN told THEN c ELSE '' END AS roles FROM m WHERE parent IS NULL UNION ALL SELECT m.id, p.roles || CASE WHEN told THEN c ELSE '' END FROM m JOIN p ON m.parent = p.id)
SELECT CAST(id AS VARCHAR) AS leaf_id, (length(roles) + 1)::INT AS turns, 's' || roles AS roles FROM p WHERE length(roles) >= 2 AND id NOT IN (SELECT parent FROM m WHERE parent IS NOT NULL)""",
    "jsonl_tolerant": "SELECT doc_id AS id, source, md5(text) AS text FROM documents",
    "jsonl_bad_lines": f"SELECT CASE k WHEN 1 THEN 'malformed' ELSE 'no object' END AS kind, count(*) AS n FROM ({_DIRTY}) WHERE k > 0 GROUP BY 1",
    "jsonl_by_source": "SELECT source, count(*) AS n, (SELECT count(*) FROM documents WHERE source IS NOT NULL) AS written FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "numbered_lines": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, CAST(doc_id AS VARCHAR) AS value FROM documents",
    "eval_texts": "SELECT md5(text) AS text, count(*) AS n FROM corpus_pages WHERE text <> '' GROUP BY 1",
    "choice_items": f"SELECT md5(CASE WHEN id % 2 = 0 OR question = '' THEN nullif(question, '') ELSE question END) AS ctx, 2 AS endings, CASE WHEN id % 3 <> 0 THEN (id % 2)::INT END AS label FROM {_M}",
    "arabic_questions": f"SELECT md5(question) AS question, 1 AS answers FROM {_M} WHERE id % 3 = 0 OR (id % 3 = 2 AND id % 2 = 0)",
    "parallel_texts": f"SELECT md5(question) AS source_text, md5(answer) AS target_text FROM {_M} WHERE question <> '' AND answer <> ''",
    "normalized_records": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'https://x.example/' || doc_id ELSE 'r' || doc_id END AS id, 'wikipedia_ar' AS source, coalesce(nullif(lang, ''), 'unknown') AS language, md5(text) AS text, title FROM documents WHERE text <> '' AND (doc_id % 2 = 0 OR doc_id % 3 <> 0)",
    "manifest_upsert": "SELECT * FROM (VALUES " + ", ".join(f"({S.lit(c[0])}, {S.lit(c[5])})" for c in readers.CATALOG if c[0] != "c4_en") + ", ('c4_en', 'CC0'), ('own_ar', 'CC-BY')) v(name, license)",
    "config_merge": "SELECT doc_id, coalesce(source, '?') AS source, 'own' AS kind, coalesce(lang, '?') AS lang FROM documents",
}
