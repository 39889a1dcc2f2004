"""Queries over corpus records: normalising, statistics, filters, sampling, packing and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import dedup, language, quality, sequence
from textmill.operators.conversation import clean_turns, keep_first
from textmill.plans import sqltext as S
from textmill.session import ship


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def corpus_normalize(spark, sf):
    d = _docs(spark, sf)
    return d.where("text is not null and text <> ''").select(X.falsy_or(F.col("doc_id").cast("string"), F.col("host")).alias("id"), "source", F.coalesce(X.falsy_or(F.col("lang")), F.lit("unknown")).alias("language"), "title", F.col("host").alias("url"), F.length("text").alias("chars"))


def corpus_clean(spark, sf):
    text = F.when(F.col("lang") == "ar", X.clean_arabic(X.normal_form(F.col("text"), "NFKC"))).otherwise(X.clean_markup(F.col("text")))
    return _docs(spark, sf).select("doc_id", text.alias("cleaned"))


def tokenizer_normalize(spark, sf):
    return _docs(spark, sf).where("lang in ('ar', 'ar-dialect')").select("doc_id", X.tokenizer_arabic(X.normal_form(F.col("text"), "NFC")).alias("normalized"))


def _stats(d, key):
    return d.groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count("*").alias("lines"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.sum(X.token_estimate(F.coalesce(F.col("text"), F.lit("")))).alias("tokens"))


def corpus_stats_by_language(spark, sf):
    return _stats(_docs(spark, sf), F.col("lang"))


def corpus_stats_by_source(spark, sf):
    return _stats(_docs(spark, sf), F.col("source"))


def quality_measures(spark, sf):
    m = quality.quality_measures(F.col("text"))
    return _docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in m.items()])


def quality_filter_counts(spark, sf):
    """The flagship: scan, five native quality tests, and counts read, kept and dropped for each language."""
    d = _docs(spark, sf).select(F.coalesce("lang", F.lit("unknown")).alias("lang"), quality.quality_filter(F.col("text")).alias("keep"))
    return d.groupBy("lang").agg(F.count("*").alias("read"), F.count_if("keep").alias("kept"), F.count_if(~F.coalesce("keep", F.lit(False))).alias("dropped"))


def _words(spark, sf):
    samples = spark.read.parquet(f"{sf}/lang_samples.parquet")
    return language.profile(samples, F.regexp_replace("lang", "-dialect$", ""))


def _expected(spark, sf):
    """Documents with the language they are expected to be in; only Arabic and English are tested."""
    d = _docs(spark, sf).select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"), "text")
    return language.with_probability(d, "text", F.when(F.col("lang").isin("ar", "en"), F.col("lang")), _words(spark, sf))


def language_agreement(spark, sf):
    """Whether each Arabic or English document is in its language with a probability of .8 at least."""
    return _expected(spark, sf).where("probability is not null").select("doc_id", "lang", (F.col("probability") >= 0.80).alias("agrees"))


def quality_filter_language(spark, sf):
    """The quality filter with the test of the expected language."""
    d = _expected(spark, sf).select("lang", quality.quality_filter(F.col("text"), probability=F.col("probability")).alias("keep"))
    return d.groupBy("lang").agg(F.count("*").alias("read"), F.count_if("keep").alias("kept"), F.count_if(~F.coalesce("keep", F.lit(False))).alias("dropped"))


def unusable_text(spark, sf):
    return _docs(spark, sf).select("doc_id", quality.looks_unusable(F.col("text")).alias("unusable"))


def content_flags(spark, sf):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, sf).select("doc_id", t.rlike(X.ARABIC).alias("arabic"), t.rlike(X.CODE_HINT).alias("code_hint"), quality.is_harmful(t).alias("harmful"), X.detect_language(t).alias("detected"))


def code_bucket(spark, sf):
    b = X.bucket_of(F.coalesce(F.col("text"), F.lit("")), F.col("lang"), F.col("source"))
    return _docs(spark, sf).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def min_length_filter(spark, sf):
    return _docs(spark, sf).where(F.length(X.strip(F.col("text"))) >= 20).groupBy("source").agg(F.count("*").alias("n"))


def exact_dedup_documents(spark, sf):
    d = _docs(spark, sf).where("text is not null").select("doc_id", F.sha2(F.lower(X.collapse(F.col("text"))), 256).alias("fp"))
    return keep_first(d, "fp", ["doc_id"])


def near_dup_classes(spark, sf):
    return dedup.near_duplicates(_docs(spark, sf), "doc_id", "text", 0.85, keep=False)


def near_dup_keep_first(spark, sf):
    return dedup.near_duplicates(_docs(spark, sf), "doc_id", "text", 0.85).select("id", "kept")


def minhash_classes(spark, sf):
    """Near-duplicates by MinHash bands; recall against the exact join is tested to be .9 at least."""
    return dedup.near_duplicates(_docs(spark, sf), "doc_id", "text", 0.85, minhash=True).select("id", "class_id", "links", "kept")


def _conversations(spark, sf):
    e = spark.read.parquet(f"{sf}/instruction_examples.parquet").where("size(conversation) > 0")
    return e.select("id", F.array_join(F.transform(clean_turns(F.col("conversation")), lambda t: t["content"]), " ").alias("text"))


def conversation_near_dedup(spark, sf):
    """Conversations of similar words (.9) whatever their roles; the first of each stays."""
    ship(spark)
    return dedup.near_duplicates(_conversations(spark, sf), "id", "text", 0.9, once=True).select("id", "class_id", "links", "kept")


def hash_sample(spark, sf):
    """Bernoulli sample of a tenth of each source, salted by the source; a sampling operator."""
    return _docs(spark, sf).where(X.hash32(F.concat("source", F.lit("|13|"), F.col("doc_id").cast("string"))) < int(0.1 * 2**32)).select("doc_id", "source")


def disjoint_workers(spark, sf):
    return _docs(spark, sf).groupBy(F.pmod(X.hash32(F.col("doc_id").cast("string")), F.lit(4)).alias("worker")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


RATIOS = {"arabic": 0.5, "english": 0.3, "code": 0.2}


def _buckets(spark, sf):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, sf).where(F.length(X.strip(t)) >= 20).select("doc_id", X.bucket_of(t, F.col("lang"), F.col("source")).alias("bucket"), F.octet_length(t).alias("bytes"))


def mixture_interleave(spark, sf):
    return sequence.interleave(_buckets(spark, sf), "bucket", ["doc_id"], RATIOS, 1_000).select("doc_id", "bucket", "slot")


def shard_assignment(spark, sf):
    return sequence.shards(_buckets(spark, sf), ["doc_id"], F.col("bytes")).select("doc_id", "before", "shard")


def sequence_packing(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.size(X.words(F.coalesce(F.col("text"), F.lit("")))).cast("bigint").alias("len"))
    return sequence.pack(d, ["doc_id"], "len", 256).select("doc_id", "sample", F.col("from").alias("begin"), F.col("to").alias("stop"))


def packed_samples(spark, sf):
    d = sequence_packing(spark, sf)
    return d.groupBy("sample").agg(F.count("*").alias("segments"), F.sum(F.col("stop") - F.col("begin")).alias("tokens"), F.min("doc_id").alias("first_doc"))


def batch_padding(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.size(X.words(F.coalesce(F.col("text"), F.lit("")))).alias("len"))
    b = sequence.batches(d, ["doc_id"], 16, drop_last=True)
    widest = b.groupBy("batch").agg(F.max("len").alias("width"), F.sum("len").alias("used"), F.count("*").alias("n"))
    return widest.select("batch", "width", (F.col("width") * F.col("n") - F.col("used")).alias("padding"))


def pretokenize_counts(spark, sf):
    pieces = X.all_matches(F.col("text"), r"[\p{L}\p{M}]+|\p{N}+|[\p{P}$_]|[^\p{L}\p{M}\p{N}\p{P}\s$_]+")
    return _docs(spark, sf).where("text is not null").select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def word_frequency(spark, sf):
    return _docs(spark, sf).where("text is not null").select(F.explode(X.lower_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    corpus_normalize, corpus_clean, tokenizer_normalize, corpus_stats_by_language, corpus_stats_by_source, quality_measures, quality_filter_counts, language_agreement, quality_filter_language, unusable_text, content_flags, code_bucket, min_length_filter,
    exact_dedup_documents, near_dup_classes, near_dup_keep_first, minhash_classes, conversation_near_dedup, hash_sample, disjoint_workers, mixture_interleave, shard_assignment, sequence_packing, packed_samples, batch_padding, pretokenize_counts, word_frequency,
)}

_T = "coalesce(text, '')"
_Q = f"""WITH a AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, {S.strip(_T)} AS t FROM documents),
b AS (SELECT *, {S.words('lower(t)')} AS w, regexp_extract_all(t, '(?s).') AS c FROM a),
m AS (SELECT doc_id, lang, CAST(length(t) AS INT) AS length,
  CASE WHEN length(t) > 0 THEN list_max(list_transform(list_distinct(c), lambda x: length(t) - length(replace(t, x, '')))) / length(t) ELSE 0.0 END AS top_char,
  CAST(len(w) AS INT) AS words, CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.0 END AS unique_words,
  CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[\\p{{L}}{X.WS_CLASS}]', '', 'g')) / length(t) ELSE 0.0 END AS symbols FROM b)"""
_U = f"""WITH a AS (SELECT doc_id, {S.collapse(_T)} AS t FROM documents),
b AS (SELECT doc_id, t, regexp_replace(t, '{X.WS}', '', 'g') AS s, {S.words('t')} AS w FROM a)
SELECT doc_id, (length(t) < 20 OR length(s) = 0
  OR CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) / length(s) ELSE 0 END < 0.35
  OR CASE WHEN length(s) > 0 THEN length(regexp_replace(s, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length(s) ELSE 0 END > 0.45
  OR len(w) < 4 OR (len(list_distinct(w)) / greatest(len(w), 1) < 0.45 AND len(w) >= 8)) AS unusable FROM b"""
_DIALECT = S.any_of(_T, X.DIALECT)
_BUCKET = f"""CASE WHEN lower(coalesce(lang, '')) LIKE 'ar%' THEN 'arabic'
  WHEN lower(coalesce(lang, '')) LIKE 'en%' THEN CASE WHEN regexp_matches({_T}, '{X.CODE_HINT}') OR regexp_matches(lower(coalesce(source, '')), 'code|github') THEN 'code' ELSE 'english' END
  WHEN regexp_matches({_T}, '{X.CODE_HINT}') OR regexp_matches(lower(coalesce(source, '')), 'code|program|github|stack') THEN 'code'
  WHEN regexp_matches({_T}, '{X.ARABIC}') THEN 'arabic' ELSE 'english' END"""
_CLEAN = "regexp_replace(translate(coalesce(text, ''), 'أإآٱ', 'اااا'), '[\\x{0640}\\x{0617}-\\x{061A}\\x{064B}-\\x{0652}\\x{0670}\\x{06D6}-\\x{06ED}]', '', 'g')"
_STAT = f"count(*) AS lines, CAST(sum(strlen({_T})) AS BIGINT) AS bytes, CAST(sum(len(regexp_extract_all({_T}, '{X.WORD}|[^\\p{{L}}\\p{{N}}_{X.WS_CLASS}]'))) AS BIGINT) AS tokens FROM documents"
_PACK = f"""WITH l AS (SELECT doc_id, len({S.words(_T)}) AS n FROM documents),
p AS (SELECT *, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM l),
e AS (SELECT *, unnest(range(b // 256, (b + n - 1) // 256 + 1)) AS sample FROM p WHERE n > 0),
s AS (SELECT doc_id, sample, greatest(sample * 256 - b, 0) AS begin, least((sample + 1) * 256 - b, n) AS stop FROM e)"""
_BUCKETS = f"SELECT doc_id, {_BUCKET} AS bucket, strlen({_T}) AS bytes FROM documents WHERE length({S.strip(_T)}) >= 20"

_PROFILE = f"""wl AS (SELECT regexp_replace(lang, '-dialect$', '') AS lang, unnest({S.words('lower(text)')}) AS word FROM lang_samples WHERE lang IS NOT NULL),
pf AS (SELECT lang, word, count(*) AS n FROM wl GROUP BY 1, 2), tt AS (SELECT lang, sum(n) + {language.SMOOTH}::DOUBLE * (SELECT count(DISTINCT word) FROM pf) AS total FROM pf GROUP BY 1),
dw AS (SELECT doc_id, unnest({S.words(f'lower({_T})')}) AS word FROM documents WHERE lang IN ('ar', 'en')), dn AS (SELECT doc_id, word, count(*) AS k FROM dw WHERE word IN (SELECT word FROM pf) GROUP BY 1, 2),
sc AS (SELECT doc_id, tt.lang, sum(k * ln((coalesce(pf.n, 0) + {language.SMOOTH}::DOUBLE) / total)) AS score FROM dn CROSS JOIN tt LEFT JOIN pf ON pf.lang = tt.lang AND pf.word = dn.word GROUP BY 1, 2),
pr AS (SELECT doc_id, lang, exp(score - max(score) OVER (PARTITION BY doc_id)) / sum(exp(score - mx)) OVER (PARTITION BY doc_id) AS p FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM sc)),
ag AS (SELECT d.doc_id, d.lang, coalesce(p, 0) >= 0.80 AS agrees FROM documents d LEFT JOIN pr ON pr.doc_id = d.doc_id AND pr.lang = d.lang WHERE d.lang IN ('ar', 'en'))"""


def _near(source: str, key: str, t: float, rounds: int) -> str:
    """Classes, links and what stays, for (id, text) of ``source``; the rounds of keep-first are unrolled."""
    sql = f"""a AS (SELECT {key} AS id, list_sort(list_distinct({S.words('lower(text)')})) AS w FROM {source}),
b AS (SELECT *, min(id) OVER (PARTITION BY w) AS class_id FROM a WHERE len(w) > 0), c AS (SELECT DISTINCT class_id, w, len(w) AS n FROM b),
f AS (SELECT w1, count(*) AS df FROM (SELECT unnest(w) AS w1 FROM c) GROUP BY 1),
r AS (SELECT class_id, n, w1, row_number() OVER (PARTITION BY class_id ORDER BY df, w1) AS k FROM (SELECT class_id, n, unnest(w) AS w1 FROM c) JOIN f USING (w1)),
h AS (SELECT class_id, n, w1 FROM r WHERE k <= n - ceil({t} * n - 1e-9) + 1),
q AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM h x JOIN h y ON x.w1 = y.w1 AND x.class_id < y.class_id AND x.n >= {t} * y.n - 1e-9 AND y.n >= {t} * x.n - 1e-9),
p AS (SELECT a, b FROM q JOIN c x ON x.class_id = a JOIN c y ON y.class_id = b WHERE {S.jaccard('x.w', 'y.w', 1.0)} >= {t}),
l AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p) GROUP BY 1),
k0 AS (SELECT class_id AS id, CAST(NULL AS BOOLEAN) AS stays FROM c)"""
    for i in range(1, rounds + 1):
        sql += f""",
s{i} AS (SELECT id, CASE WHEN stays IS NOT NULL THEN stays WHEN id NOT IN (SELECT p.b FROM p JOIN k{i - 1} z ON z.id = p.a WHERE coalesce(z.stays, TRUE)) THEN TRUE END AS stays FROM k{i - 1}),
k{i} AS (SELECT id, CASE WHEN stays IS NULL AND id IN (SELECT p.b FROM p JOIN s{i} z ON z.id = p.a WHERE z.stays) THEN FALSE ELSE stays END AS stays FROM s{i})"""
    return sql + f""",
out AS (SELECT b.id, b.class_id, coalesce(links, 0) AS links, coalesce(stays, error('undecided')) AND b.id = b.class_id AS kept FROM b LEFT JOIN l USING (class_id) JOIN k{rounds} z ON z.id = b.class_id)"""


SQL = {
    "corpus_normalize": "SELECT CAST(doc_id AS VARCHAR) AS id, source, coalesce(nullif(lang, ''), 'unknown') AS language, title, host AS url, CAST(length(text) AS INT) AS chars FROM documents WHERE text <> ''",
    "corpus_clean": f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents), a AS ({S.nfkc_of('d', 'doc_id', 'text')}),
m AS (SELECT doc_id, {S.collapse("regexp_replace(text, '<[^>]+>', ' ', 'g')")} AS text FROM d WHERE lang IS DISTINCT FROM 'ar'), u AS ({S.unescaped('m', 'doc_id', 'text')})
SELECT a.doc_id, CASE WHEN lang = 'ar' THEN {S.collapse(f'''regexp_replace({_CLEAN.replace("coalesce(text, '')", "nfkc")}, '([،؛؟!,:;.])', ' \\1 ', 'g')''')} ELSE {S.collapse('nfc_normalize(plain)')} END AS cleaned FROM a LEFT JOIN u USING (doc_id)""",
    "tokenizer_normalize": "SELECT doc_id, " + S.collapse("regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x{0610}-\\x{061A}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}]', '', 'g'), '\\x{0640}', '', 'g'), '([،؛؟٪٬٫۔])', ' \\1 ', 'g')") + " AS normalized FROM documents WHERE lang IN ('ar', 'ar-dialect')",
    "corpus_stats_by_language": f"SELECT coalesce(lang, 'unknown') AS key, {_STAT} GROUP BY 1",
    "corpus_stats_by_source": f"SELECT coalesce(source, 'unknown') AS key, {_STAT} GROUP BY 1",
    "quality_measures": _Q + " SELECT doc_id, length, top_char, words, unique_words, symbols FROM m",
    "quality_filter_counts": _Q + " SELECT lang, count(*) AS read, count_if(k) AS kept, count_if(NOT k) AS dropped FROM (SELECT lang, length >= 30 AND words >= 1 AND symbols <= 0.35 AND unique_words >= 0.25 AND top_char <= 0.3 AS k FROM m) GROUP BY lang",
    "unusable_text": _U,
    "content_flags": f"SELECT doc_id, regexp_matches({_T}, '{X.ARABIC}') AS arabic, regexp_matches({_T}, '{X.CODE_HINT}') AS code_hint, {S.any_of(f'lower({_T})', quality.HARMFUL)} AS harmful, CASE WHEN regexp_matches({_T}, '{X.ARABIC}') THEN CASE WHEN {_DIALECT} THEN 'ar-dialect' ELSE 'ar' END ELSE 'en' END AS detected FROM documents",
    "code_bucket": f"SELECT {_BUCKET} AS bucket, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "min_length_filter": f"SELECT source, count(*) AS n FROM documents WHERE length({S.strip('text')}) >= 20 GROUP BY source",
    "exact_dedup_documents": f"SELECT min(doc_id) AS doc_id, sha256(lower({S.collapse('text')})) AS fp FROM documents WHERE text IS NOT NULL GROUP BY 2",
    "near_dup_classes": f"""WITH a AS (SELECT doc_id AS id, list_sort(list_distinct({S.words(f'lower({_T})')})) AS w FROM documents),
b AS (SELECT *, min(id) OVER (PARTITION BY w) AS class_id FROM a WHERE len(w) > 0), c AS (SELECT DISTINCT class_id, w, len(w) AS n FROM b),
p AS (SELECT x.class_id AS a, y.class_id AS b FROM c x JOIN c y ON x.class_id < y.class_id AND x.n >= 0.85 * y.n AND y.n >= 0.85 * x.n WHERE {S.jaccard('x.w', 'y.w', 1.0)} >= 0.85),
l AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
SELECT id, class_id, coalesce(links, 0) AS links FROM b LEFT JOIN l USING (class_id)""",
    "near_dup_keep_first": f"WITH dt AS (SELECT doc_id, {_T} AS text FROM documents), {_near('dt', 'doc_id', 0.85, 8)} SELECT id, kept FROM out",
    "conversation_near_dedup": f"""WITH e0 AS (SELECT DISTINCT ON (id) * FROM instruction_examples WHERE len(conversation) > 0),
t0 AS (SELECT id, i, coalesce(conversation[i].content, '') AS content FROM (SELECT *, unnest(range(1, len(conversation) + 1)) AS i FROM e0)), t1 AS ({S.nfkc_of('t0', 'id, i', 'content')}),
ct AS (SELECT id, string_agg({S.collapse('nfkc')}, ' ' ORDER BY i) AS text FROM t1 GROUP BY id), {_near('ct', 'id', 0.9, 8)} SELECT id, class_id, links, kept FROM out""",
    "language_agreement": f"WITH {_PROFILE} SELECT * FROM ag",
    "quality_filter_language": _Q + f", {_PROFILE} SELECT lang, count(*) AS read, count_if(k) AS kept, count_if(NOT k) AS dropped FROM (SELECT m.lang, length >= 30 AND words >= 1 AND symbols <= 0.35 AND unique_words >= 0.25 AND top_char <= 0.3 AND coalesce(agrees, TRUE) AS k FROM m LEFT JOIN ag USING (doc_id)) GROUP BY lang",
    "hash_sample": "SELECT doc_id, source FROM documents WHERE CAST('0x' || substr(md5(source || '|13|' || doc_id), 1, 8) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)",
    "disjoint_workers": "SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS worker, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1",
    "mixture_interleave": f"""WITH RECURSIVE g AS (
  SELECT 0 AS step, 0 AS a, 0 AS e, 0 AS c, CAST(NULL AS VARCHAR) AS bucket
  UNION ALL
  SELECT step + 1, a + (pick = 'arabic')::INT, e + (pick = 'english')::INT, c + (pick = 'code')::INT, pick FROM (
    SELECT *, CASE WHEN la >= le AND la >= lc THEN 'arabic' WHEN le >= lc THEN 'english' ELSE 'code' END AS pick FROM (
      SELECT *, 0.5::DOUBLE - a::DOUBLE / greatest(step, 1) AS la, 0.3::DOUBLE - e::DOUBLE / greatest(step, 1) AS le, 0.2::DOUBLE - c::DOUBLE / greatest(step, 1) AS lc FROM g WHERE step < 1000))),
y AS (SELECT bucket, step - 1 AS step, row_number() OVER (PARTITION BY bucket ORDER BY step) - 1 AS nth, count(*) OVER (PARTITION BY bucket) AS each FROM g WHERE bucket IS NOT NULL),
d AS (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS k FROM ({_BUCKETS}))
SELECT doc_id, d.bucket, row_number() OVER (ORDER BY (k // each) * 1000 + step, doc_id) - 1 AS slot FROM d JOIN y ON d.bucket = y.bucket AND d.k % y.each = y.nth""",
    "shard_assignment": f"SELECT doc_id, before, CAST(before // 268435456 AS INT) AS shard FROM (SELECT doc_id, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM ({_BUCKETS})) WHERE before + bytes <= 10737418240",
    "sequence_packing": _PACK + " SELECT * FROM s",
    "packed_samples": _PACK + " SELECT sample, count(*) AS segments, CAST(sum(stop - begin) AS BIGINT) AS tokens, min(doc_id) AS first_doc FROM s GROUP BY sample",
    "batch_padding": f"WITH l AS (SELECT doc_id, len({S.words(_T)}) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents), g AS (SELECT batch, max(n) AS width, sum(n) AS used, count(*) AS k FROM l GROUP BY batch) SELECT batch, width, CAST(width * k - used AS BIGINT) AS padding FROM g WHERE k = 16",
    "pretokenize_counts": r"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}+|[\p{P}$_]|[^\p{L}\p{M}\p{N}\p{P}\s$_]+')) AS piece FROM documents) GROUP BY piece",
    "word_frequency": f"SELECT word, count(*) AS n FROM (SELECT unnest({S.words('lower(text)')}) AS word FROM documents) GROUP BY word",
}
