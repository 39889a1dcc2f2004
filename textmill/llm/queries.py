"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from textmill.llm import boilerplate, cutoff, garbled, lang, lookalike, mixture, packing, pairs, personal, rebuild, tokens
from textmill.session import ship


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    examples = _t(spark, sf, "instruction_examples")
    return lang.label_turns(examples, lang.fit(_t(spark, sf, "lang_samples"), examples)).where("wrong").select("id", "turn_no", "lang").distinct()


def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of every example with its languages and their confidence."""
    examples = _t(spark, sf, "instruction_examples")
    return lang.label_turns(examples, lang.fit(_t(spark, sf, "lang_samples"), examples)).drop("wrong").groupBy("id", "turn_no", "lang").agg(F.max("confidence").alias("confidence"))


def p1_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches of one language of every turn, with their places and confidence."""
    examples = _t(spark, sf, "instruction_examples")
    return lang.label_segments(examples, lang.fit(_t(spark, sf, "lang_samples"), examples)).distinct()


def _personal_texts(spark: SparkSession, sf: str) -> DataFrame:
    messages = personal._texts(_t(spark, sf, "chat_messages"), "chat_messages", "id", ["content"])
    return messages.unionByName(personal._texts(_t(spark, sf, "memory_items"), "memory_items", "id", ["question", "answer"]))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal.numbered(personal.find(_personal_texts(spark, sf), _t(spark, sf, "person_names")))


def p2_masked(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that hold personal information, with placeholders."""
    texts = _personal_texts(spark, sf)
    return personal.mask(texts, personal.find(texts, _t(spark, sf, "person_names")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pages = boilerplate.pages_of(_t(spark, sf, "corpus_pages"))
    return boilerplate.boilerplate_lines(pages, boilerplate.fit(pages)).distinct()


def p3_main_content(spark: SparkSession, sf: str) -> DataFrame:
    pages = boilerplate.pages_of(_t(spark, sf, "corpus_pages"))
    return boilerplate.main_content(pages, boilerplate.fit(pages))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rebuild.defects(_t(spark, sf, "chat_messages"), _t(spark, sf, "conversations"))


def p4_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered turns of the conversations without a defect."""
    return rebuild.rebuild(_t(spark, sf, "chat_messages"), _t(spark, sf, "conversations"))


def p4_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rebuild.sessions(_t(spark, sf, "chat_messages"))


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    pages = lookalike.fingerprints(_t(spark, sf, "corpus_pages"), "corpus_pages", "id", F.col("text"))
    return pages.unionByName(lookalike.fingerprints(_t(spark, sf, "instruction_examples"), "instruction_examples", "id", lookalike.conversation_text()))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.look_alike_pairs(_prints(spark, sf))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that look like another one, with their class and the number of their look-alikes."""
    return lookalike.look_alike_classes(_prints(spark, sf))


def p5_unified_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "corpus_pages").select("id", lookalike.unify(F.col("text")).alias("text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    items, examples = _t(spark, sf, "memory_items"), _t(spark, sf, "instruction_examples")
    both = pairs.memory_pairs(items).unionByName(pairs.conversation_pairs(examples))
    texts = items.select(F.explode(F.array("question", "answer")).alias("text")).unionByName(examples.select(F.explode("conversation.content").alias("text")))
    return pairs.defects(both, texts, lang.fit(_t(spark, sf, "lang_samples"), examples))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = cutoff.countable(_t(spark, sf, "instruction_examples"))
    return cutoff.keep(rows, cutoff.cutoffs(rows, _t(spark, sf, "keep_targets"))).select("source", "id")


def p7_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return cutoff.cutoffs(cutoff.countable(_t(spark, sf, "instruction_examples")), _t(spark, sf, "keep_targets"))


def _sizes(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return tokens.with_tokens(_t(spark, sf, "documents").select(*columns, "text"))


def _wanted_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the documents whose source has a target; the texts of others aren't counted."""
    return tokens.with_tokens(mixture.wanted(_t(spark, sf, "documents").select("doc_id", "source", "text"), _t(spark, sf, "mix_targets")))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each document, or part of a document above the capacity, for each limit."""
    return packing.pack(_sizes(spark, sf, "doc_id"), _t(spark, sf, "pack_limits"))


def p8_fills(spark: SparkSession, sf: str) -> DataFrame:
    limits = _t(spark, sf, "pack_limits")
    return packing.fills(packing.pack(_sizes(spark, sf, "doc_id"), limits), limits)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen documents with their repeats, by position in the run."""
    return mixture.mix(_wanted_sizes(spark, sf), _t(spark, sf, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.shares(*mixture.mix(_wanted_sizes(spark, sf), _t(spark, sf, "mix_targets")))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """For each limit: documents placed, documents placed otherwise than whole or in full parts, overfull containers, and whether the containers are close to the least possible number."""
    limits = _t(spark, sf, "pack_limits")
    docs = tokens.with_tokens(_t(spark, sf, "documents").select("doc_id", "text"))
    return packing.invariants(packing.pack(docs, limits), docs, limits)


def p9_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """For each target: whether its share is met within half a hundredth and no document is repeated too often."""
    s = p9_shares(spark, sf)
    return s.select("source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.005).alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_met"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.restore(_t(spark, sf, "documents").select("doc_id", "text")).where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled.restore(_t(spark, sf, "documents").select("doc_id", "text")).where("garbled").select("doc_id", "restored", F.size("garbled_spans").alias("spans"))


_P7 = """
WITH r AS (
  SELECT DISTINCT lower(trim(e.source)) AS source, e.id, e.quality_score AS score, t.target_fraction AS f
  FROM instruction_examples e JOIN keep_targets t ON lower(trim(e.source)) = t.source
  WHERE e.quality_score IS NOT NULL AND NOT isnan(e.quality_score) AND e.quality_score BETWEEN 0 AND 1 AND e.id IS NOT NULL),
c AS (SELECT source, f, score, count(*) AS c FROM r GROUP BY ALL),
k AS (SELECT *, CAST(sum(c) OVER (PARTITION BY source ORDER BY score DESC) AS BIGINT) AS kept, CAST(sum(c) OVER (PARTITION BY source) AS BIGINT) AS n FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(abs(kept - f * n), 6), score DESC) AS p FROM k)
"""

_P4_STATES = r"""
WITH m0 AS (
  SELECT DISTINCT conversation_id AS conv, id, role, content, created_at AS ts FROM chat_messages WHERE conversation_id IS NOT NULL),
m1 AS (
  SELECT *, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'bot', 'ai') THEN 'assistant'
                 WHEN lower(trim(role)) = 'system' THEN 'system' ELSE 'other' END AS r,
         length(regexp_replace(coalesce(content, ''), '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g')) > 0 AS visible,
         last_value(CASE WHEN ts IS NOT NULL THEN {'ts': ts, 'id': id} END IGNORE NULLS) OVER (PARTITION BY conv ORDER BY id) AS a FROM m0),
m2 AS (
  SELECT *, coalesce(ts, a.ts, TIMESTAMP '1900-01-01') AS k_ts, CASE WHEN ts IS NOT NULL THEN id ELSE coalesce(a.id, -1) END AS k_id,
         CASE WHEN ts IS NULL THEN 1 ELSE 0 END AS late,
         lag(ts) OVER (PARTITION BY conv, lower(trim(coalesce(role, ''))), coalesce(content, ''), ts IS NULL ORDER BY ts, id) AS p_ts FROM m1),
m3 AS (SELECT * FROM m2 WHERE visible AND (ts IS NULL OR p_ts IS NULL OR ts - p_ts > INTERVAL 10 SECOND)),
m4 AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY k_ts, k_id, late, id) AS place FROM m3),
t AS (
  SELECT *, lag(r) OVER (PARTITION BY conv ORDER BY place) AS prev, lead(r) OVER (PARTITION BY conv ORDER BY place) AS nxt FROM m4 WHERE r IN ('user', 'assistant')),
s AS (
  SELECT conv, bool_or(r = 'other' OR (r = 'system' AND place > 1)) AS broken, count_if(r IN ('user', 'assistant')) AS talk FROM m4 GROUP BY conv),
u AS (
  SELECT conv, bool_or(r = 'assistant' AND coalesce(prev, 'assistant') = 'assistant') AS broken, bool_or(r = 'user' AND coalesce(nxt, 'user') = 'user') AS no_reply FROM t GROUP BY conv),
g AS (
  SELECT c.id AS conv, coalesce(s.talk, 0) AS talk, coalesce(s.broken, FALSE) OR coalesce(u.broken, FALSE) AS broken, coalesce(u.no_reply, FALSE) AS no_reply
  FROM (SELECT DISTINCT id FROM conversations WHERE id IS NOT NULL) c LEFT JOIN s ON s.conv = c.id LEFT JOIN u ON u.conv = c.id)
"""
_P4 = _P4_STATES + """
SELECT conv AS conversation_id, 'empty' AS defect FROM g WHERE talk = 0
UNION ALL SELECT conv, 'broken' FROM g WHERE broken
UNION ALL SELECT conv, 'no_reply' FROM g WHERE no_reply
UNION ALL SELECT DISTINCT conv, 'orphan' FROM m0 WHERE conv NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL)
"""
_P4_TURNS = _P4_STATES + """
SELECT conv AS conversation_id, CAST(place - 1 AS BIGINT) AS turn_no, id, r AS role, ts AS created_at, content FROM m4
WHERE conv IN (SELECT conv FROM g WHERE talk > 0 AND NOT broken AND NOT no_reply)
"""
_FLIP = "CASE WHEN {0} = 'user' THEN 'assistant' WHEN {0} = 'assistant' THEN 'user' END"
_P4_SESSIONS = _P4_STATES + f""",
ev AS (
  SELECT conversation_id AS conv, id, lower(trim(coalesce(role, ''))) AS rr, coalesce(content, '') AS cc, bool_or(coalesce(length(trim(used_memory_ids)), 0) > 0) AS uses FROM chat_messages GROUP BY ALL),
x AS (
  SELECT m4.*, ev.uses, ev.rr, regexp_matches(cc, '[?؟]\\s*$') AS asks,
         last_value(CASE WHEN r IN ('user', 'assistant') THEN r END IGNORE NULLS) OVER (PARTITION BY m4.conv ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
         first_value(CASE WHEN r IN ('user', 'assistant') THEN r END IGNORE NULLS) OVER (PARTITION BY m4.conv ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
         epoch_us(ts) - epoch_us(last_value(ts IGNORE NULLS) OVER (PARTITION BY m4.conv ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS gap
  FROM m4 JOIN ev ON ev.conv = m4.conv AND ev.id = m4.id AND rr = lower(trim(coalesce(role, ''))) AND cc = coalesce(content, '')),
y AS (
  SELECT conv, place, ts, gap, CASE WHEN r <> 'other' THEN r WHEN levenshtein(rr, 'user') <= 1 THEN 'user' WHEN levenshtein(rr, 'assistant') <= 3 THEN 'assistant' WHEN levenshtein(rr, 'system') <= 2 THEN 'system'
    WHEN uses THEN 'assistant' WHEN prev = nxt THEN {_FLIP.format('prev')} WHEN nxt IS NULL AND prev IS NOT NULL THEN {_FLIP.format('prev')} WHEN prev IS NULL AND nxt IS NOT NULL THEN {_FLIP.format('nxt')} WHEN asks THEN 'user' ELSE 'other' END AS role FROM x),
w AS (SELECT gap // 60000000 AS m, 1 << greatest(0, length(bin(gap // 60000000)) - 5) AS w FROM y WHERE gap IS NOT NULL),
h AS (SELECT (m // w) * w + w AS top, count(*) AS n FROM w GROUP BY 1),
q AS (SELECT top, sum(n) OVER (ORDER BY top) AS upto, sum(n) OVER () AS all_n FROM h),
lim AS (SELECT greatest(coalesce(min(top) * 60000000, 0), 60000000) AS limit_us FROM q WHERE upto >= 0.95 * all_n),
z AS (SELECT *, sum(coalesce(gap > limit_us, FALSE)::INT) OVER (PARTITION BY conv ORDER BY place) AS session_no FROM y, lim),
v AS (SELECT *, lag(role) OVER (PARTITION BY conv, session_no ORDER BY place) AS before FROM z WHERE role IN ('user', 'assistant')),
ok AS (SELECT DISTINCT conv, session_no FROM v WHERE role = 'assistant' AND before = 'user')
SELECT z.conv AS conversation_id, CAST(z.session_no AS BIGINT) AS session_no, count(*) AS turns, count_if(role = 'user') AS users, count_if(role = 'assistant') AS assistants, min(ts) AS started, max(ts) AS ended, TRUE AS replied
FROM z JOIN ok ON ok.conv = z.conv AND ok.session_no = z.session_no GROUP BY 1, 2
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4,
        "p4_turns": _P4_TURNS,
        "p4_sessions": _P4_SESSIONS,
        "p8_invariants": "SELECT limit_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS torn, 0::BIGINT AS overfull, TRUE AS close FROM pack_limits",
        "p9_bounds": "SELECT lower(trim(source)) AS source, TRUE AS share_met, TRUE AS repeats_met FROM mix_targets WHERE lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents)",
        "p7_found": _P7 + "SELECT DISTINCT r.source, r.id FROM r JOIN b ON r.source = b.source AND b.p = 1 WHERE r.score >= b.score",
        "p7_cutoffs": _P7 + "SELECT source, f AS target_fraction, n, score AS cutoff, kept, kept / n AS kept_share FROM b WHERE p = 1",
    }
