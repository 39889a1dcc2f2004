"""Queries over users, memories, conversations and instruction data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import align
from textmill.operators import conversation as C
from textmill.operators import retrieval as R
from textmill.operators.quality import HARMFUL
from textmill.plans import sqltext as S
from textmill.session import ship

GREETING = r"(?:^|[^\p{L}\p{N}_])(?:hi|hello|hey)(?:$|[^\p{L}\p{N}_])"
NOW = "2025-12-31 12:00:00"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _raw_examples(spark, sf):
    return _t(spark, sf, "instruction_examples").dropDuplicates(["id"])


def _examples(spark, sf):
    e = _raw_examples(spark, sf)
    return e.withColumn("conversation", C.clean_turns(F.col("conversation")))


def instruction_quality(spark, sf):
    return _examples(spark, sf).select("id", C.quality_score(F.col("conversation"), F.col("language")).alias("score"))


def conversation_fingerprints(spark, sf):
    return _raw_examples(spark, sf).where("size(conversation) > 0").select("id", C.fingerprint(F.col("conversation")).alias("fp"))


def conversation_exact_dedup(spark, sf):
    return C.keep_first(conversation_fingerprints(spark, sf), "fp", ["id"]).select("id", "fp")


def conversation_checks(spark, sf):
    c = F.col("conversation")
    return _examples(spark, sf).where("size(conversation) > 0").select("id", F.size(c).alias("turns"), C.is_valid(c).alias("valid"), C.last_assistant(c).alias("last_assistant"), F.size(C.history_tail(c, 3)).alias("tail"), C.detect_conversation_language(c).alias("detected"))


def conversation_format(spark, sf):
    return _examples(spark, sf).where("size(conversation) > 0").select("id", F.md5(C.format_turns(F.col("conversation"))).alias("formatted"))


def turn_usage(spark, sf):
    t = _examples(spark, sf).select("id", F.posexplode("conversation").alias("turn_no", "t"))
    return t.select("id", "turn_no", C.map_role(F.col("t.role")).alias("role"), F.greatest(F.lit(1), F.size(X.plain_words(F.coalesce(F.col("t.content"), F.lit(""))))).alias("usage"))


def source_counts(spark, sf):
    return _examples(spark, sf).groupBy(F.lower(F.trim("source")).alias("source"), "category").agg(F.count("*").alias("n"))


def memory_page(spark, sf):
    """One page, newest first, with the total; the limit is the feature."""
    return R.page(_t(spark, sf, "memory_items").distinct(), [F.col("updated_at").desc_nulls_last(), F.col("id").desc()], 20, 40).select("id", "user_id", "total")


def memory_like_search(spark, sf):
    return R.like_search(_t(spark, sf, "memory_items").distinct(), ["question", "answer", "tags_csv"], "LEDGER%water").select("id")


def memory_topk(spark, sf):
    """The five best memories of each user for a question; the limits are the feature."""
    return R.ranked_memories(_t(spark, sf, "memory_items").distinct(), "How can students save water with the ledger?", NOW, 300, 5)


def recency(spark, sf):
    return _t(spark, sf, "memory_items").distinct().where("updated_at is not null").select("id", R.recency_boost(F.col("updated_at"), NOW).alias("boost"))


def tags_roundtrip(spark, sf):
    m = _t(spark, sf, "memory_items").distinct()
    return m.select("id", R.tags_to_csv(F.split(F.coalesce("tags_csv", F.lit("")), ",")).alias("csv"))


def tag_counts(spark, sf):
    m = _t(spark, sf, "memory_items").distinct()
    return m.select(F.explode(R.csv_to_tags(F.col("tags_csv"))).alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def section_labels(spark, sf):
    c = _t(spark, sf, "conversations").distinct().where("updated_at is not null")
    return c.groupBy(R.section_label(F.col("updated_at"), NOW).alias("label")).agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"))


def message_join(spark, sf):
    c, m = _t(spark, sf, "conversations").distinct(), _t(spark, sf, "chat_messages").distinct()
    return c.join(m.select(F.col("id").alias("mid"), F.col("conversation_id").alias("cid")), F.col("id") == F.col("cid"), "left").groupBy("id").agg(F.count("mid").alias("messages"), F.max("mid").alias("last_message"))


def turn_ends(spark, sf):
    return C.turn_ends(_t(spark, sf, "chat_messages"))


def conversation_titles(spark, sf):
    """The first 40 characters of each conversation's first user message; partial aggregates only."""
    m = _t(spark, sf, "chat_messages").where("conversation_id is not null and created_at is not null and lower(trim(role)) in ('user', 'human')")
    first = m.groupBy("conversation_id").agg(F.min_by(F.struct("id", "content"), F.struct("created_at", "id")).alias("f"))
    return first.select("conversation_id", X.falsy_or(F.substring("f.content", 1, 40), F.lit("New Chat")).alias("title"))


def used_memories(spark, sf):
    m = _t(spark, sf, "chat_messages").where("used_memory_ids is not null").select("id", F.explode(F.split("used_memory_ids", ",")).alias("mid")).select("id", F.expr("try_cast(trim(mid) as bigint)").alias("memory_id")).where("memory_id is not null").distinct()
    known = _t(spark, sf, "memory_items").select(F.col("id").alias("memory_id")).distinct().withColumn("known", F.lit(1))
    return m.join(known, "memory_id", "left").groupBy("id").agg(F.count("*").alias("used"), F.count("known").alias("found"))


def cascade_delete(spark, sf):
    """What stays after deleting the inactive users with their conversations and messages."""
    gone = _t(spark, sf, "users").where("not is_active").select(F.col("id").alias("user_id"))
    c = _t(spark, sf, "conversations").distinct()
    stay = c.join(gone, "user_id", "left_anti")
    lost = c.join(gone, "user_id", "left_semi").select(F.col("id").alias("conversation_id"))
    m = _t(spark, sf, "chat_messages").distinct().join(lost, "conversation_id", "left_anti")
    items = _t(spark, sf, "memory_items").distinct().join(gone, "user_id", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")
    return one(stay, "conversations").unionByName(one(m, "chat_messages")).unionByName(one(items, "memory_items"))


def partial_update(spark, sf):
    """Updates with nulls for what stays; changed rows get the time of the update."""
    items = _t(spark, sf, "memory_items").distinct()
    changes = items.where("id % 10 = 3").select("id", F.lit(None).cast("string").alias("question"), F.concat(F.lit("checked: "), F.coalesce("answer", F.lit(""))).alias("answer"))
    return R.update(items, changes, "id", ["question", "answer"], NOW).select("id", "question", "answer", "updated_at")


def email_clashes(spark, sf):
    u = _t(spark, sf, "users").select(F.lower(F.trim("email")).alias("email"), "id")
    return u.groupBy("email").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1 or first > 0")


def newest_conversations(spark, sf):
    """The 50 newest conversations; the limit is the feature."""
    return _t(spark, sf, "conversations").distinct().orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(50).select("id", "user_id")


def request_violations(spark, sf):
    m = _t(spark, sf, "chat_messages").distinct()
    v = F.filter(F.array(
        F.when(~F.coalesce(F.lower(F.trim("role")).isin("user", "assistant", "system"), F.lit(False)), F.lit("role")),
        F.when(F.length(X.strip(F.coalesce("content", F.lit("")))) == 0, F.lit("blank")),
        F.when(F.length("content") > 4000, F.lit("long")),
    ), lambda x: x.isNotNull())
    return m.select(F.explode(v).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def greeting_flags(spark, sf):
    t = F.coalesce(F.col("content"), F.lit(""))
    g = F.lower(t).rlike(GREETING) | t.contains("مرحبا") | t.contains("اهلا") | t.contains("أهلا") | t.contains("سلام")
    return _t(spark, sf, "chat_messages").distinct().groupBy(g.alias("greeting"), t.rlike(X.ARABIC).alias("arabic")).agg(F.count("*").alias("n"))


def memory_prompt(spark, sf):
    """Known facts of each user's three newest memories as one block of text; the limit is the feature."""
    m = _t(spark, sf, "memory_items").distinct().where("user_id is not null and updated_at is not null")
    top = C.newest(m, "user_id", [F.col("updated_at").desc(), F.col("id")], 3)
    line = F.concat(F.lit("Q: "), F.coalesce("question", F.lit("")), F.lit("\nA: "), F.coalesce("answer", F.lit("")))
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("facts"))  # three rows


def helpfulness_scores(spark, sf):
    m = _t(spark, sf, "memory_items").distinct()
    h, s = align.helpfulness(F.col("answer")), align.harmlessness(F.col("question"), F.col("answer"))
    return m.select("id", h.alias("helpful"), align.helpfulness_label(h).alias("helpful_label"), s.alias("harmless"), align.harmlessness_label(s).alias("harmless_label"))


def _prompts(spark, sf):
    return _t(spark, sf, "memory_items").where("question is not null").select(F.col("question").alias("prompt")).distinct()


def critique_rows(spark, sf):
    return align.critique_rows(_prompts(spark, sf))


def preference_rows(spark, sf):
    return align.preference_rows(_prompts(spark, sf))


QUERIES = {f.__name__: f for f in (
    instruction_quality, conversation_fingerprints, conversation_exact_dedup, conversation_checks, conversation_format, turn_usage, source_counts, memory_page, memory_like_search, memory_topk, recency, tags_roundtrip, tag_counts,
    section_labels, message_join, turn_ends, conversation_titles, used_memories, cascade_delete, partial_update, email_clashes, newest_conversations, request_violations, greeting_flags, memory_prompt, helpfulness_scores, critique_rows, preference_rows,
)}

# Examples with contents in NFKC and white space collapsed.
_CLEAN = f"""WITH e0 AS (SELECT DISTINCT ON (id) * FROM instruction_examples),
t0 AS (SELECT id, i, conversation[i].role AS role, coalesce(conversation[i].content, '') AS content FROM (SELECT *, unnest(range(1, len(conversation) + 1)) AS i FROM e0)),
t1 AS ({S.nfkc_of('t0', 'id, i', 'content')}),
e1 AS (SELECT id, list({{'role': role, 'content': {S.collapse('nfkc')}}} ORDER BY i) AS turns FROM t1 GROUP BY id),
e AS (SELECT e0.* REPLACE (CASE WHEN len(e0.conversation) = 0 THEN [] ELSE turns END AS conversation) FROM e0 LEFT JOIN e1 USING (id))
"""
_E = "e"
_M = "(SELECT DISTINCT * FROM memory_items)"
_C = "coalesce(t.content, '')"
_CT = f"list_transform(conversation, lambda t: {_C})"
_DET = f"CASE WHEN regexp_matches(blob0, '{X.ARABIC}') THEN CASE WHEN {S.any_of('blob0', X.DIALECT)} THEN 'ar-dialect' ELSE 'ar' END ELSE 'en' END"
_ROLE = "CASE WHEN lower({0}) IN ('user', 'human') THEN 'human' WHEN lower({0}) = 'system' THEN 'system' WHEN lower({0}) = 'assistant' THEN 'assistant' END"
_R = _ROLE.format(S.strip("t.role"))
_HARM = lambda x: S.any_of(f"lower(coalesce({x}, ''))", HARMFUL)
_HELP = lambda r: f"((length({S.strip(f'''coalesce({r}, '')''')}) > 0)::INT + (len({S.plain_words(f'''coalesce({r}, '')''')}) >= 12)::INT + {S.any_of(f'''lower(coalesce({r}, ''))''', align.EXPLAINS)}::INT + {S.any_of(f'''lower(coalesce({r}, ''))''', align.UNSURE)}::INT)"
_SAFE = lambda p, r: f"greatest(0, 3 - {_HARM(p)}::INT - 2 * {_HARM(r)}::INT)"
_FIND = lambda p, r: f"CASE WHEN NOT {_HARM(r)} AND NOT ({_HARM(p)} AND NOT contains(lower({r}), 'can’t help') AND NOT contains(lower({r}), 'cannot help')) THEN [{S.lit(align.NO_VIOLATION)}] ELSE list_filter([CASE WHEN {_HARM(r)} THEN {S.lit(align.HARMFUL_RESPONSE)} END, CASE WHEN {_HARM(p)} AND NOT contains(lower({r}), 'can’t help') AND NOT contains(lower({r}), 'cannot help') THEN {S.lit(align.MISSING_REFUSAL)} END], lambda x: x IS NOT NULL) END"


def _revise(p: str, r: str, f: str) -> str:
    base = f"coalesce(nullif({S.strip(r)}, ''), {S.lit(align.EMPTY_ANSWER)})"
    base = f"CASE WHEN NOT contains(lower({base}), 'safe') AND NOT contains({base}, 'آمن') THEN {base} || {S.lit(align.OFFER)} ELSE {base} END"
    return f"CASE WHEN {_HARM(p)} THEN {S.lit(align.REFUSAL)} WHEN list_contains({f}, {S.lit(align.NO_VIOLATION)}) THEN {base} ELSE {S.lit(align.SAFE_PREFIX)} || {base} END"


_PRINCIPLES = "(VALUES " + ", ".join(f"({S.lit(a)}, {S.lit(b)}, {S.lit(c)}, {S.lit(d)})" for a, b, c, d in align.PRINCIPLES) + ") v(principle_id, category, english, arabic)"
_TAGS = "list_filter(list_transform(str_split(coalesce(tags_csv, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_NOW = f"TIMESTAMP '{NOW}'"
_REJ = f"CASE WHEN {_HARM('prompt')} THEN {S.lit(align.REJECTED[0])} ELSE {S.lit(align.REJECTED[1])} END"
_TOK = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06FF}}]+'))"
_QUERY = S.lit("How can students save water with the ledger?")

SQL = {
    "instruction_quality": f"""{_CLEAN}, a AS (SELECT id, language, conversation, array_to_string({_CT}, ' ') AS blob0 FROM {_E}),
b AS (SELECT *, {_DET} AS det, len(list_filter(conversation, lambda t: t.role IN ('system', 'user', 'assistant') AND length({_C}) > 0)) AS valid,
  list_filter(conversation, lambda t: coalesce(t.role = 'assistant', FALSE)) AS ans FROM a)
SELECT id, CASE WHEN coalesce(len(conversation), 0) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
  0.35::DOUBLE * (valid / len(conversation)) + CASE WHEN coalesce(language, '') = det THEN 0.25::DOUBLE ELSE 0.12::DOUBLE END
  + 0.25::DOUBLE * least((coalesce(list_sum(list_transform(ans, lambda t: length({_C}))), 0) / greatest(len(ans), 1)) / 180.0::DOUBLE, 1.0::DOUBLE)
  + greatest(0.15::DOUBLE - 0.05::DOUBLE * ({' + '.join(f"contains(lower(blob0), '{r}')::INT" for r in C.RISKY)}), 0.0::DOUBLE))) END AS score FROM b""",
    "conversation_fingerprints": f"{_CLEAN}SELECT id, sha256(array_to_string(list_transform(conversation, lambda t: coalesce(t.role, '') || '::' || lower({_C})), chr(10))) AS fp FROM {_E} WHERE len(conversation) > 0",
    "conversation_exact_dedup": f"{_CLEAN}SELECT min(id) AS id, fp FROM (SELECT id, sha256(array_to_string(list_transform(conversation, lambda t: coalesce(t.role, '') || '::' || lower({_C})), chr(10))) AS fp FROM {_E} WHERE len(conversation) > 0) GROUP BY fp",
    "conversation_checks": f"""{_CLEAN}, a AS (SELECT id, conversation, array_to_string({_CT}, ' ') AS blob0 FROM {_E} WHERE len(conversation) > 0)
SELECT id, len(conversation)::INT AS turns, len(list_filter(conversation[2:], lambda t: coalesce(t.role = 'system', FALSE))) = 0 AS valid,
  list_max(list_transform(range(len(conversation)), lambda i: CASE WHEN lower({S.strip('conversation[i + 1].role')}) = 'assistant' THEN i END))::INT AS last_assistant, least(len(conversation), 3)::INT AS tail, {_DET} AS detected FROM a""",
    "conversation_format": f"{_CLEAN}SELECT id, md5({S.lit(C.BOS)} || chr(10) || array_to_string(list_transform(list_filter(conversation, lambda t: {_R} IS NOT NULL), lambda t: upper({_R}) || chr(10) || {_C} || chr(10) || {S.lit(C.END_TURN)}), chr(10)) || chr(10) || {S.lit(C.EOS)}) AS formatted FROM {_E} WHERE len(conversation) > 0",
    "turn_usage": f"{_CLEAN}SELECT id, (i - 1)::INT AS turn_no, {_ROLE.format(S.strip('conversation[i].role'))} AS role, greatest(1, len({S.plain_words('''coalesce(conversation[i].content, '')''')}))::INT AS usage FROM (SELECT id, conversation, unnest(range(1, len(conversation) + 1)) AS i FROM {_E})",
    "source_counts": f"{_CLEAN}SELECT lower(trim(source)) AS source, category, count(*) AS n FROM {_E} GROUP BY 1, 2",
    "memory_page": f"SELECT id, user_id, (SELECT count(*) FROM {_M}) AS total FROM {_M} ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40",
    "memory_like_search": f"SELECT id FROM {_M} WHERE question ILIKE '%LEDGER%water%' OR answer ILIKE '%LEDGER%water%' OR tags_csv ILIKE '%LEDGER%water%'",
    "memory_topk": f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, id DESC) AS r,
  coalesce(question, '') || ' ' || coalesce(answer, '') || ' ' || coalesce(tags_csv, '') AS hay FROM {_M} WHERE user_id IS NOT NULL),
b AS (SELECT *, {_TOK.format('hay')} AS h, {_TOK.format(_QUERY)} AS q FROM a WHERE r <= 300),
c AS (SELECT user_id, id, updated_at, 0.75::DOUBLE * CASE WHEN len(h) = 0 OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(h, q)) / (len(h) + len(q) - len(list_intersect(h, q))) END
  + 0.15::DOUBLE * (contains(lower(hay), lower({_QUERY})))::INT + 0.10::DOUBLE * coalesce(exp(-greatest(0.0, (epoch_us({_NOW}) - epoch_us(updated_at)) / 86400e6) / 90.0), 0.0) AS score FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, updated_at DESC NULLS LAST, id DESC) AS place FROM c WHERE score > 0)
SELECT user_id, id, score, place::INT AS place FROM d WHERE place <= 5""",
    "recency": f"SELECT id, exp(-greatest(0.0, (epoch_us({_NOW}) - epoch_us(updated_at)) / 86400e6) / 90.0) AS boost FROM {_M} WHERE updated_at IS NOT NULL",
    "tags_roundtrip": f"SELECT id, coalesce(array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: list_position(list_transform(t, lambda z: lower(z)), lower(t[i])) = i), lambda i: t[i]), ','), '') AS csv FROM (SELECT id, {_TAGS} AS t FROM {_M})",
    "tag_counts": f"SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest({_TAGS}) AS tag FROM {_M}) GROUP BY 1",
    "section_labels": f"SELECT CASE date_diff('day', updated_at::DATE, {_NOW}::DATE) WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(updated_at, '%Y-%m-%d') END AS label, count(*) AS n, max(updated_at) AS newest FROM (SELECT DISTINCT * FROM conversations) WHERE updated_at IS NOT NULL GROUP BY 1",
    "message_join": "SELECT c.id, count(m.id) AS messages, max(m.id) AS last_message FROM (SELECT DISTINCT * FROM conversations) c LEFT JOIN (SELECT DISTINCT * FROM chat_messages) m ON m.conversation_id = c.id GROUP BY c.id",
    "turn_ends": "SELECT conversation_id, count(DISTINCT id) AS messages, arg_min(id, (created_at, id)) AS first_id, arg_max(id, (created_at, id)) AS last_id FROM chat_messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1",
    "conversation_titles": "SELECT conversation_id, coalesce(nullif(substr(content, 1, 40), ''), 'New Chat') AS title FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS r FROM chat_messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL AND lower(trim(role)) IN ('user', 'human')) WHERE r = 1",
    "used_memories": "WITH u AS (SELECT DISTINCT id, memory_id FROM (SELECT id, try_cast(trim(x) AS BIGINT) AS memory_id FROM (SELECT id, unnest(str_split(used_memory_ids, ',')) AS x FROM chat_messages)) WHERE memory_id IS NOT NULL) SELECT u.id, count(*) AS used, count(k.id) AS found FROM u LEFT JOIN (SELECT DISTINCT id FROM memory_items) k ON k.id = u.memory_id GROUP BY 1",
    "cascade_delete": """WITH gone AS (SELECT id FROM users WHERE NOT is_active), c AS (SELECT DISTINCT * FROM conversations), lost AS (SELECT id FROM c WHERE user_id IN (SELECT id FROM gone))
SELECT 'conversations' AS tbl, count(*) AS n FROM c WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'chat_messages', count(*) FROM (SELECT DISTINCT * FROM chat_messages) WHERE conversation_id IS NULL OR conversation_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'memory_items', count(*) FROM (SELECT DISTINCT * FROM memory_items) WHERE user_id IS NULL OR user_id NOT IN (SELECT id FROM gone)""",
    "partial_update": f"SELECT id, question, CASE WHEN id % 10 = 3 THEN 'checked: ' || coalesce(answer, '') ELSE answer END AS answer, CASE WHEN id % 10 = 3 THEN {_NOW} ELSE updated_at END AS updated_at FROM {_M}",
    "email_clashes": "SELECT lower(trim(email)) AS email, count(*) AS n, min(id) AS first FROM users GROUP BY 1 HAVING count(*) > 1 OR min(id) > 0",
    "newest_conversations": "SELECT id, user_id FROM (SELECT DISTINCT * FROM conversations) ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 50",
    "request_violations": f"WITH m AS (SELECT DISTINCT * FROM chat_messages) SELECT * FROM (SELECT 'role' AS violation, count(*) AS n FROM m WHERE NOT coalesce(lower(trim(role)) IN ('user', 'assistant', 'system'), FALSE) UNION ALL SELECT 'blank', count(*) FROM m WHERE length({S.strip('''coalesce(content, '')''')}) = 0 UNION ALL SELECT 'long', count(*) FROM m WHERE length(content) > 4000) WHERE n > 0",
    "greeting_flags": f"SELECT regexp_matches(lower(coalesce(content, '')), '{GREETING}') OR {S.any_of('''coalesce(content, '')''', ('مرحبا', 'اهلا', 'أهلا', 'سلام'))} AS greeting, regexp_matches(coalesce(content, ''), '{X.ARABIC}') AS arabic, count(*) AS n FROM (SELECT DISTINCT * FROM chat_messages) GROUP BY 1, 2",
    "memory_prompt": f"SELECT user_id, string_agg('Q: ' || coalesce(question, '') || chr(10) || 'A: ' || coalesce(answer, ''), chr(10) ORDER BY r) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS r FROM {_M} WHERE user_id IS NOT NULL AND updated_at IS NOT NULL) WHERE r <= 3 GROUP BY user_id",
    "helpfulness_scores": f"SELECT id, helpful, CASE WHEN helpful >= 3 THEN 'high' WHEN helpful = 2 THEN 'medium' ELSE 'low' END AS helpful_label, harmless, CASE WHEN harmless >= 2 THEN 'safe' WHEN harmless = 1 THEN 'borderline' ELSE 'unsafe' END AS harmless_label FROM (SELECT id, {_HELP('answer')} AS helpful, {_SAFE('question', 'answer')} AS harmless FROM {_M})",
    "critique_rows": f"""WITH p AS (SELECT DISTINCT question AS prompt FROM memory_items WHERE question IS NOT NULL),
c AS (SELECT *, {S.lit(align.CANDIDATE)} AS cand FROM p, {_PRINCIPLES}), f AS (SELECT *, {_FIND('prompt', 'cand')} AS found FROM c),
r AS (SELECT *, {_revise('prompt', 'cand', 'found')} AS response FROM f)
SELECT prompt, principle_id, response, 'Principle (' || principle_id || '):' || chr(10) || 'EN: ' || english || chr(10) || 'AR: ' || arabic || chr(10) || chr(10) || 'Prompt:' || chr(10) || prompt || chr(10) || chr(10) || 'Response under review:' || chr(10) || cand || chr(10) || chr(10) || 'Critique:' || chr(10) || '- ' || array_to_string(found, chr(10) || '- ') AS critique,
  CASE WHEN regexp_matches(prompt, '{X.ARABIC}') THEN 'ar' ELSE 'en' END AS language, {_HELP('response')} AS helpful, {_SAFE('prompt', 'response')} AS harmless FROM r""",
    "preference_rows": f"""WITH p AS (SELECT DISTINCT question AS prompt FROM memory_items WHERE question IS NOT NULL),
c AS (SELECT *, {_REJ} AS rejected, CASE WHEN {_HARM('prompt')} THEN {S.lit(align.CHOSEN[0])} ELSE {S.lit(align.CHOSEN[1])} END AS cand FROM p), f AS (SELECT *, {_FIND('prompt', 'rejected')} AS found FROM c),
r AS (SELECT *, {_revise('prompt', 'cand', 'found')} AS chosen FROM f)
SELECT prompt, rejected, chosen, CASE WHEN regexp_matches(prompt, '{X.ARABIC}') THEN 'ar' ELSE 'en' END AS language, {_HELP('chosen')} AS chosen_helpful, {_SAFE('prompt', 'chosen')} AS chosen_harmless, {_SAFE('prompt', 'rejected')} AS rejected_harmless FROM r""",
}
