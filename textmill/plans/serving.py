"""Queries over requests, prompts and stored changes of the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions import text as X
from textmill.operators import align, serving
from textmill.operators import conversation as C
from textmill.operators import retrieval as R
from textmill.plans import sqltext as S
from textmill.session import ship
from textmill.sources import readers, sinks
from textmill.streaming import operators as stream

NOW = "2025-12-31 12:00:00"
SYSTEM = "You are a helper that keeps answers short and safe."
ASKED = "How can students save water?"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rows(spark, sf, name):
    return _t(spark, sf, name).distinct()


def openai_requests(spark, sf):
    """Chat messages as parts of requests with their limits; a third have none, a third a zero."""
    n, t = serving.request_limits(F.when(F.col("id") % 3 == 0, F.col("id") % 7 * 256), F.when(F.col("id") % 3 == 1, F.col("id") % 5 / 4.0))
    m = _rows(spark, sf, "chat_messages").withColumn("r", serving.chat_role(F.col("role"))).where("r is not null")
    return m.select("id", F.col("r").alias("role"), F.length(F.coalesce("content", F.lit(""))).alias("chars"), n.cast("bigint").alias("max_tokens"), t.alias("temperature"))


def anthropic_requests(spark, sf):
    return _rows(spark, sf, "chat_messages").select("id", serving.message_role(F.col("role")).alias("role"))


def response_usage(spark, sf):
    """Questions and answers as responses with their usage."""
    m = _rows(spark, sf, "memory_items")
    a, b = serving.usage(F.col("question")), serving.usage(F.col("answer"))
    return m.select("id", a.alias("input_tokens"), b.alias("output_tokens"), (a + b).alias("total_tokens"), F.lit("stop").alias("finish_reason"))


def last_user_message(spark, sf):
    e = _t(spark, sf, "instruction_examples").dropDuplicates(["id"])
    message, history = serving.last_user_turn(F.col("conversation"))
    return e.select("id", message.alias("message"), F.coalesce(F.size(history), F.lit(0)).alias("history"))


def rag_prompt(spark, sf):
    """The user's message of each prompt: a question and the facts of the user's three newest memories; the limit is the feature."""
    m = _rows(spark, sf, "memory_items").where("user_id is not null and updated_at is not null")
    top = C.newest(m, "user_id", [F.col("updated_at").desc(), F.col("id")], 3)
    line = serving.fact_lines(F.col("question"), F.col("answer"), R.csv_to_tags(F.col("tags_csv")))
    facts = top.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))  # three rows
    return facts.select("user_id", serving.with_facts(F.lit(ASKED), F.col("lines")).alias("content"))


def chat_prompts(spark, sf):
    """Prompts of a chat model: system, the last twenty turns and the question, one row for each message."""
    e = _t(spark, sf, "instruction_examples").dropDuplicates(["id"])
    p = serving.chat_prompt(SYSTEM, F.col("conversation"), F.lit(ASKED))
    return e.select("id", F.posexplode(p).alias("place", "m")).select("id", "place", "m.role", "m.content")


def local_prompts(spark, sf):
    e = _t(spark, sf, "instruction_examples").dropDuplicates(["id"])
    return e.select("id", F.md5(serving.local_prompt(SYSTEM, F.col("conversation"), F.lit(ASKED))).alias("prompt"))


def bilingual_principles(spark, sf):
    return align.principles(spark).select("principle_id", align.bilingual(F.col("english"), F.col("arabic")).alias("text"))


def principle_subsets(spark, sf):
    return align.subset(align.principles(spark), "harmlessness", "safety").select("principle_id", "category")


def principle_lookup(spark, sf):
    """The principle of each example's number; a missing one is an error."""
    wanted = _t(spark, sf, "instruction_examples").select("id", F.when(F.col("category") == "E", "no_illegal_harm").otherwise("helpful_honest_clear").alias("principle_id")).distinct()
    return align.lookup(wanted, align.principles(spark)).select("id", "principle_id", "category")


def constitutional_set(spark, sf):
    """Prompts times principles as instruction data of category E; rows without a prompt or response are dropped."""
    prompts = _t(spark, sf, "memory_items").where("question is not null").select(F.col("question").alias("prompt")).distinct()
    return align.constitutional_examples(prompts).select(F.md5("prompt").alias("prompt"), "principle_id", "category", F.size("conversation").alias("turns"), F.md5(F.col("conversation")[1]["content"]).alias("answer"))


def client_ids(spark, sf):
    u = _t(spark, sf, "users")
    auth = F.when(F.col("id") % 3 == 0, F.concat(F.when(F.col("id") % 2 == 0, "Bearer ").otherwise("bearer  "), F.col("username"))).otherwise(F.lit("Basic x"))
    key = F.when(F.col("id") % 3 == 1, F.col("username")).otherwise("")
    return u.select("id", serving.client_id(auth, key, F.when(F.col("id") % 2 == 0, F.concat(F.lit("10.0.0."), F.col("id").cast("string")))).alias("client"))


def time_formats(spark, sf):
    u = _t(spark, sf, "users").where("created_at is not null")
    return u.select("id", serving.utc_iso(F.col("created_at")).alias("iso"), serving.utc_compact(F.col("created_at")).alias("compact"), serving.token_expiry(F.col("created_at")).alias("expires"))


def map_without(spark, sf):
    """Checks of each example without the one that is kept elsewhere."""
    e = _t(spark, sf, "instruction_examples").dropDuplicates(["id"])
    rest = F.map_filter("constitutional_check", lambda k, v: ~k.isin("helpful", "safe"))
    return e.select("id", F.coalesce(F.array_join(F.array_sort(F.map_keys(rest)), ","), F.lit("")).alias("keys"))


def sse_roundtrip(spark, sf):
    """Each message as a stream of events, and the text that a client puts together from it."""
    m = _rows(spark, sf, "chat_messages").where("content is not null")
    event = sinks.sse(F.lit("chunk"), F.to_json(F.struct(F.lit("chunk").alias("type"), F.col("content").alias("text"))))
    told = sinks.parse_sse(F.concat(event, F.lit("event: done\ndata: [DONE]\n\n")))
    return m.select("id", F.array_join(F.transform(told, lambda j: F.get_json_object(j, "$.text")), "").alias("text"))


def joined_chunks(spark, sf):
    """Texts of messages put together again from chunks of 50 characters."""
    m = _rows(spark, sf, "chat_messages").where("content is not null and id is not null").groupBy("id").agg(F.min("content").alias("content"))
    at = F.expr("sequence(0, greatest(length(content) - 1, 0) div 50)")
    parts = m.select(F.col("id").alias("message_id"), F.explode(at).alias("seq"), "content").select("message_id", "seq", F.lit("chunk").alias("type"), F.expr("substring(content, seq * 50 + 1, 50)").alias("text"))
    return stream.join_chunks(parts)


def create_memories(spark, sf):
    """Answers of one user are taught anew, with keys behind the largest."""
    items = _rows(spark, sf, "memory_items")
    new = items.where("user_id = 1").select("user_id", "question", "answer", "tags_csv", "created_at", "updated_at", F.col("id").alias("old_id"))
    out = R.append_rows(items.withColumn("old_id", F.lit(None).cast("bigint")), new, "id", ["old_id"])
    return out.where("old_id is not null").select("id", "old_id")


def delete_memories(spark, sf):
    """Deleting by key and owner; wrong owners delete nothing."""
    items = _rows(spark, sf, "memory_items")
    wanted = items.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.col("user_id")).otherwise(F.lit(-1)).alias("user_id"))
    return serving.delete_owned(items, wanted, "id", "user_id").select("id")


def rename_conversations(spark, sf):
    c = _rows(spark, sf, "conversations")
    names = c.select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("  Talk "), F.col("id").cast("string"), F.lit(" "))).when(F.col("id") % 5 == 1, F.lit("  ")).otherwise(F.lit(None).cast("string")).alias("title"))
    return serving.rename(c, names, "id", "title", NOW).select("id", "title", "updated_at")


def append_pairs(spark, sf):
    """A question and its answer as two messages of a conversation."""
    m = _rows(spark, sf, "memory_items").where("user_id is not null").select("id", F.col("user_id").alias("conversation_id"), "question", "answer", F.col("id").cast("string").alias("used_memory_ids"))
    pairs = serving.message_pairs(m, F.col("used_memory_ids").cast("bigint") * 2, F.lit(NOW).cast("timestamp_ntz"))
    return pairs.select("id", "conversation_id", "role", "used_memory_ids")


def request_bounds(spark, sf):
    """Broken bounds of every kind of request that the tables can stand for."""
    m, i, u = _rows(spark, sf, "chat_messages"), _rows(spark, sf, "memory_items"), _t(spark, sf, "users")
    v = lambda df, **f: df.select(F.explode(serving.violations(**f)).alias("field"))
    out = v(m, role=F.col("role"), content=F.col("content"), message=F.col("content"))
    out = out.unionByName(v(i, question=F.col("question"), answer=F.col("answer"), tags=R.csv_to_tags(F.col("tags_csv")), limit=F.col("id") % 260, offset=F.col("id") % 7 - 1))
    return out.unionByName(v(u, email=F.col("email"), username=F.col("username"))).groupBy("field").agg(F.count("*").alias("n"))


def owned_memories(spark, sf):
    """Memories that are asked for by their owner; a third of the questions come from another user."""
    m = _rows(spark, sf, "memory_items")
    wanted = m.select("id", F.when(F.col("id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    return serving.owned(m, wanted, "id", "user_id").select("id", "user_id")


def register_users(spark, sf):
    """New accounts: a third take an address that is in use, a third a name that is too short."""
    u = _t(spark, sf, "users")
    new = u.select(F.when(F.col("id") % 3 == 0, F.col("email")).otherwise(F.concat(F.lit(" N"), F.col("id").cast("string"), F.lit("@New.example"))).alias("email"), F.when(F.col("id") % 3 == 1, "ab").otherwise(F.concat(F.lit("new"), F.col("id").cast("string"))).alias("username"))
    return serving.register(u, new, NOW).where(F.col("created_at") == F.lit(NOW).cast("timestamp_ntz")).select("id", "email", "username")


def catalog_join(spark, sf):
    """Pages by the catalog entry of their source: licence and estimated tokens."""
    c = readers.catalog(spark).select("name", F.col("source").alias("src"), "license", "estimated_tokens", "language")
    p = _t(spark, sf, "corpus_pages").select("id", "source", F.lower(F.trim("language")).alias("lang")).distinct()
    return p.join(F.broadcast(c), (p["source"] == c["src"]) & (p["lang"] == c["language"])).groupBy("name", "license", "estimated_tokens").agg(F.count("*").alias("pages"))  # six rows


QUERIES = {f.__name__: f for f in (
    openai_requests, anthropic_requests, response_usage, last_user_message, rag_prompt, chat_prompts, local_prompts, bilingual_principles, principle_subsets, principle_lookup, constitutional_set, client_ids, time_formats, map_without,
    sse_roundtrip, joined_chunks, create_memories, delete_memories, rename_conversations, append_pairs, request_bounds, owned_memories, register_users, catalog_join,
)}

_M = "(SELECT DISTINCT * FROM memory_items)"
_C = "(SELECT DISTINCT * FROM chat_messages)"
_E = "(SELECT DISTINCT ON (id) * FROM instruction_examples)"
_TAGS = "list_filter(list_transform(str_split(coalesce(tags_csv, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_NTAGS = f"CASE WHEN len({_TAGS}) > 0 THEN ' (tags: ' || array_to_string({_TAGS}, ', ') || ')' ELSE '' END"
_USE = lambda x: f"greatest(1, len({S.plain_words(f'''coalesce({x}, '')''')}))::INT"
_LC = S.collapse("coalesce(t.content, '')")
_LR = f"CASE WHEN lower({S.strip('t.role')}) IN ('user', 'human') THEN 'HUMAN' WHEN lower({S.strip('t.role')}) = 'system' THEN 'SYSTEM' WHEN lower({S.strip('t.role')}) = 'assistant' THEN 'ASSISTANT' END"
_PR = "(VALUES " + ", ".join(f"({S.lit(a)}, {S.lit(b)}, {S.lit(c)}, {S.lit(d)})" for a, b, c, d in align.PRINCIPLES) + ") v(principle_id, category, english, arabic)"
_CATALOG = "(VALUES " + ", ".join(f"({S.lit(c[0])}, {S.lit(c[1])}, {S.lit(c[4])}, {S.lit(c[5])}, {c[6]})" for c in readers.CATALOG) + ") c(name, src, language, license, estimated_tokens)"


def _critique_sql() -> str:
    from textmill.plans import assistant

    return assistant.SQL["critique_rows"]


SQL = {
    "openai_requests": f"SELECT id, role, length(coalesce(content, ''))::INT AS chars, (CASE WHEN id % 3 = 0 AND id % 7 <> 0 THEN id % 7 * 256 ELSE 1024 END)::BIGINT AS max_tokens, CASE WHEN id % 3 = 1 AND id % 5 <> 0 THEN id % 5 / 4.0::DOUBLE ELSE 1.0::DOUBLE END AS temperature FROM {_C} WHERE role IN ('system', 'user', 'assistant')",
    "anthropic_requests": f"SELECT id, CASE WHEN role IN ('assistant', 'user') THEN role ELSE 'system' END AS role FROM {_C}",
    "response_usage": f"SELECT id, {_USE('question')} AS input_tokens, {_USE('answer')} AS output_tokens, ({_USE('question')} + {_USE('answer')})::INT AS total_tokens, 'stop' AS finish_reason FROM {_M}",
    "last_user_message": f"SELECT id, conversation[k].content AS message, coalesce(k - 1, 0)::INT AS history FROM (SELECT id, conversation, list_max(list_filter(range(1, len(conversation) + 1), lambda i: conversation[i].role = 'user')) AS k FROM {_E})",
    "rag_prompt": f"SELECT user_id, {S.lit(ASKED)} || chr(10) || chr(10) || {S.lit(serving.FACTS)} || chr(10) || string_agg('Q: ' || coalesce(question, '') || {_NTAGS} || chr(10) || 'A: ' || coalesce(answer, ''), chr(10) ORDER BY r) AS content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS r FROM {_M} WHERE user_id IS NOT NULL AND updated_at IS NOT NULL) WHERE r <= 3 GROUP BY user_id",
    "chat_prompts": f"""WITH a AS (SELECT id, len(coalesce(conversation, [])) AS n, conversation FROM {_E})
SELECT id, 0 AS place, 'system' AS role, {S.lit(SYSTEM)} AS content FROM a
UNION ALL SELECT id, (i - greatest(n - 20, 0))::INT, conversation[i].role, conversation[i].content FROM (SELECT *, unnest(range(greatest(n - 20, 0) + 1, n + 1)) AS i FROM a)
UNION ALL SELECT id, (least(n, 20) + 1)::INT, 'user', {S.lit(ASKED)} FROM a""",
    "local_prompts": f"""SELECT id, md5(array_to_string(list_concat(list_concat([{S.lit(serving.BOS)}, 'SYSTEM' || chr(10) || {S.lit(SYSTEM)} || chr(10) || {S.lit(serving.END_TURN)}],
  list_transform(list_filter(coalesce(conversation, [])[-20:], lambda t: {_LR} IS NOT NULL AND length({_LC}) > 0), lambda t: {_LR} || chr(10) || {_LC} || chr(10) || {S.lit(serving.END_TURN)})),
  ['HUMAN' || chr(10) || {S.lit(ASKED)} || chr(10) || {S.lit(serving.END_TURN)}, {S.lit(serving.ASSISTANT)}]), chr(10))) AS prompt FROM {_E}""",
    "bilingual_principles": f"SELECT principle_id, english || ' / ' || arabic AS text FROM {_PR}",
    "principle_subsets": f"SELECT principle_id, category FROM {_PR} WHERE category IN ('harmlessness', 'safety')",
    "principle_lookup": f"SELECT DISTINCT e.id, v.principle_id, v.category FROM instruction_examples e JOIN {_PR} ON v.principle_id = CASE WHEN e.category = 'E' THEN 'no_illegal_harm' ELSE 'helpful_honest_clear' END",
    "constitutional_set": f"SELECT md5(prompt) AS prompt, principle_id, 'E' AS category, 2 AS turns, md5({S.collapse('nfc_normalize(response)')}) AS answer FROM ({_critique_sql()}) WHERE {S.strip('prompt')} <> '' AND response <> ''",
    "client_ids": "SELECT id, CASE WHEN id % 3 = 0 THEN 'token:' || username WHEN id % 3 = 1 THEN 'key:' || username WHEN id % 2 = 0 THEN 'ip:10.0.0.' || id ELSE 'ip:unknown' END AS client FROM users",
    "time_formats": "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(created_at, '%Y%m%d%H%M%S') AS compact, created_at + INTERVAL 7 DAY AS expires FROM users WHERE created_at IS NOT NULL",
    "map_without": f"SELECT id, coalesce(array_to_string(list_sort(list_filter(map_keys(constitutional_check), lambda k: k NOT IN ('helpful', 'safe'))), ','), '') AS keys FROM {_E}",
    "sse_roundtrip": f"SELECT id, content AS text FROM {_C} WHERE content IS NOT NULL",
    "joined_chunks": f"SELECT id AS message_id, min(content) AS text FROM {_C} WHERE content IS NOT NULL GROUP BY id",
    "create_memories": f"SELECT (SELECT max(id) FROM memory_items) + row_number() OVER (ORDER BY id) AS id, id AS old_id FROM {_M} WHERE user_id = 1",
    "delete_memories": f"SELECT id FROM {_M} WHERE id % 8 <> 0 OR user_id IS NULL",
    "rename_conversations": f"SELECT id, CASE WHEN id % 5 = 0 THEN 'Talk ' || id ELSE title END AS title, CASE WHEN id % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM (SELECT DISTINCT * FROM conversations)",
    "append_pairs": f"SELECT id * 2 + k AS id, user_id AS conversation_id, CASE WHEN k = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN k = 1 THEN CAST(id AS VARCHAR) END AS used_memory_ids FROM {_M}, range(2) r(k) WHERE user_id IS NOT NULL",
    "request_bounds": f"""WITH m AS {_C}, i AS {_M}, v AS (
  SELECT 'role' AS field FROM m WHERE NOT coalesce(role IN ('user', 'assistant'), FALSE)
  UNION ALL SELECT 'content' FROM m WHERE NOT coalesce(length(content) BETWEEN 1 AND 20000, FALSE) UNION ALL SELECT 'message' FROM m WHERE NOT coalesce(length(content) BETWEEN 1 AND 10000, FALSE)
  UNION ALL SELECT 'question' FROM i WHERE NOT coalesce(length(question) BETWEEN 1 AND 10000, FALSE) UNION ALL SELECT 'answer' FROM i WHERE NOT coalesce(length(answer) BETWEEN 1 AND 20000, FALSE)
  UNION ALL SELECT 'tags' FROM i WHERE len({_TAGS}) > 50 UNION ALL SELECT 'limit' FROM i WHERE NOT id % 260 BETWEEN 1 AND 200 UNION ALL SELECT 'offset' FROM i WHERE id % 7 = 0
  UNION ALL SELECT 'email' FROM users WHERE NOT coalesce(regexp_matches(email, '{serving.EMAIL}'), FALSE) UNION ALL SELECT 'username' FROM users WHERE NOT coalesce(length(username) BETWEEN 3 AND 50, FALSE))
SELECT field, count(*) AS n FROM v GROUP BY field""",
    "owned_memories": f"SELECT id, user_id FROM {_M} WHERE id % 3 <> 0 AND user_id IS NOT NULL",
    "register_users": "SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY 'n' || id || '@new.example') AS id, 'n' || id || '@new.example' AS email, 'new' || id AS username FROM users WHERE id % 3 = 2",
    "catalog_join": f"SELECT name, license, estimated_tokens, count(*) AS pages FROM (SELECT DISTINCT id, source, lower(trim(language)) AS lang FROM corpus_pages) JOIN {_CATALOG} ON source = src AND lang = language GROUP BY 1, 2, 3",
}
