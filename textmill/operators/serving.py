"""Requests and responses of an assistant: mapping, prompts, clients, times and stored changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import text as X

# Heading of remembered facts, defaults of a request, life of a token.
FACTS = "[Known facts from stored memory]"
MAX_TOKENS, TEMPERATURE = 1024, 1.0
TOKEN_DAYS = 7
HISTORY = 20
BOS, END_TURN = "<|begin_of_text|>", "<|end_turn|>"
ASSISTANT = "<|assistant|>"


# Bounds of requests, as (least, most) characters or items.
BOUNDS = {"message": (1, 10_000), "content": (1, 20_000), "history": (0, 50), "question": (1, 10_000), "answer": (1, 20_000), "tags": (0, 50), "query": (0, 500), "username": (3, 50), "password": (8, 100)}
LIMIT = (1, 200)
EMAIL = r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$"


def violations(**fields: Column) -> Column:
    """The names of the fields that break a bound, as an array; a null field is missing where at least one is asked for.

    Strings are measured in characters and arrays in items. ``role``, ``email``, ``limit``
    and ``offset`` have their own rules.
    """
    found = []
    for name, c in fields.items():
        kind = name.split("__")[0]
        if kind == "role":
            bad = ~F.coalesce(c.isin("user", "assistant"), F.lit(False))
        elif kind == "email":
            bad = ~F.coalesce(c.rlike(EMAIL), F.lit(False))
        elif kind == "limit":
            bad = ~F.coalesce(c.between(*LIMIT), F.lit(True))
        elif kind == "offset":
            bad = F.coalesce(c < 0, F.lit(False))
        else:
            least, most = BOUNDS[kind]
            size = F.size(c) if kind in ("history", "tags") else F.length(c)
            bad = ~F.coalesce(size.between(least, most), F.lit(least == 0))
        found.append(F.when(bad, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def owned(rows: DataFrame, wanted: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows that ``wanted`` (key, owner) asks for and whose owner they are."""
    return rows.join(wanted.select(key, owner).distinct(), [key, owner], "left_semi")


def register(users: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Users with those of ``new`` (email, username) whose e-mail address and name are valid and free; the first of equals wins."""
    from textmill.operators.retrieval import append_rows

    low = lambda c: F.lower(F.trim(c))
    fine = new.where(F.size(violations(email=F.trim("email"), username=F.col("username"))) == 0).select(low("email").alias("email"), "username")
    fine = fine.groupBy("email").agg(F.min("username").alias("username")).groupBy("username").agg(F.min("email").alias("email"))
    fine = fine.join(users.select(low("email").alias("email")).distinct(), "email", "left_anti").join(users.select("username").distinct(), "username", "left_anti")
    kind = users.schema["created_at"].dataType
    rows = fine.withColumns({"is_active": F.lit(True), "created_at": F.lit(now).cast(kind), "updated_at": F.lit(now).cast(kind)})
    return append_rows(users, rows, "id", ["email"])


def chat_role(role: Column) -> Column:
    """The role of a message that a chat request may hold, else null; roles are taken as they are."""
    return F.when(role.isin("system", "user", "assistant"), role)


def message_role(role: Column) -> Column:
    """assistant and user as they are, any other (or none) as system."""
    return F.when(F.coalesce(role.isin("assistant", "user"), F.lit(False)), role).otherwise("system")


def request_limits(max_tokens: Column, temperature: Column) -> tuple[Column, Column]:
    """Null or zero stand for the defaults, so that a temperature of 0 becomes 1."""
    return F.when(max_tokens != 0, max_tokens).otherwise(F.coalesce(F.lit(MAX_TOKENS))), F.when(temperature != 0, temperature).otherwise(F.lit(TEMPERATURE))


def usage(text: Column) -> Column:
    """Words between white space, one at least."""
    return F.greatest(F.lit(1), F.size(X.plain_words(F.coalesce(text, F.lit("")))))


def last_user_turn(conv: Column) -> tuple[Column, Column]:
    """The last user message and the turns before it; null and no turns without one."""
    at = F.array_max(F.transform(conv, lambda t, i: F.when(F.coalesce(t["role"] == "user", F.lit(False)), i)))
    return F.get(conv, at)["content"], F.when(at.isNotNull(), F.slice(conv, 1, F.greatest(at, F.lit(0))))


def fact_lines(question: Column, answer: Column, tags: Column) -> Column:
    """Two lines for a remembered item: the question with its tags, and the answer."""
    note = F.when(F.size(tags) > 0, F.concat(F.lit(" (tags: "), F.array_join(tags, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("Q: "), F.coalesce(question, F.lit("")), note, F.lit("\nA: "), F.coalesce(answer, F.lit("")))


def with_facts(message: Column, lines: Column) -> Column:
    """The message and, if there are any, the known facts below it."""
    return F.when(F.size(lines) > 0, F.concat(message, F.lit("\n\n" + FACTS + "\n"), F.array_join(lines, "\n"))).otherwise(message)


def chat_prompt(system: str, history: Column, message: Column) -> Column:
    """Messages (role, content): the system's, the last ``HISTORY`` of the history, and the user's."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    turns = F.transform(F.coalesce(history, F.expr("cast(array() as array<struct<role:string,content:string>>)")), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    tail = F.when(F.size(turns) > HISTORY, F.slice(turns, -HISTORY, HISTORY)).otherwise(turns)
    return F.concat(one("system", F.lit(system)), tail, one("user", message))


def local_prompt(system: str, history: Column, message: Column) -> Column:
    """One text of turns for a local model; turns of unknown role or without content are passed over."""
    from textmill.operators.conversation import map_role

    turn = lambda role, c: F.concat(F.upper(role), F.lit("\n"), c, F.lit("\n" + END_TURN))
    turns = F.coalesce(history, F.expr("cast(array() as array<struct<role:string,content:string>>)"))
    tail = F.when(F.size(turns) > HISTORY, F.slice(turns, -HISTORY, HISTORY)).otherwise(turns)
    content = lambda t: X.collapse(F.coalesce(t["content"], F.lit("")))
    told = F.filter(tail, lambda t: map_role(t["role"]).isNotNull() & (F.length(content(t)) > 0))
    lines = F.transform(told, lambda t: turn(map_role(t["role"]), content(t)))
    return F.array_join(F.concat(F.array(F.lit(BOS), turn(F.lit("system"), F.lit(system))), lines, F.array(turn(F.lit("human"), message), F.lit(ASSISTANT))), "\n")


def client_id(authorization: Column, api_key: Column, ip: Column) -> Column:
    """token, key or ip, whichever a request has first."""
    token = F.when(F.lower(authorization).startswith("bearer "), F.concat(F.lit("token:"), F.trim(F.substring(authorization, 8, 2**30))))
    return F.coalesce(token, F.when(api_key != "", F.concat(F.lit("key:"), api_key)), F.concat(F.lit("ip:"), F.coalesce(ip, F.lit("unknown"))))


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_compact(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def token_expiry(ts: Column) -> Column:
    return ts + F.expr(f"interval {TOKEN_DAYS} days")


def delete_owned(rows: DataFrame, wanted: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows without those of ``wanted`` (key, owner); a row of another owner stays."""
    return rows.join(wanted.select(key, owner).distinct(), [key, owner], "left_anti")


def rename(rows: DataFrame, names: DataFrame, key: str, column: str, now: str) -> DataFrame:
    """New names (key, column), trimmed; a blank one changes nothing. Renamed rows get ``updated_at`` = ``now``."""
    new = names.select(key, F.trim(column).alias("_name")).where("_name <> ''")
    out = rows.join(new, key, "left")
    hit = F.col("_name").isNotNull()
    return out.withColumns({column: F.coalesce("_name", column), "updated_at": F.when(hit, F.lit(now).cast(rows.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))}).select(*rows.columns)


def message_pairs(asked: DataFrame, first_id: Column, now: Column) -> DataFrame:
    """Two messages for each (conversation_id, question, answer, used_memory_ids): the user's, then the assistant's with its facts."""
    one = lambda i, role, c, used: F.struct((first_id + i).alias("id"), F.lit(role).alias("role"), c.alias("content"), used.alias("used_memory_ids"))
    both = F.array(one(0, "user", F.col("question"), F.lit(None).cast("string")), one(1, "assistant", F.col("answer"), F.col("used_memory_ids")))
    return asked.select("conversation_id", now.alias("created_at"), F.explode(both).alias("m")).select("m.id", "conversation_id", "m.role", "m.content", "m.used_memory_ids", "created_at")
