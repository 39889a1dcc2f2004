"""Fragments of DuckDB SQL that mean the same as the expressions in ``functions.text``."""

from __future__ import annotations

import html
import html.entities
import unicodedata
from functools import lru_cache

from textmill.functions import text as X

QUERIES: dict = {}
SQL: dict = {}


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{X.WS}+|{X.WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{X.WS}+', ' ', 'g')")


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '{X.WORD}')"


def tokens(x: str) -> str:
    """Words and single other signs."""
    return rf"regexp_extract_all({x}, '{X.WORD}|[^\p{{L}}\p{{N}}_{X.WS_CLASS}]')"


def plain_words(x: str) -> str:
    return f"regexp_extract_all({x}, '{X.NON_WS}+')"


def jaccard(a: str, b: str, empty: float) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def any_of(x: str, parts) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, p.replace("'", "''")) for p in parts) + ")"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def compatible() -> tuple[str, str]:
    """A VALUES list (c, d) of characters with a compatibility decomposition, and their class; by rule from Unicode data."""
    pairs = {chr(n): unicodedata.normalize("NFKD", chr(n)) for n in range(0x80, 0x110000) if not 0xD800 <= n < 0xE000 and unicodedata.decomposition(chr(n)).startswith("<")}
    points = sorted(map(ord, pairs))
    runs, begin = [], points[0]
    for a, b in zip(points, [*points[1:], None]):
        if b != a + 1:
            runs.append(f"\\x{{{begin:X}}}-\\x{{{a:X}}}")
            begin = b
    return "(VALUES " + ", ".join(f"({lit(c)}, {lit(d)})" for c, d in pairs.items()) + ") k(c, d)", f"[{''.join(runs)}]"


def nfkc_of(table: str, keys: str, text: str) -> str:
    """A query (keys, text) with ``text`` of ``table`` in NFKC: decomposed character by character, then composed."""
    values, odd = compatible()
    return f"""SELECT t.*, nfc_normalize(coalesce(x.full_text, t.{text})) AS nfkc FROM {table} t LEFT JOIN (
  SELECT {keys}, string_agg(coalesce(d, ch), '' ORDER BY place) AS full_text FROM (
    SELECT {keys}, unnest(regexp_extract_all({text}, '(?s).')) AS ch, unnest(range(1, length({text}) + 1)) AS place FROM {table} WHERE regexp_matches({text}, '{odd}')) z
  LEFT JOIN {values} ON c = ch GROUP BY {keys}) x USING ({keys})"""


ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};)"


@lru_cache(maxsize=1)
def entities() -> str:
    """A VALUES list (name, value) of named entities and of the numbers that stand for other characters; by rule from the standard's table."""
    named = {f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";")}
    numbers = {f"&#{n};": html.unescape(f"&#{n};") for n in range(128, 160)}
    return "(VALUES " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in (named | numbers).items()) + ") e(name, value)"


def unescaped(table: str, key: str, text: str) -> str:
    """A query (key, text) with the entities of ``text`` resolved; what isn't an entity stays."""
    number = "CASE WHEN m ILIKE '&#x%' THEN CAST('0x' || regexp_extract(m, '[0-9a-fA-F]+', 0) AS BIGINT) ELSE CAST(regexp_extract(m, '[0-9]+', 0) AS BIGINT) END"
    return f"""SELECT t.{key}, CASE WHEN w.d IS NULL THEN t.{text} ELSE array_to_string(list_transform(range(1, len(w.d) + 2), lambda i: regexp_split_to_array(t.{text}, '{ENTITY}')[i] || coalesce(w.d[i], '')), '') END AS plain
FROM {table} t LEFT JOIN (SELECT {key}, list(coalesce(value, CASE WHEN m LIKE '&#%' THEN chr(({number})::INT) ELSE m END) ORDER BY i) AS d FROM (
  SELECT {key}, unnest(regexp_extract_all({text}, '{ENTITY}')) AS m, unnest(range(1, len(regexp_extract_all({text}, '{ENTITY}')) + 1)) AS i FROM {table}) z
  LEFT JOIN {entities()} ON name = m GROUP BY {key}) w USING ({key})"""
