"""Text expressions shared by the operators; each is one Column, evaluated in the JVM."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that mean the same in Java and RE2.
WORD = r"[\p{L}\p{N}_]+"
WS_CLASS = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CLASS}]"
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NON_WS = f"[^{WS_CLASS}]"
NON_ASCII = r"[^\x00-\x7F]"
ARABIC = r"[\x{0600}-\x{06FF}]"
CODE_HINT = r"[{}();<>]|(?:^|[^\p{L}\p{N}_])(?:def|class|import|return|function|const|let|var|if|else|for|while|SELECT|FROM)(?:$|[^\p{L}\p{N}_])"
# Words that mark a dialect.
DIALECT = ("عايز", "إزاي", "شلون", "مو", "وين", "شو")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, even where ``f`` uses it within a lambda."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def words(c: Column) -> Column:
    return all_matches(c, WORD)


def lower_words(c: Column) -> Column:
    return words(F.lower(c))


def plain_words(c: Column) -> Column:
    """Runs without white space."""
    return all_matches(c, f"{NON_WS}+")


def token_estimate(c: Column) -> Column:
    """Words plus single other characters."""
    return F.regexp_count(c, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}_{WS_CLASS}]"))


def memory_tokens(c: Column) -> Column:
    """Lower-cased words in which Arabic marks and punctuation stay, without repeats."""
    return F.array_distinct(all_matches(F.lower(c), r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"))


def chars(c: Column) -> Column:
    return all_matches(c, "(?s).")


def falsy_or(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Similarity of two sets; ``empty`` is the value if both are empty (0 if one is)."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def hash32(c: Column) -> Column:
    """The first 32 bits of the MD5 of a string, as a number; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def normal_form(c: Column, form: str) -> Column:
    """Unicode normalisation; Spark has none, so text beyond ASCII goes to Python and ASCII stays in the JVM."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.coalesce(normal(F.when(c.rlike(NON_ASCII), c)), c)


def normal_forms(a: Column, form: str) -> Column:
    """``normal_form`` of each string of an array."""

    @F.pandas_udf("array<string>")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else [None if t is None else unicodedata.normalize(form, t) for t in a])

    odd = F.exists(a, lambda t: F.coalesce(t.rlike(NON_ASCII), F.lit(False)))
    return F.coalesce(normal(F.when(odd, a)), a)


def unescape(c: Column) -> Column:
    """HTML entities to characters; only text with an ampersand goes to Python."""

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else html.unescape(t))

    return F.coalesce(plain(F.when(c.contains("&"), c)), c)


def clean_arabic(c: Column) -> Column:
    """Fold alef forms, drop stretches and vowel marks, set punctuation off by spaces, collapse white space. Expects composed text."""
    t = F.translate(F.coalesce(c, F.lit("")), "أإآٱ", "اااا")
    t = F.regexp_replace(t, r"[\x{0640}\x{0617}-\x{061A}\x{064B}-\x{0652}\x{0670}\x{06D6}-\x{06ED}]", "")
    return collapse(F.regexp_replace(t, r"([،؛؟!,:;.])", " $1 "))


def tokenizer_arabic(c: Column, diacritics: bool = True, stretches: bool = True, pad: bool = True, spaces: bool = True) -> Column:
    """The tokenizer's own normaliser, with a switch for each step."""
    t = F.coalesce(c, F.lit(""))
    if diacritics:
        t = F.regexp_replace(t, r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]", "")
    if stretches:
        t = F.regexp_replace(t, r"\x{0640}", "")
    if pad:
        t = F.regexp_replace(t, r"([،؛؟٪٬٫۔])", " $1 ")
    return collapse(t) if spaces else t


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def clean_markup(c: Column) -> Column:
    """Drop tags, then resolve entities, compose and collapse white space."""
    return collapse(normal_form(unescape(strip_tags(c)), "NFC"))


def detect_language(c: Column) -> Column:
    """ar-dialect, ar or en by script and marker words."""
    dialect = F.lit(False)
    for w in DIALECT:
        dialect = dialect | c.contains(w)
    return F.when(F.coalesce(c.rlike(ARABIC), F.lit(False)), F.when(dialect, "ar-dialect").otherwise("ar")).otherwise("en")


def bucket_of(text: Column, language: Column, source: Column) -> Column:
    """arabic, english or code: by language prefix, then code hints in the text, then hints in the source."""
    lang, src = F.lower(F.coalesce(language, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    code = text.rlike(CODE_HINT)
    return (
        F.when(lang.startswith("ar"), "arabic")
        .when(lang.startswith("en"), F.when(code | src.rlike("code|github"), "code").otherwise("english"))
        .otherwise(F.when(code | src.rlike("code|program|github|stack"), "code").when(text.rlike(ARABIC), "arabic").otherwise("english"))
    )
