"""Problem 10: find and restore text that was decoded with the wrong encoding.

For every pair of a true and a wrong encoding the garbled form of each character of
interest is precomputed. The forms go into one Aho-Corasick automaton; the maximal
chains of matches are the garbled spans, and only they are replaced. Restoring is
repeated until nothing changes, which undoes text that was garbled twice.

Two families of patterns are needed. A character of UTF-8 becomes two or three
characters, so its form alone is evidence. A character of a single-byte Arabic page
becomes one Latin letter, which proves nothing; there the patterns are pairs of
letters, and a chain counts from ``MIN_RUN`` letters on.

Defined results: null text gives ``garbled`` false, ``restored`` null and no spans;
empty text is never garbled; a text of any length is processed whole; repeated rows
each get the same result; an empty table gives an empty table; other columns of the
input, whatever their names, are kept unless they clash with the three new ones,
which then replace them.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings under which UTF-8 is read by mistake.
WRONG_FOR_UTF8 = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "mac_roman", "cp437", "cp850", "koi8-r", "iso8859-6")
# (true, wrong) single-byte pairs for Arabic.
SINGLE = tuple((true, wrong) for true in ("cp1256", "iso8859-6") for wrong in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "koi8-r"))
# (true, wrong) single-byte pairs for Latin text.
SINGLE_LATIN = (("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "koi8-r"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1253"), ("cp1252", "cp1256"), ("cp1252", "iso8859-6"))
# Greek letters that also stand for Latin ones on purpose (problem 5) and so prove no wrong encoding.
GREEK_LOOK_ALIKES = "αγηικνορστυω"
MIN_RUN = 3
LATIN_LIKE = ("latin-1", "cp1252", "cp1250", "cp1254")
REPLACEMENT = "�"
# What a decoder puts for a byte that the wrong encoding doesn't have.
LOST = "?" + REPLACEMENT


def _byte_table(enc: str) -> dict[int, str]:
    """Each byte as the wrong decoder shows it; a byte without a character shows as the C1 control."""
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


def _alphabet() -> list[str]:
    """Characters whose garbled forms are looked for: Arabic, accented Latin and typographic marks."""
    ranges = ((0x80, 0x17F), (0x192, 0x193), (0x2C6, 0x2C7), (0x2DC, 0x2DD), (0x60C, 0x670), (0x671, 0x6D4), (0x6F0, 0x6FA), (0x2010, 0x2040), (0x20AC, 0x20AD), (0x2122, 0x2123), (0xFB01, 0xFB03), (0xFEFF, 0xFF00))
    return [chr(c) for a, b in ranges for c in range(a, b) if chr(c).isprintable() or 0x80 <= c <= 0xAD or c == 0xFEFF or 0x64B <= c <= 0x65F or 0x200C <= c <= 0x200F or c == 0x202F]


def _symbols() -> list[str]:
    """Further characters: presentation forms, arrows to miscellaneous symbols, and those of four bytes that are in use."""
    ranges = ((0x2190, 0x2C00), (0xFB50, 0xFE00), (0xFE0F, 0xFE10), (0xFE70, 0xFEFD), (0x1F000, 0x1FB00))
    return [chr(c) for a, b in ranges for c in range(a, b) if chr(c).isprintable() or c == 0xFE0F]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    known: dict[str, tuple] = {}
    # A continuation byte may show as a mark that also follows a letter in sound text; such a pair needs a neighbour.
    weak_second = set("،؛؟«»…’”“‘–—- ‌‍'\".,!?:;) ")
    for enc in WRONG_FOR_UTF8:
        table = _byte_table(enc)
        for c in _alphabet():
            raw = c.encode("utf-8")
            shown = "".join(table[b] for b in raw)
            if shown == c or len(shown) < 2 or shown.isascii():
                continue
            # Letters, or a letter and a mark of ordinary text, also occur in sound text.
            weak = shown[0].isalpha() and ((len(raw) == 2 and shown[1] in weak_second) or (all(x.isalpha() for x in shown) and enc not in LATIN_LIKE and (len(raw) == 2 or enc == "cp850")))
            weak = weak and not (shown[0] in "ÃÂ" and shown[1] in "»«\xa0")
            old = known.get(shown)
            if old is None:
                known[shown] = ("u", c, weak)
            elif old[1] != c:
                known[shown] = ("u", old[1], old[2] and weak)
            # The wrong decoder had no character for the last byte.
            for k in range(1, len(raw)):
                if table[raw[k]] == chr(raw[k]) and 0x80 <= raw[k] < 0xA0:
                    for lost in LOST:
                        form = "".join(lost if j == k else table[b] for j, b in enumerate(raw))
                        if not form[0].isascii() and len(form) >= 2:
                            known.setdefault(form, ("u", None, lost == "?"))
    for enc in WRONG_FOR_UTF8:
        table = _byte_table(enc)
        for c in _symbols():
            raw = c.encode("utf-8")
            shown = "".join(table[b] for b in raw)
            known.setdefault(shown, ("u", c, enc == "cp850" and shown[:2].isalpha()))  # also Arabic bytes read as Latin letters
            for k in range(1, len(raw)):
                if table[raw[k]] == chr(raw[k]) and 0x80 <= raw[k] < 0xA0:
                    for lost in LOST:
                        known.setdefault("".join(lost if j == k else table[b] for j, b in enumerate(raw)), ("u", None, lost == "?"))
    letters = [chr(c) for c in range(0x621, 0x64B) if c not in range(0x63B, 0x641)] + [chr(c) for c in range(0x64B, 0x653)] + list("،؛؟")
    for true, wrong in SINGLE:
        table = _byte_table(wrong)
        one = {}
        for c in letters:
            try:
                one[table[c.encode(true)[0]]] = c
            except UnicodeEncodeError:
                continue
        for a in one:
            for b in one:
                if a + b not in known:
                    known[a + b] = ("s", None, True)
    # A Latin letter read as a capital, a symbol or a letter of another script behind a small letter.
    for true, wrong in SINGLE_LATIN:
        table = _byte_table(wrong)
        for c in "àâäçèéêëîïôöùûüñáíóúßœ":
            try:
                x = table[c.encode(true)[0]]
            except UnicodeEncodeError:
                continue
            odd = x in "˚‰¸ˆ‹˜¯" or (x.isalpha() and not (x.islower() and unicodedata.name(x, "").startswith("LATIN SMALL LETTER")) and x not in "ªºœæß") or x == "ﬂ"
            if odd and x not in GREEK_LOOK_ALIKES:
                for a in "abcdefghijklmnopqrstuvwxyz":
                    known.setdefault(a + x, ("l", c, False))
        x = table.get("°".encode(true)[0], "")
        if x and not x.isalnum() and not x.isascii() and x != "°" and x in "∞░╟":
            for a in "0123456789":
                known.setdefault(a + x, ("l", "°", False))
    for form, value in known.items():
        auto.add_word(form, (len(form), *value))
    auto.make_automaton()
    return auto


@lru_cache(maxsize=1)
def _single_maps() -> list[dict[str, str]]:
    maps = []
    for true, wrong in SINGLE:
        table = _byte_table(wrong)
        maps.append({table[b]: bytes([b]).decode(true, "replace") for b in range(0x80, 256)})
    return maps


def _case_breaks(piece: str) -> bool:
    """Whether letters of a script with sound text of its own change to capitals within words, as they only do by accident."""
    own = re.findall("[\u0370-\u052F]", piece)
    if 2 * len(own) < len(re.findall("[^\\x00-\\x7F]", piece)):
        return True
    return 8 * sum(x.islower() and y.isupper() for x, y in zip(piece, piece[1:])) >= len(own)


_AR = re.compile(r"[ء-ْ]")
_COMMON = re.compile(r"ال|في|من|لى|ية|كل|لا|ول|لي")


def _best_single(run: str) -> str | None:
    """The reading of a run of Latin letters as Arabic, if one makes sense."""
    best, score = None, 0.0
    for m in _single_maps():
        out = "".join(m.get(c, c) for c in run)
        n = sum(not c.isspace() and not c.isascii() for c in run) or 1
        arabic = (len(_AR.findall(out)) - 2 * len(re.findall("[À-ÿ]", out))) / n
        s = arabic * (1 + 10 * len(_COMMON.findall(out)) / n)
        if arabic >= 0.8 and s > score:
            best, score = out, s
    return best if score > 1.0 else None


_ESCAPED = re.compile(r"(?:&#\d{2,6};|&#[xX][0-9a-fA-F]{2,5};|&[A-Za-z]{2,8}\d?;|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2})(?:[ ]?(?:&#\d{2,6};|&#[xX][0-9a-fA-F]{2,5};|&[A-Za-z]{2,8}\d?;|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}))*")
_BACKSLASH = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")


def _numeric(m: re.Match) -> str:
    n = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]


def _unescape(s: str) -> str:
    s = _BACKSLASH.sub(lambda m: chr(int(m[1] or m[2], 16)), s)
    s = re.sub(r"&#([xX]?[0-9a-fA-F]+);", _numeric, s)  # html.unescape would itself map C1 numbers to cp1252
    return html.unescape(s)


class _Taken:
    """Whether a stretch meets any of some intervals, in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def __call__(self, s: int, e: int) -> bool:
        i = bisect_left(self.starts, e)
        return i > 0 and self.ends[i - 1] > s


def _spans(text: str) -> list[tuple[int, int, str]]:
    """Garbled spans (start, end, kind) of one pass: 'u' for UTF-8, 's' for single-byte Arabic, 'l' for single-byte Latin, 'x' for lost characters."""
    hits: list[tuple[int, int, str, bool]] = []
    for end, (n, kind, _, weak) in _automaton().iter(text):
        hits.append((end + 1 - n, end + 1, kind, weak))
    out: list[tuple[int, int, str]] = []
    if hits:
        utf = sorted((s, -e, w) for s, e, k, w in hits if k == "u")
        strong = _Taken([(s, -e) for s, e, w in utf if not w])
        run_s, run_e = -1, -1
        for s, e, k, _ in [*sorted(h for h in hits if h[2] == "s"), (len(text) + 9, len(text) + 9, "s", True)]:
            if run_s >= 0 and s > run_e and not (s - run_e <= 6 and not re.search(r"[A-Za-z]", text[run_e:s])):
                piece = text[run_s:run_e]
                longest = max((len(x) for x in re.findall(r"[^\x00-\xbf]+", piece)), default=0)
                if longest >= MIN_RUN and _case_breaks(piece) and not strong(run_s, run_e) and _best_single(piece):
                    out.append((*_widen(text, run_s, run_e), "s"))
                run_s = -1
            if run_s < 0:
                run_s, run_e = s, e
            else:
                run_e = max(run_e, e)
        if out:
            taken = _Taken([x[:2] for x in out])
            utf = [x for x in utf if not taken(x[0], -x[1])]
        # longest match first at each place, then chains of touching matches
        chain: list[tuple[int, int, bool]] = []

        def close() -> None:
            if chain and (len(chain) >= MIN_RUN or any(not w or _inside_word(text, a, b) for a, b, w in chain)):
                out.append((chain[0][0], chain[-1][1], "u"))

        at = 0
        for s, e, w in utf:
            e = -e
            if s < at:
                continue
            if chain and not _bridge(text[at:s]):
                close()
                chain = []
            chain.append((s, e, w))
            at = e
        close()
    taken = _Taken([x[:2] for x in out])
    at = -1
    for s, e, k, _ in sorted(h for h in hits if h[2] == "l"):
        if s >= at and not taken(s, e):
            out.append((s, e, "l"))
            at = e
    taken = _Taken([x[:2] for x in out])
    out += [(m.start(), m.end(), "x") for m in re.finditer(REPLACEMENT, text) if not taken(m.start(), m.end())]
    return sorted(out)


def _inside_word(text: str, s: int, e: int) -> bool:
    """Whether a form that also occurs in sound text stands inside a word of ASCII letters, where it doesn't."""
    before, after = text[s - 1 : s], text[e : e + 1]
    foreign = not text[s].isascii() and not (text[s].islower() and text[s] <= "\xff")
    return foreign and ((before.isascii() and before.islower()) or (after.isascii() and after.islower()) or (before.isdigit() and before.isascii()))


def _bridge(gap: str) -> bool:
    """Whether garbled characters on both sides of ``gap`` belong together."""
    return len(gap) <= 3 and all(c in " .,:;!()\n\"'" or c in LOST or "\x80" <= c <= "\xbf" for c in gap)


def _widen(text: str, s: int, e: int) -> tuple[int, int]:
    """Take in single garbled letters at the edges of a run, standing alone as a word."""
    while e < len(text) and "\xc0" <= text[e] <= "\xff":
        e += 1
    while s > 0 and "\xc0" <= text[s - 1] <= "\xff":
        s -= 1
    return s, e


def _undo(piece: str) -> str:
    out, at = [], 0
    found = sorted((end + 1 - n, -(end + 1), c) for end, (n, k, c, _) in _automaton().iter(piece) if k in ("u", "l"))
    for s, e, c in found:
        if s < at:
            continue
        keep = piece[s] if piece[s].isascii() else ""
        out += [piece[at:s], keep + (c if c is not None else REPLACEMENT)]
        at = -e
    return "".join([*out, piece[at:]])


def repair(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The restored text and the garbled spans, as places in ``text`` (for escaped text the escaped stretch)."""
    where: list[tuple[int, int]] = []
    if "&" in text or "\\" in text:
        parts, at, found = [], 0, False
        for m in _ESCAPED.finditer(text):
            plain = _unescape(m[0])
            fixed, spans = repair(plain) if plain != m[0] and not plain.isascii() else (plain, [])
            if spans:
                found = True
                where.append((m.start(), m.end()))
                parts += [text[at : m.start()], fixed]
                at = m.end()
        if found:
            text = "".join([*parts, text[at:]])
    first, seen = True, set()
    while text not in seen:  # a round that leads back to an earlier text ends the search
        seen.add(text)
        spans = _spans(text)
        if first:
            where = where or [(a, b) for a, b, _ in spans]
            first = False
        work = [x for x in spans if x[2] != "x"]
        if not work:
            break
        parts, at = [], 0
        for s, e, kind in work:
            piece = text[s:e]
            parts += [text[at:s], _undo(piece) if kind in ("u", "l") else (_best_single(piece) or piece)]
            at = e
        text = "".join([*parts, text[at:]])
    return text, where


def restore(df: DataFrame, column: str = "text") -> DataFrame:
    """Add ``garbled`` BOOLEAN, ``restored`` STRING and ``garbled_spans`` ARRAY<STRUCT<start, end>>.

    Text within ASCII and without an escape can't be garbled and doesn't leave the JVM.
    """
    kind = T.StructType([T.StructField("restored", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])

    @F.pandas_udf(kind)
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [repair(x) if x else (None, []) for x in s]
            yield pd.DataFrame({"restored": [r if w else None for r, w in rows], "spans": [[{"start": a, "end": b} for a, b in w] if w else None for _, w in rows]})

    may = F.col(column).rlike(r"[^\x00-\x7f]|&#|&[A-Za-z]{2,8};|\\[ux]")
    out = df.withColumn("_fix", fix(F.when(may, F.col(column))))
    return out.withColumns({
        "garbled": F.coalesce(F.size("_fix.spans") > 0, F.lit(False)),
        "restored": F.coalesce(F.col("_fix.restored"), F.col(column)),
        "garbled_spans": F.coalesce(F.col("_fix.spans"), F.array().cast("array<struct<start:int,end:int>>")),
    }).drop("_fix")
