"""Problem 5: one consistent form of text that looks the same.

A transducer over grapheme clusters (a base character and the marks behind it) maps
width forms, ligatures, accents, kinds of space, invisible characters and letters of
the same shape in one pass. It is compiled once from Unicode data and short lists of
look-alike letters into tables: single characters, clusters of a letter and one or two
marks, decompositions, classes of marks and compositions. The longest cluster at a place
wins; text outside the trigger class is copied. Compiling checks the tables for
conflicts: mapping an output again must leave it as it is.

``canonical`` is the form for comparing. It writes look-alike letters in Latin or plain
Arabic, whatever the word. ``readable`` is the form for keeping: it changes a letter only
where the word's own script shows that it is foreign, so that sound Cyrillic, Greek and
Persian text stays as it is.

Case, digits, superscripts, missing or other accents or hamza, stretched Arabic words,
added spaces and line breaks stay distinct.

Defined results: null gives null, empty text stays empty, text of any length is
processed whole, repeated rows get the same form, empty tables give empty results, and
extra columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.session import cut

# Letters of other scripts with the shape of a Latin letter (Cyrillic, Greek, Armenian, phonetic; then Cherokee; then Lisu).
LATIN_SHAPES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уγ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈᎫꓙ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ", "O": "ОΟꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "ꓣ", "S": "ЅᏚꓢ", "T": "ТΤᎢꓔ", "U": "ꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ",
    "ʙ": "в", "ʜ": "н", "ᴋ": "к", "ᴍ": "м", "ᴛ": "т",
}
# Letters of the Arabic script with the shape of a letter of Arabic.
ARABIC_SHAPES = {"ك": "کڪ", "ه": "ەہھ", "ي": "ی"}
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufe00-\ufe0f\ufeff\U000e0001\U000e0020-\U000e007f\U000e0100-\U000e01ef]")
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


MARKS = "\u0300-\u036f\u0483-\u0489\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
COMPOSING = "\u0300-\u036f\u0483-\u0489\u0653-\u0655\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"
VOWELS = "".join(map(chr, [*range(0x64B, 0x653), 0x670]))
HIGH = "[\U00010000-\U0010ffff]"
# Ranges without mapped characters, which the tables leave out.
_PLAIN = ((0x2FF0, 0x3000), (0x3400, 0xA000), (0xAC00, 0xE000), (0x20000, 0x2F800), (0x2FA20, 0xE0000), (0xE01F0, 0x110000))


def _code_points() -> Iterator[int]:
    n = 0xA0
    for a, b in (*_PLAIN, (0x110000, 0x110000)):
        yield from range(n, a)
        n = b


class Transducer:
    """The compiled tables, and the pass over a text. ``shapes`` tells whether look-alike letters are written in one script."""

    def __init__(self, shapes: bool) -> None:
        one: dict[str, str] = {c: to for to, like in (LATIN_SHAPES | ARABIC_SHAPES).items() for c in like} if shapes else {}
        one |= dict.fromkeys(SPACES, " ")
        one["\u2011"] = "\u2010"  # kept from a line break, and otherwise the same
        self.parts: dict[str, str] = {}  # canonical decompositions
        self.joins: dict[tuple[str, str], str] = {}  # compositions
        self.order: dict[str, int] = {}  # classes of marks
        for n in _code_points():
            c = chr(n)
            if INVISIBLE.match(c):
                one[c] = ""
                continue
            if k := unicodedata.combining(c):
                self.order[c] = k
            d = unicodedata.decomposition(c)
            if not d:
                continue
            # Widths, ligatures and shaped Arabic letters; not superscripts, fractions or circled signs.
            if d.startswith(("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<font>")) or (d.startswith("<compat>") and 0xFB00 <= n <= 0xFB4F):
                to = unicodedata.normalize("NFKC", c)
                # shaped marks are shown on a space or a stretched line
                one[c] = to.lstrip(" ـ") if len(to) > 1 and to[0] in " ـ" else to
            elif d[0] != "<":
                self.parts[c] = unicodedata.normalize("NFD", c)
                pair = d.split()
                if len(pair) == 2 and unicodedata.normalize("NFC", c) == c:
                    self.joins[chr(int(pair[0], 16)), chr(int(pair[1], 16))] = c
        for c, to in one.items():  # an output may itself hold a mapped character
            for _ in range(5):
                if not any(x in one for x in to):
                    break
                to = "".join(one.get(x, x) for x in to)
            else:
                raise ValueError(f"the mapping of U+{ord(c):04X} doesn't end")
            one[c] = to
        self.one = one
        # Composed letters with a mapped base, such as Cyrillic or Greek letters with an accent, and signs that are letters.
        self.one |= {c: to for c in self.parts if c not in one and (self.parts[c][0] in one or c in "\u212a\u212b") and (to := self.cluster(c)) != c}
        self.one = {c: self.cluster(to) for c, to in self.one.items()}  # an output may be a composed letter
        self.clusters: dict[str, str] = {}
        for c, d in self.parts.items():
            if len(d) > 1 and c <= "\uffff" and c not in self.one:
                self.clusters[d] = self.cluster(d)
        letters = [chr(n) for n in range(0x621, 0x64B) if n not in range(0x63B, 0x641)]
        for c in letters:
            for a in VOWELS:
                for b in VOWELS:
                    self.clusters[c + a + b] = self.cluster(c + a + b)
        for c, to in (self.one | self.clusters).items():
            if self.cluster(to) != to:
                raise ValueError(f"conflict at {c!r}: {to!r} is mapped again")
        # Character classes within the first plane are bit maps in ``re``; higher characters would turn them into lists.
        low = "".join(re.escape(c) for c in self.one if c <= "\uffff")
        hidden = "".join(c for c in self.one if self.one[c] == "" and c <= "\uffff")
        self.single = (re.compile(f"[{low}]"), re.compile(HIGH))
        self.composing = (re.compile(f"[{COMPOSING}]"), re.compile(f"[{VOWELS}]{{2}}"))
        # What must occur for anything to change: a mapped character, a composing mark, or two marks on one letter.
        self.trigger = (re.compile(f"[{low}{COMPOSING}]"), re.compile(HIGH), self.composing[1])
        # A cluster: any character with marks behind it (invisible characters between them included), or a mapped one.
        self.longest = re.compile(f"(?:.[{hidden}]*[{MARKS}][{MARKS}{hidden}]*|[{low}]|{HIGH})", re.DOTALL)

    def cluster(self, c: str) -> str:
        """The output for one cluster, by the tables: map, take apart, map, order the marks, compose."""
        apart = [z for x in c for y in self.one.get(x, x) for z in self.parts.get(y, y)]
        seq = [y for x in apart for y in self.one.get(x, x)]
        at = 0
        while at < len(seq):  # marks between two bases, by class; marks of one class keep their order
            end = at
            while end < len(seq) and seq[end] in self.order:
                end += 1
            seq[at:end] = sorted(seq[at:end], key=self.order.__getitem__)
            at = max(end, at) + 1
        out: list[str] = []
        base, last = -1, 0
        for x in seq:
            k = self.order.get(x, 0)
            if base >= 0 and (last < k or (last == 0 and base == len(out) - 1)) and (joined := self.joins.get((out[base], x))):
                out[base] = joined
                continue
            if k == 0:
                base, last = len(out), 0
            else:
                last = k
            out.append(x)
        return "".join(out)

    def write(self, m: re.Match) -> str:
        c = m[0]
        out = self.one.get(c)
        if out is None:
            out = self.clusters.get(c)
            if out is None:
                out = self.cluster(c)
                if len(self.clusters) < 100_000:  # a cache; the result is the same without
                    self.clusters[c] = out
        return out

    def __call__(self, text: str) -> str:
        if text.isascii() or not any(p.search(text) for p in self.trigger):
            return text
        if not any(p.search(text) for p in self.composing):  # every cluster is one character
            one = self.one
            for p in self.single:
                text = p.sub(lambda m: one.get(m[0], m[0]), text)
            return text
        return self.longest.sub(self.write, text)


@lru_cache(maxsize=2)
def transducer(shapes: bool = True) -> Transducer:
    return Transducer(shapes)


def canonical(text: str) -> str:
    """The form of one text for comparing."""
    return transducer()(text)


# Small capitals are no letters of words, so that Cyrillic letters of their shape tell the script.
_SHAPE = {c: to for to, like in LATIN_SHAPES.items() for c in like if to.isascii()}
_ARABIC = {c: to for to, like in ARABIC_SHAPES.items() for c in like}
_ARABIC_LIKE = re.compile(f"[{''.join(_ARABIC)}]")
_LIKE = re.compile(f"[{''.join(_SHAPE)}]")
_LETTERS = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
# Scripts with look-alikes that also write sound text, and their letters for the shapes of Latin ones.
SCRIPTS = (re.compile("[\u0400-\u052f]"), re.compile("[\u0370-\u03ff\u1f00-\u1fff]"))
_BACK = tuple({to: c for to, like in LATIN_SHAPES.items() if to.isascii() for c in like[::-1] if rx.match(c)} for rx in SCRIPTS)
_PERSIAN, _PLAIN_ARABIC = re.compile("[پچژگٹڈڑں]"), re.compile("[كي]")


def readable(text: str) -> str:
    """One text in consistent characters, each word in its own script.

    A look-alike becomes Latin in a word with Latin letters, and in a word of nothing else
    unless the text has words that only its own script can write. In a word with such
    letters, Latin ones are foreign and become the script's. Persian forms of Arabic letters
    stay in a text with letters of Persian and without the Arabic forms.
    """
    text = transducer(False)(text)
    if text.isascii():
        return text
    if _ARABIC_LIKE.search(text) and not (_PERSIAN.search(text) and not _PLAIN_ARABIC.search(text)):
        text = _ARABIC_LIKE.sub(lambda m: _ARABIC[m[0]], text)
    if not _LIKE.search(text):
        return text
    own = [any(x not in _SHAPE for x in rx.findall(text)) for rx in SCRIPTS]

    def word(m: re.Match) -> str:
        w = m[0]
        if not _LIKE.search(w):
            return w
        latin = _LATIN.search(w) is not None
        for rx, back, sound in zip(SCRIPTS, _BACK, own):
            mine = rx.findall(w)
            if not mine:
                continue
            if any(x not in _SHAPE for x in mine):
                return "".join(back.get(x, x) for x in w) if all(x in back for x in _LATIN.findall(w)) else w
            if sound and not latin:
                return w
        return "".join(_SHAPE.get(x, x) for x in w)

    return unicodedata.normalize("NFC", _LETTERS.sub(word, text))


@F.pandas_udf(T.StringType())
def _readable_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(readable, na_action="ignore")


def unify(column: Column) -> Column:
    """The readable form of a string column."""
    return _readable_udf(column)


def fingerprints(df: DataFrame, tbl: str, id_col: str, text: Column) -> DataFrame:
    """(tbl, id, raw, form): 16-byte fingerprints of each text and of its form for comparing, in one pass; blank and null texts take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = transducer()
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("_t").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for i, t in zip(ids, texts):
                f = form(t)
                if f and not f.isspace():
                    raw = hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                    out[0].append(i)
                    out[1].append(raw)
                    out[2].append(raw if f is t else hashlib.md5(f.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["id", "raw", "form"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), text.alias("_t")).where("id is not null and _t is not null")
    return rows.mapInArrow(run, "id string, raw binary, form binary").select(F.lit(tbl).alias("tbl"), "id", "raw", "form")


def look_alike_classes(prints: DataFrame) -> DataFrame:
    """(tbl, id, class_id, variants, links): rows whose form has at least two different texts.

    ``class_id`` is the smallest id of the form, ``variants`` the number of its texts and
    ``links`` the number of ids whose text looks the same as this one's and differs. Copies
    are counted, not paired, so that a class of any size costs one row for each id. An id
    with several texts of one form has a row for each.
    """
    rows = prints.distinct()
    variant = rows.groupBy("tbl", "form", "raw").agg(F.count("*").alias("own"), F.min("id").alias("first"))
    form = variant.groupBy("tbl", "form").agg(F.sum("own").alias("all"), F.count("*").alias("variants"), F.min("first").alias("class_id")).where("variants > 1")
    sized = variant.join(form, ["tbl", "form"]).select("tbl", "form", "raw", "class_id", "variants", (F.col("all") - F.col("own")).alias("links"))
    return rows.join(sized, ["tbl", "form", "raw"]).select("tbl", "id", "class_id", "variants", "links")


def look_alike_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (tbl, id_a, id_b) of different ids whose texts look the same but differ.

    A class holds the texts of one form; only classes with at least two different texts are
    joined, so that a large group of exact copies without a look-alike costs nothing. Pairs
    of texts come first and are then spread over the ids that have them; a text that many
    ids have is split by the skew join. ``look_alike_classes`` says the same in one row for
    each id.
    """
    rows = cut(prints.distinct())  # read four times
    classes = rows.groupBy("tbl", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("tbl", "form")
    rows = rows.join(classes, ["tbl", "form"], "left_semi")
    variants = rows.select("tbl", "form", "raw").distinct()
    a, b = variants.withColumnRenamed("raw", "raw_a"), variants.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, ["tbl", "form"]).where("raw_a <> raw_b")
    left = rows.select("tbl", "form", F.col("raw").alias("raw_a"), F.col("id").alias("id_a"))
    right = rows.select("tbl", "form", F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    out = left.join(pairs, ["tbl", "form", "raw_a"]).join(right, ["tbl", "form", "raw_b"]).where("id_a < id_b")
    return out.select("tbl", "id_a", "id_b").distinct()


def conversation_text(column: str = "conversation") -> Column:
    """Roles and contents of all turns as one text, for comparing."""
    return F.when(F.size(column) > 0, F.array_join(F.transform(column, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\x1f"), F.coalesce(t["content"], F.lit("")))), "\x1e"))
