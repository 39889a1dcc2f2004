"""Problem 1: languages of turns and of stretches within a turn.

A blended-spectrum string kernel compares a stretch with landmarks: the number of
character n-grams that both contain, over the square root of the product of their
numbers. Landmarks are ``LANDMARKS`` labelled sentences of each language, chosen by a hash;
a Nyström map of the kernel feeds one-versus-rest ridge regression on all labelled
sentences (``Model.error`` is the map's relative error on them). Since the kernel is a
product of presence vectors, landmarks, map and weights fold into one matrix of n-grams by
languages, and a batch of stretches is scored as its presence matrix times that matrix.

Confidences are calibrated: the sharpness of the softmax over scores is the one under which
labelled sentences held out from a first fit are most likely.

The labelled sample is bounded by ``MAX_SAMPLES`` texts, as many of each language, and
``MAX_EXAMPLES`` examples; the model is therefore of fixed size.

Defined results: null or empty conversations, null contents, code, stand-ins for a
missing answer and text without letters have no language; a turn of any length is
processed whole; repeated rows give the same rows once; empty tables give empty
results; columns other than id, language and conversation aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.lookalike import canonical
from textmill.operators.sample import bounded_sample

MAX_SAMPLES = 1_002
LANDMARKS = 300  # of each language
MAX_EXAMPLES = 600
MAX_EXTRA = 250  # further sentences of each language
MAX_TEXT = 100_000  # characters of a text or example that a model may be fitted on
FIRM = 0.9
SHARP = 4.0
BITS = 18
NGRAMS = (1, 2, 3, 4)
WIDTH = 8  # columns of the weights, padded for aligned reads
RIDGE = 0.3
BATCH_CHARS = 100_000
BATCH_ROWS = 1 << (32 - BITS)
LANGS = ("ar", "ar-dialect", "de", "en", "es", "fr")
ARABIC = (0, 1)
LATIN = (1, 2, 3, 4, 5)

_CODE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
# What stands beside the text, with the sign that each must hold.
_ASIDES = (("(", re.compile(r"\([^()]{0,200}\)")), ("[", re.compile(r"\[[^\[\]]{0,60}\]")), ("://", re.compile(r"https?://\S+")), ("@", re.compile(r"[^\s@]+@\S+")))
_QUOTED = re.compile(r"\"[^\"\n]{1,60}\"|«[^«»\n]{1,60}»|“[^“”\n]{1,60}”|„[^„“\n]{1,60}“")
_END = re.compile(r"(?<=[.!?؟…;؛])\s+|\n+|(?<=[:：])\s+(?=\S)")
_AR = re.compile(r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]")
_LA = re.compile(r"[A-Za-zÀ-ɏ]")
_MARKER = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s+")
# What stands in place of a missing answer.
STAND_INS = frozenset("n/a|na|none|null|nil|nan|todo|tbd|tba|blank|empty|no answer|no response|not available|unknown|missing|undefined|placeholder|لا يوجد|لا إجابة|لا جواب|لا توجد إجابة|غير متوفر|فارغ|بدون إجابة|مفيش|sin respuesta|ninguno|ninguna|aucun|aucune|aucune réponse|sans réponse|vide|keine|keine antwort|leer|entfällt|pas de réponse|no hay respuesta".split("|"))


_LONGEST = max(map(len, STAND_INS))


def is_stand_in(text: str) -> bool:
    t = text.strip(" \t\n.()[]{}<>-–—_*#\"'!?:;")
    return len(t) <= _LONGEST and t.lower() in STAND_INS


def _hide(m: re.Match) -> str:
    return " " * len(m[0])


def spans(text: str) -> list[tuple[int, int, str, bool]]:
    """Stretches of one script as (start, end, text, is Arabic); what is no one's language is left out, places are those of ``text``."""
    shown = text
    if "```" in shown:
        shown = _CODE.sub(lambda m: "\n" * len(m[0]), shown)
    for sign, aside in _ASIDES:
        if sign in shown:
            shown = aside.sub(_hide, shown)
    if '"' in shown or "“" in shown or "«" in shown or "„" in shown:
        shown = _QUOTED.sub(lambda m: m[0] if len(m[0].split()) > 5 else _hide(m), shown)
    out, a = [], 0
    for b, then in [*((m.start(), m.end()) for m in _END.finditer(shown)), (len(shown), len(shown))]:
        begin, a, end = a, then, b
        part = shown[begin:end]
        if m := _MARKER.match(part):
            begin += m.end()
            part = part[m.end() :]
        plain = part.isascii()
        if not plain:
            part = canonical(part)
        ar = not plain and _AR.search(part) is not None
        la = _LA.search(part) is not None
        if not ar or not la:
            if ar or la:
                out.append((begin, end, part, ar))
            continue
        # both scripts: runs of words of one script
        run: list[str] = []
        script, start, last = None, 0, 0
        for m in re.finditer(r"\S+", shown[begin:end]):
            w = canonical(m[0])
            x = True if _AR.search(w) else False if _LA.search(w) else None
            if x is not None and script is not None and x != script:
                out.append((begin + start, begin + last, " ".join(run), script))
                run = []
            if not run:
                start = m.start()
            if x is not None:
                script = x
            run.append(w)
            last = m.end()
        if run and script is not None:
            out.append((begin + start, begin + last, " ".join(run), script))
    return out


def segments(text: str) -> list[tuple[str, bool]]:
    """Stretches of one script, each with whether it is Arabic script."""
    return [x[2:] for x in spans(text)]


def words(text: str) -> int:
    return len(text.split())


class Model:
    """Weights of n-grams by languages, folded from landmarks, Nyström map and ridge weights."""

    def __init__(self, table: np.ndarray, sharpness: float = SHARP, error: float = 0.0) -> None:
        self.table, self.sharpness, self.error = table, sharpness, error
        self.used = table.any(axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row of scores for each text, in batches bounded in characters."""
        if not texts:
            return np.zeros((0, len(LANGS)), dtype=np.float32)
        out, at, size, begin = [], 0, 0, 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size > BATCH_CHARS or i - begin == BATCH_ROWS - 1 or i == len(texts) - 1:
                out.append(self._batch(texts[begin : i + 1]))
                begin, size = i + 1, 0
        return np.concatenate(out)

    def _batch(self, texts: list[str]) -> np.ndarray:
        row, gram, n = presence(texts)
        held = self.used[gram]  # n-grams of no landmark add nothing
        row, gram = row[held], gram[held]
        sums = np.zeros((len(texts), WIDTH), dtype=np.float32)
        if len(gram):
            own, first = np.unique(row, return_index=True)
            sums[own] = np.add.reduceat(self.table.take(gram, axis=0), first, axis=0)
        return (sums / np.sqrt(np.maximum(n, 1))[:, None])[:, : len(LANGS)]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The presence matrix of hashed n-grams as sorted (row, gram) pairs, and the number in each row."""
    joined = "\x00 " + " \x00 ".join([t.replace("\x00", " ") for t in texts]) + " \x00"
    code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    code[((code >= 48) & (code < 58)) | ((code >= 0x660) & (code < 0x66A))] = 48  # digits count as one
    code[(code > 0) & (code < 32)] = 32
    sep = code == 0
    row = (np.cumsum(sep) - 1).astype(np.uint32)  # at most ``BATCH_ROWS`` rows, so that a key has 32 bits
    h = code.astype(np.uint64)
    keys, roll = [], h.copy()
    ok = ~sep
    for n in range(1, max(NGRAMS) + 1):
        if n > 1:
            roll = roll[:-1] * np.uint64(1_000_003) + h[n - 1 :]
            ok = ok[:-1] & ~sep[n - 1 :]
        if n in NGRAMS:
            mixed = (roll[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            keys.append((row[: len(roll)][ok] << np.uint32(BITS)) | (mixed >> np.uint64(64 - BITS)).astype(np.uint32))
    key = np.concatenate(keys)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    r = (key >> np.uint32(BITS)).astype(np.intp)
    return r, (key & np.uint32((1 << BITS) - 1)).astype(np.intp), np.bincount(r, minlength=len(texts))


def _hash(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def train(samples: list[tuple[str, str]], extra: list[tuple[str, str]] = ()) -> Model:
    """Fit the model on labelled texts (lang, text) and further labelled sentences."""
    rows = [(LANGS.index(lang), t) for lang, t in extra]
    for lang, text in samples:
        if lang in LANGS and text:
            parts = [s for s, _ in segments(text) if words(s) >= 3] or [text]
            rows += [(LANGS.index(lang), t) for t in [*parts, *([text] if len(parts) > 1 else [])]]
    if not rows:
        return Model(np.zeros((1 << BITS, WIDTH), dtype=np.float32))
    rows.sort(key=lambda r: (_hash(r[1]), r))
    y, texts = np.array([r[0] for r in rows]), [r[1] for r in rows]
    row, gram, n = presence(texts)
    used, col = np.unique(gram, return_inverse=True)
    z = np.zeros((len(texts), len(used)), dtype=np.float32)
    z[row, col] = 1
    z /= np.sqrt(np.maximum(n, 1))[:, None]
    marks = np.concatenate([np.flatnonzero(y == i)[:LANDMARKS] for i in range(len(LANGS))])
    k = (z @ z[marks].T).astype(np.float64)
    value, vector = np.linalg.eigh(k[marks])
    good = value > 1e-6 * value[-1]
    nystrom = vector[:, good] / np.sqrt(value[good])
    phi = k @ nystrom
    error = float(1 - (phi**2).sum() / len(texts))  # the kernel of a text with itself is 1
    target = -np.ones((len(texts), len(LANGS)))
    target[np.arange(len(texts)), y] = 1
    # rare languages weigh as much as frequent ones
    weight = 1.0 / np.bincount(y, minlength=len(LANGS))[y]
    weight *= len(weight) / weight.sum()
    w = np.linalg.solve((phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ target)
    table = np.zeros((1 << BITS, WIDTH), dtype=np.float32)
    table[used, : len(LANGS)] = z[marks].T @ (nystrom @ w)
    return Model(table, error=error)


def calibrate(samples: list[tuple[str, str]]) -> float:
    """The sharpness under which sentences of a third of the texts are most likely, by a model of the other two thirds."""
    third = lambda r: _hash(r[1])[-1] % 3 == 0
    model = train([r for r in samples if not third(r)])
    held = [(LANGS.index(lang), s) for lang, t in samples if third((lang, t)) and lang in LANGS for s in segments(t)]
    if not held or not model.table.any():
        return SHARP
    score = masked_scores(model, [s for _, s in held])
    right = np.array([i for i, _ in held])
    keep = score[np.arange(len(held)), right] > -9  # a label of another script than the text says nothing
    score, right = score[keep], right[keep]
    if not len(right):
        return SHARP
    # Platt's targets: the right language isn't quite certain, however many sentences bear it out
    doubt = 1 / (len(right) + 2)
    target = np.where(score > -9, doubt / np.maximum((score > -9).sum(axis=1, keepdims=True) - 1, 1), 0.0)
    target[np.arange(len(right)), right] = 1 - doubt
    tries = np.arange(1.0, 40.5, 0.5)
    loss = [(target * (np.log(np.exp(t * score).sum(axis=1, keepdims=True)) - t * np.where(score > -9, score, 0.0))).sum() for t in tries]
    return float(tries[int(np.argmin(loss))])


def fit(samples: DataFrame, examples: DataFrame | None = None) -> Model:
    """Fit on at most ``MAX_SAMPLES`` rows of (sample_id, lang, text), and adapt the model to ``examples``.

    Rows are chosen by a hash, as many of each language. Samples hold few questions. From at
    most ``MAX_EXAMPLES`` labelled examples, chosen by a hash of the id, come the sentences
    that the first model is unsure about, and only from examples whose other sentences bear
    out the label. Texts beyond ``MAX_TEXT`` characters aren't fitted on, so that the sample
    is bounded in bytes.
    """
    known = []
    usable = samples.where(F.col("lang").isin(*LANGS) & (F.length("text") <= MAX_TEXT)).select("lang", "text", F.coalesce(F.col("sample_id").cast("string"), F.md5("text")).alias("k"))
    for lang in LANGS:
        known += [(r["lang"], r["text"]) for r in bounded_sample(usable.where(F.col("lang") == lang), "k", MAX_SAMPLES // len(LANGS)).collect()]
    model = train(known)
    sharpness = calibrate(known)
    if examples is not None and known:
        labelled = examples.where(F.lower(F.trim("language")).isin("ar", "ar-dialect") & F.col("id").isNotNull())
        labelled = labelled.select("id", F.lower(F.trim("language")).alias("lang"), F.col("conversation.content").alias("texts"), F.col("conversation.role").alias("roles"))
        labelled = labelled.where(F.length(F.array_join("texts", "")) <= MAX_TEXT)
        extra: dict[str, set[str]] = {}
        for r in bounded_sample(labelled, "id", MAX_EXAMPLES).collect():
            want = LANGS.index(r["lang"])
            segs = [s for role, t in zip(r["roles"] or (), r["texts"] or ()) if t and (role or "").strip().lower() != "system" for s in segments(t) if s[1] and words(s[0]) >= 4]
            if not segs:
                continue
            best, sure = classify(model, segs)
            firm = best[sure >= FIRM]
            if len(firm) and (firm == want).all():
                extra.setdefault(r["lang"], set()).update(t for (t, _), p in zip(segs, sure) if p < FIRM)
        more = [(lang, t) for lang, own in sorted(extra.items()) for t in sorted(own, key=lambda t: (_hash(t), t))[:MAX_EXTRA]]
        if more:
            model = train(known, more)
    model.sharpness = sharpness
    return model


def masked_scores(model: Model, segs: list[tuple[str, bool]]) -> np.ndarray:
    """Scores of stretches; languages of another script have -9."""
    s = model.scores([t for t, _ in segs])
    arabic = np.array([a for _, a in segs], dtype=bool)
    if len(s):
        s[np.ix_(arabic, [i for i in range(len(LANGS)) if i not in ARABIC])] = -9
        s[np.ix_(~arabic, [i for i in range(len(LANGS)) if i not in LATIN])] = -9
    return s


def _softmax_top(s: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(sharpness * (s - s.max(axis=1, keepdims=True)))
    return 1 / e.sum(axis=1)


def classify(model: Model, segs: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each stretch among those of its script, and how sure that is, in 0 to 1; for decisions within a turn."""
    s = masked_scores(model, segs)
    return s.argmax(axis=1), _softmax_top(s, SHARP)


# A stretch of fewer words counts as a whole sentence only if it is all that a turn has.
LEAST_WORDS = 3
SURE = 0.5


def turn_languages(segs: list[tuple[str, bool]], best: np.ndarray, sure: np.ndarray, before: int | None) -> dict[int, int]:
    """Languages of one turn, each with its surest stretch; ``before`` is the language of the turn it follows."""
    out: dict[int, int] = {}
    weak: list[tuple[int, float, int]] = []
    longest = max((words(t) for t, _ in segs), default=0)
    longest_arabic = max((words(t) for t, a in segs if a), default=0)
    for i, ((text, arabic), b, p) in enumerate(zip(segs, best, sure)):
        n = words(text)
        if arabic and n <= 5 < longest and out and (n < longest_arabic or n < LEAST_WORDS):
            continue  # a short phrase doesn't tell the written standard from a dialect beside a longer sentence
        if n >= LEAST_WORDS and (p >= SURE or n >= 6):
            if int(b) not in out or p > sure[out[int(b)]]:
                out[int(b)] = i
        else:
            weak.append((n, float(p), i))
    if not out and weak:
        n, p, i = max(weak)
        b, arabic = int(best[i]), segs[i][1]
        if before is not None and (before in ARABIC if arabic else before in LATIN and before != 1) and (n < LEAST_WORDS or p < SURE):
            b = before
        out[b] = i
    return out


TURN = [("id", pa.string()), ("turn_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("wrong", pa.bool_())]
SEGMENT = [("id", pa.string()), ("turn_no", pa.int32()), ("segment_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]


def _merged(parts: list, best: np.ndarray, sure: np.ndarray, langs: dict[int, int]) -> list[tuple[int, int, int, float]]:
    """(start, end, language, confidence) of neighbouring stretches of one language of the turn.

    A stretch that doesn't count as a language of its own, such as a single foreign word,
    goes to the language before it, else to the one behind it. The confidence is the mean
    of the stretches that count, by their length.
    """
    own = [int(b) if int(b) in langs and (i in langs.values() or words(x[2]) >= LEAST_WORDS) else None for i, (x, b) in enumerate(zip(parts, best))]
    if langs and not any(x is not None for x in own):
        lang, i = next(iter(langs.items()))
        own[i] = lang
    firsts = [x for x in own if x is not None]
    out: list[list] = []
    at = firsts[0] if firsts else None
    for (start, end, text, _), lang, p in zip(parts, own, sure):
        if at is None:
            break
        at = at if lang is None else lang
        weight = len(text) if lang is not None else 0
        if out and out[-1][2] == at:
            out[-1][1] = end
            out[-1][3] += p * weight
            out[-1][4] += weight
        else:
            out.append([start, end, at, p * weight, weight])
    return [(a, b, lang, float(s / w) if w else 0.0) for a, b, lang, s, w in out]


def _label(df: DataFrame, model: Model, parts: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((model.table, model.sharpness))  # of fixed size
    shape = SEGMENT if parts else TURN
    kinds = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            ids, labels = batch.column("id").to_pylist(), batch.column("language").to_pylist()
            turns: list[tuple[int, int, list]] = []
            for i, conv in enumerate(batch.column("conversation").to_pylist()):
                for k, t in enumerate(conv or ()):
                    if t and (t["role"] or "").strip().lower() in ("user", "human", "assistant") and t["content"] and not is_stand_in(t["content"]):
                        turns.append((i, k, spans(t["content"])))
            segs = [x[2:] for _, _, own in turns for x in own]
            scores = masked_scores(m, segs)
            best, sure, firm = scores.argmax(axis=1), _softmax_top(scores, SHARP), _softmax_top(scores, m.sharpness)
            out, found, b = [], {}, 0
            last_row, before = -1, None
            for i, k, own in turns:
                a, b = b, b + len(own)
                if i != last_row:
                    last_row, before = i, None
                langs = turn_languages(segs[a:b], best[a:b], sure[a:b], before)
                if langs:
                    before = max(langs, key=lambda x: sure[a + langs[x]])
                if parts:
                    out += [(ids[i], k, no, start, end, LANGS[lang], p) for no, (start, end, lang, p) in enumerate(_merged(own, best[a:b], firm[a:b], langs))]
                else:
                    found.setdefault(i, []).extend((k, lang, float(firm[a + at])) for lang, at in langs.items())
            for i, rows in found.items():
                have = {LANGS[lang] for _, lang, _ in rows}
                wrong = have != {(labels[i] or "").strip().lower()}
                out += [(ids[i], k, LANGS[lang], p, wrong) for k, lang, p in rows]
            cols = list(zip(*out)) or [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, shape)], [n for n, _ in shape])

    return df.select("id", "language", "conversation").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in shape))


def label_turns(df: DataFrame, model: Model) -> DataFrame:
    """(id, turn_no, lang, confidence, wrong) for each user, human or assistant turn and language.

    ``wrong`` holds for all rows of an example whose trimmed, lower-cased label isn't the
    one language of these turns.
    """
    return _label(df, model, False)


def label_segments(df: DataFrame, model: Model) -> DataFrame:
    """(id, turn_no, segment_no, start, end, lang, confidence): the stretches of one language of each turn, as places in its content."""
    return _label(df, model, True)
