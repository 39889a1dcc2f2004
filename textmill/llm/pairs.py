"""Problem 6: defective prompt and response pairs.

Ordered rules, each of which may add a defect: emptiness, abrupt endings (unclosed
brackets or code, a dangling comma or function word, a word that is cut), refusals in
six languages, copies of the question, and an answer in none of the question's languages.

Whether a last word is whole can't be told from one text. Words that end sentences are
counted over all texts of the table; an unpunctuated last word that never ends a
sentence, or only as the beginning of a far more frequent one, is cut.

Defined results: a null or blank answer is ``empty`` and nothing else; a null or blank
question gives no row; a pair may have several defects; repeated rows give the same rows
once; whole texts of any length are read; empty tables give empty results; only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.llm import lang
from textmill.llm.lookalike import canonical
from textmill.session import cut

# Words that can't end a sentence.
DANGLING = frozenset(
    """a an the of to in on at by for from with without into onto over under about as than that which who whose whom where when while because although if and or but nor so is are was were be been being has have had do does did will would can could shall should may might must not very more most such its their our your my his her this these those between among through during before after until since per via
    le la les un une des du de d' l' à au aux en dans par pour avec sans sur sous chez vers et ou mais donc que qui dont où si est sont était étaient être a ont ce cette ces son sa ses leur leurs mon ma mes notre votre plus très ne se s' qu'
    der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass ob wenn zu zum zur im in an am auf aus bei mit nach von vom vor für über unter durch gegen ohne um als sehr
    el los las uno una unos unas del al con sin sobre entre hacia hasta desde y o u e pero porque que quien cuyo donde cuando como si es son era eran ser ha han su sus este esta estos estas muy más no se lo
    في من إلى على عن مع بين أن إن التي الذي الذين كان كانت يكون تكون هو هي و أو ثم لكن لأن حتى إذا عند عندما قبل بعد دون هذا هذه ذلك تلك كل بعض ما لا لم لن قد سوف حيث مثل غير اللي عشان لو بس ده دي""".split()
)
_APOS = "['’`´ʼ]"
# Ways to decline, by language.
_REFUSE = (
    rf"\b(?:can ?not|can{_APOS}?t|could not|couldn{_APOS}?t|won{_APOS}?t|will not|am not able to|{_APOS}m not able to|am unable to|{_APOS}m unable to|unable to|must not|may not|am not allowed to|{_APOS}m not allowed to|not permitted to) (?:be able to )?(?:help|assist|answer|respond|reply|discuss|provide|give|go into|comment|advise|talk|do|comply|fulfil|fulfill|engage|support|offer|say|share|continue)",
    r"\b(?:must|have to|need to) (?:decline|refuse|pass|abstain|leave alone)\b", r"\b(?:a subject|a topic|something) i (?:have to|must) (?:leave alone|decline|avoid)", rf"i(?: would|{_APOS}d) rather not\b", rf"i(?: do not|{_APOS}m not| am not| don{_APOS}t) (?:feel )?comfortable",
    r"\bno (?:answer|reply|response|comment|information)\b[^.!?]{0,80}\b(?:can|could|may) be (?:given|offered|provided|made)", r"\b(?:outside|beyond|against) (?:of )?(?:my|what i)\b", r"\bgoes beyond what i am\b", r"is not something i (?:do|can|am)\b", rf"is something i (?:won{_APOS}?t|can{_APOS}?t|cannot|will not)\b", r"\b(?:instructions|guidelines|rules|policy|policies) (?:keep|prevent|forbid|stop|do not allow|don.t allow|prohibit)", r"would not be right for me\b", r"\bi (?:decline|refuse) to\b", r"\bnot in a position to\b",
    r"\bne (?:peux|puis|pourrai|pourrais|saurais|suis pas autorisé|suis pas en mesure)\b[^.!?]{0,20}(?:pas|aider|répondre)?", r"\bm.est (?:impossible|interdit)\b", r"\bpréfère ne pas\b", r"\brefuse de\b", r"\bpas (?:autorisé|en mesure|le droit)\b", r"\bhors de (?:mon|mes)\b", r"\bje dois (?:décliner|refuser)\b", r"\bregret de ne\b", r"\bje ne (?:donne|réponds|souhaite|veux) (?:pas|rien)\b",
    r"\bno (?:puedo|podré|podría|me es posible|estoy autorizad[oa]|me está permitido|estoy en condiciones|quiero|debo)\b", r"\bprefiero no\b", r"\bme niego a\b", r"\bdebo (?:declinar|rechazar|negarme)\b", r"\bfuera de (?:mi|mis)\b", r"\bme resulta imposible\b", r"\bno tengo permitido\b",
    r"\b(?:kann|darf|möchte|will|könnte|werde)\b[^.!?]{0,60}\b(?:nicht|nichts|keine?n?)\b[^.!?]{0,40}\b(?:helfen|beantworten|antworten|sagen|unterstützen|geben|sprechen|beitragen|äußern|dienen)", r"\b(?:nicht|keine) (?:in der lage|befugt|berechtigt|möglich)\b", r"\bmuss\b[^.!?]{0,40}\bablehnen\b", r"\baußerhalb mein", r"\blehne (?:ich )?ab\b", r"\bist mir (?:leider )?(?:nicht erlaubt|untersagt|unmöglich)\b",
    r"\bmesh (?:ha2dar|2ader|hayenfa3|masmoo7|masmo7)\b|\bma(?:2|q)darsh\b|\bm2darsh\b|\bmayenfa3sh\b",
)
# Ways to decline in Arabic script.
_REFUSE_ARABIC = (
    r"لا (?:أستطيع|يمكنني|أقدر|يُ?سمح لي|يحق لي|أملك|أرغب|أجيب|أود)", r"(?:لن|لم) (?:أتمكن|أستطيع|أقدر)", r"ليس (?:من صلاحيا?تي|بإمكاني|بوسعي|مسموحا?ً?ا? لي|لدي)", r"(?:أمتنع|أعتذر) عن", r"(?:يجب|علي|عليّ) (?:علي )?(?:أن )?أرفض", r"أرفض", r"خارج (?:نطاق|حدود|صلاحيا)", r"أفضّ?ل (?:عدم|ألا|أن لا)", r"غير (?:مسموح|مخو[ّ]?ل|قادر)",
    r"(?:مش|مو|ما) (?:هقدر|حقدر|قادر|بقدر|أقدر|اقدر|فيني|رح أقدر|راح أقدر|مسموح|من حقي|ينفع)", r"مقدرش|ماقدرش|مينفعش|ما ?بقدر|ما ?فيني", r"بر[ّ]?ه اللي أقدر|برا اللي أقدر",
)


def _one_of(patterns: tuple[str, ...]) -> re.Pattern:
    """One pattern; those that begin at a word boundary share it, so that other places are passed over at once."""
    edge = [x[2:] for p in patterns for x in _branches(p) if x.startswith(r"\b")]
    free = [x for p in patterns for x in _branches(p) if not x.startswith(r"\b")]
    return re.compile("|".join([*([rf"\b(?:{'|'.join(edge)})"] if edge else []), *free]))


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside its groups."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(pattern):
        if c in "([" and pattern[i - 1 : i] != "\\":
            depth += 1
        elif c in ")]" and pattern[i - 1 : i] != "\\":
            depth -= 1
        elif c == "|" and not depth:
            out.append(pattern[begin:i])
            begin = i + 1
    return [*out, pattern[begin:]]


_LATIN_REFUSAL, _ARABIC_REFUSAL = _one_of(_REFUSE), _one_of(_REFUSE_ARABIC)


def refusing(text: str) -> re.Match | None:
    """The first way to decline in a lower-cased text; each script has its own."""
    a = _ARABIC_REFUSAL.search(text) if not text.isascii() and lang._AR.search(text) else None
    b = _LATIN_REFUSAL.search(text) if lang._LA.search(text) else None
    return min((m for m in (a, b) if m), key=lambda m: m.start(), default=None)


# What may stand beside a refusal without giving anything.
FILLER = re.compile(
    r"^(?:(?:i(?:'|’)?m )?sorry|my apologies|apologies|unfortunately|thank(?:s| you)\b|please (?:ask|contact|consult|see|speak|talk|try)|is there (?:something|anything)|let us|feel free|i (?:understand|hope|appreciate)|as an? (?:ai|assistant)|(?:je suis )?désolé|merci|veuillez|y a-t-il|avez-vous|lo siento|gracias|por favor|perdón|hay algo|puedo ayudar|tut mir|es tut|leider|danke|bitte|entschuldig|gibt es|kann ich sonst|"
    r"شكر|آسف|عذر|للأسف|معلش|سامحن|هل (?:لديك|هناك|يمكن|تريد|ترغب)|عايز حاجة|محتاج حاجة|بدك شي|تبي شي|يرجى|ويرجى|اسأل|الرجاء|أشكرك|أتفهم|تحب|في حاجة|أي خدمة|وشكر|والله)"
)
_LATER = re.compile(r"sorry for the (?:delay|wait)|apologies for the (?:delay|wait)|désolée? pour (?:l.attente|le retard)|perdón por la espera|entschuldigung für die (?:wartezeit|verspätung)|على التأخير|here is the|voici la|aquí está|hier ist|إليك|ده الكلام")
_SPLIT = re.compile(r"(?<=[.!?؟…])[\"”»')\]]*\s+|\n+")
_BUT = re.compile(r"\b(?:but|however|yet|mais|cependant|pero|aber|jedoch)\b|لكن|غير أن|بس ")
_QUOTE = re.compile(r"\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”|«[^»\n]{0,200}»|„[^“”\n]{0,200}[“”]|‘[^’\n]{3,200}’")
_WORD = re.compile(r"[^\W_]+(?:[ً-ْٰ̀-ͯ][^\W_]*)*", re.UNICODE)
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_MARKS = re.compile("[ً-ْٰـ]")
_ENDS = re.compile(r"[.!?؟…。][\"'”»’)\]*_`]*$")
_LATIN_NAME = re.compile(r"^[A-Z][a-z]+$")
# Names of the languages, as a question may ask for one.
ASKED = {
    "en": r"english|anglais|englisch|inglés|الإنجليزية|الانجليزية|انجليزي|إنجليزي|الإنكليزية",
    "ar": r"arabic|arabe|arabisch|árabe|العربية|بالعربي|عربي|egyptian|levantine|gulf|dialect|المصرية|الفصحى|المصري",
    "fr": r"french|français|französisch|francés|الفرنسية|فرنسي",
    "de": r"german|allemand|deutsch|alemán|الألمانية|ألماني",
    "es": r"spanish|espagnol|spanisch|español|castellano|الإسبانية|إسباني",
}
_ASK = {k: re.compile(rf"(?:{v})\b", re.IGNORECASE) for k, v in ASKED.items()}
_ANY = re.compile(r"\w")
_PAREN = re.compile(r"\([^()]*\)")


def _plain(text: str) -> list[str]:
    text = text.lower()
    return _PLAIN_WORD.findall(text) if text.isascii() else _WORD.findall(_MARKS.sub("", text))


def is_empty(answer: str | None) -> bool:
    return answer is None or not _ANY.search(answer) or lang.is_stand_in(answer)


def is_refusal(answer: str) -> bool:
    """Declines and gives nothing: every sentence is a refusal or a filler, and one is a refusal."""
    if "```" in answer:
        return False
    refused = False
    for s in sorted(_SPLIT.split(answer), key=len):  # every sentence must pass, and short ones are told soonest
        s = s.strip(" \t-*•\"'“”")
        if not _ANY.search(s):
            continue
        low = s.lower()
        bare = _QUOTE.sub(" ", low)
        m = refusing(bare)
        if m and not _LATER.search(bare):
            # a refusal of one thing that goes on to give another
            rest = bare[m.end() :]
            turn = _BUT.search(rest)
            if turn and len(rest[turn.end() :].split()) >= 3 and not refusing(rest[turn.end() :]):
                return False
            refused = True
        elif _LATER.search(bare) or not FILLER.match(low) or len(low.split()) > 14:
            return False
    return refused


def is_copy(question: str, answer: str) -> bool:
    """Nothing but the question: hardly a word of the answer is not the question's, in about its order."""
    q, a = _plain(question), _plain(answer)
    if not q or not a or len(a) < 3 and len(q) > 4:
        return False
    m = re.match(r"\s*([^:\n]{1,40}?)\s*[:：]\s+(?=\S)", answer)
    if m and len(m[1].split()) <= 4:
        a = _plain(answer[m.end() :]) or a
    have: dict[str, int] = {}
    for w in q:
        have[w] = have.get(w, 0) + 1
    pairs = set(zip(q, q[1:]))
    new = sum(w not in have for w in a)
    fit = sum(p in pairs for p in zip(a, a[1:])) / max(len(a) - 1, 1)
    if new > 0.15 * len(a) or fit < 0.6:
        return False
    # one sentence of a longer question may also be an answer: the copy must hold most of what was asked last
    last = _plain(_SPLIT.split(question.strip())[-1])
    return len(set(a) & set(last)) >= 0.6 * len(set(last)) or len(set(a) & set(q)) >= 0.7 * len(set(q))


def cut_off(answer: str) -> tuple[bool, str | None]:
    """Whether the answer stops abruptly, or else the last word to look up."""
    t = answer.rstrip()
    if t.count("```") % 2:
        return True, None
    if t.endswith("```"):
        return False, None
    body = re.sub(r"```.*?```", " ", t, flags=re.DOTALL) if "```" in t else t
    body = body.rstrip()
    if not body:
        return False, None
    line = body.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:\d+[.)]|[-*•])", line) and "\n" in body:
        return True, None
    if body[-1] in ",،;؛([{<«“„/\\&=+–—-:" and not re.search(r"[:;]-?[)(]$", body):
        return True, None
    for a, b in ("()", "[]", "{}", "«»", "“”"):
        n = body.count(a) - body.count(b)
        if n > 0 and body.rfind(a) > body.rfind(b) and (a != "“" or "„" not in body) and not re.search(r"[:;]-?\($", body):
            return True, None
    if _ENDS.search(body):
        return False, None
    last = body.split()[-1]
    if any(c.isdigit() or c in "@/_<>" for c in last) or last[-1] in "\"'”»’)]*`!?%°€$£":
        return False, None
    words = _WORD.findall(last)
    if not words:
        return False, None
    w = words[-1].lower()
    if w in DANGLING and len(body.split()) > 2:
        return True, None
    if len(body.split()) < 2:
        return False, None
    # Names, and short answers such as "Only in winter", are cut only if their last word is the beginning of another.
    doubtful = (words[-1][:1].isupper() and words[-1].isascii() and len(words[-1]) > 2) or len(body.split()) <= 5
    return False, ("^" if doubtful else "") + w


def _group(x: int) -> str:
    return "ar" if x in lang.ARABIC else lang.LANGS[x]


def languages(model: lang.Model, texts: list[list[tuple[str, bool]]]) -> list[set[str]]:
    """The languages of texts given as stretches; ``ar`` and ``ar-dialect`` are one."""
    segs = [s for own in texts for s in own]
    best, sure = lang.classify(model, segs)
    out, at = [], 0
    for own in texts:
        out.append({_group(int(best[i])) for i in range(at, at + len(own)) if sure[i] >= 0.6})
        at += len(own)
    return out


def stretches(text: str | None) -> list[tuple[str, bool]]:
    return [s for s in lang.segments(text) if lang.words(s[0]) >= 3] if text and not lang.is_stand_in(text) else []


def foreign(model: lang.Model, questions: list[str], answers: list[str | None]) -> list[bool]:
    """For each pair whether no part of the answer is in a language of the question or one it asks for."""
    out = [False] * len(questions)
    # Sentences of Arabic script on both sides settle most pairs at once.
    open_ = [i for i, (q, a) in enumerate(zip(questions, answers)) if a and not (lang._AR.search(a) and lang._AR.search(q) and not lang._LA.search(a))]
    q, a = [stretches(questions[i]) for i in open_], [stretches(answers[i]) for i in open_]
    # One stretch of either side in one language settles a pair; the others are read whole.
    heads = zip(languages(model, [x[:2] for x in q]), languages(model, [x[:2] for x in a]))
    left = [k for k, (x, y) in enumerate(heads) if not x & y and q[k] and a[k]]
    for k, have, given in zip(left, languages(model, [q[k] for k in left]), languages(model, [a[k] for k in left])):
        if have and given and not have & given:
            asked = _PAREN.sub(" ", questions[open_[k]])
            out[open_[k]] = not any(_ASK[g].search(asked) for g in given)
    return out


RESULT = T.StructType([
    T.StructField("empty", T.BooleanType()), T.StructField("truncated", T.BooleanType()), T.StructField("refusal", T.BooleanType()),
    T.StructField("copied", T.BooleanType()), T.StructField("other_language", T.BooleanType()), T.StructField("last", T.StringType()),
])


def check_udf(table):
    """The rules for a batch of (question, answer); ``table`` broadcasts the weights of the language model."""

    @F.pandas_udf(RESULT)
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = lang.Model(table.value)
        for q, a in batches:
            qs, as_ = [canonical(x) for x in q.fillna("")], [None if x is None else canonical(x) for x in a]
            rows = []
            for x, y in zip(qs, as_):
                if is_empty(y):
                    rows.append((True, False, False, False, None))
                    continue
                cut, last = cut_off(y)
                rows.append((False, cut, is_refusal(y), is_copy(x, y), last))
            other = foreign(model, qs, [None if r[0] else y for r, y in zip(rows, as_)])
            e, t, r, c, w = zip(*rows) if rows else ((), (), (), (), ())
            yield pd.DataFrame({"empty": e, "truncated": t, "refusal": r, "copied": c, "other_language": other, "last": w})

    return check


END_WORD = r"(?<![\p{L}\p{M}])([\p{L}\p{M}]+)[\"'”»’)]*[.!?؟…](?=\s|$)"
RARE = 20


def sentence_ends(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): how often each word ends a sentence, over all texts."""
    w = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(END_WORD), F.lit(1))).alias("w"))
    return cut(w.groupBy(F.lower(F.regexp_replace("w", r"[\x{64B}-\x{652}\x{670}]", "")).alias("word")).agg(F.count("*").alias("n")))  # read twice


def defects(pairs: DataFrame, texts: DataFrame, model: lang.Model) -> DataFrame:
    """(key columns, defect) of pairs with ``question`` and ``answer``; all other columns of ``pairs`` are keys.

    ``texts`` (column ``text``) holds the texts whose sentence ends are counted.
    """
    keys = [c for c in pairs.columns if c not in ("question", "answer")]
    table = pairs.sparkSession.sparkContext.broadcast(model.table)  # of fixed size
    found = pairs.where(F.col("question").rlike(r"[\p{L}\p{N}\p{P}\p{S}]")).withColumn("r", check_udf(table)("question", "answer")).select(*keys, "r.*")
    found = found.withColumn("doubtful", F.col("last").startswith("^")).withColumn("last", F.regexp_replace("last", r"^\^|[\x{64B}-\x{652}\x{670}]", ""))
    ends = sentence_ends(texts, "text")
    # for each beginning of a word: the most frequent longer word that ends sentences
    longer = ends.where("n >= 2 and length(word) > 1").select(F.expr("explode(transform(sequence(1, length(word) - 1), k -> substring(word, 1, k)))").alias("word"), "n")
    longer = longer.groupBy("word").agg(F.max("n").alias("n_longer"))
    known = ends.join(longer, "word", "full").withColumnRenamed("word", "last")
    # answers without a word to look up are spread over keys that no word has, so that they don't meet on null
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("string"))
    found = found.withColumn("k", F.coalesce("last", spread)).join(known.withColumnRenamed("last", "k"), "k", "left")
    whole = F.coalesce(F.col("n"), F.lit(0))
    cut_word = F.col("last").isNotNull() & (((whole == 0) & (~F.col("doubtful") | F.col("n_longer").isNotNull())) | (F.coalesce("n_longer", F.lit(0)) > RARE * whole))
    flags = F.filter(
        F.array(
            F.when(F.col("empty"), F.lit("empty")),
            F.when(F.col("truncated") | cut_word, F.lit("truncated")),
            F.when(F.col("refusal"), F.lit("refusal")),
            F.when(F.col("copied"), F.lit("copied")),
            F.when(F.col("other_language"), F.lit("other_language")),
        ),
        lambda x: x.isNotNull(),
    )
    return found.select(*keys, F.explode(flags).alias("defect")).distinct()


def memory_pairs(items: DataFrame) -> DataFrame:
    return items.where("id is not null").select(F.lit("memory_items").alias("tbl"), F.col("id").cast("string").alias("id"), F.lit(0).alias("turn_no"), "question", "answer")


def conversation_pairs(examples: DataFrame) -> DataFrame:
    """User turns directly before an assistant turn, with both texts."""
    role: Column = F.expr("transform(conversation, t -> lower(trim(coalesce(t.role, ''))))")
    rows = examples.where("id is not null and size(conversation) > 1").withColumn("_r", role)
    at = F.expr("filter(sequence(0, size(conversation) - 2), i -> _r[i] in ('user', 'human') and _r[i + 1] = 'assistant')")
    rows = rows.select(F.col("id").cast("string").alias("id"), "conversation", F.explode(at).alias("turn_no"))
    return rows.select(F.lit("instruction_examples").alias("tbl"), "id", "turn_no", F.expr("conversation[turn_no].content").alias("question"), F.expr("conversation[turn_no + 1].content").alias("answer"))
