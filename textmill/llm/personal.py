"""Problem 2: personal information in free text, by aggregated weak labelers.

Candidates are wide: any run of capitalised words and whatever stands behind a word that
introduces a person, any @, any street, any number of six digits. Regex, gazetteer and
context labelers each vote for, against or not at all on a candidate. The vote patterns,
counted over all rows, go to expectation-maximisation, which estimates how reliable each
labeler is without labelled data; its posteriors train a logistic span classifier for
each kind, which decides. The counts are one row for each pattern, so that the fit needs
no sample and no text leaves the executors. Candidates that no labeler votes for are
counted, not written; if the classifier accepts such a pattern all the same, the texts
are read a second time for them.

Defined results: null and empty text has no spans; of overlapping spans the first of
e-mail, address, identity number, phone and name wins; whole texts are read; repeated
rows give the same rows once; an empty gazetteer leaves the context labelers; empty
tables give empty results; extra columns of the input aren't read; a gazetteer of more
than ``MAX_NAMES`` rows, which couldn't be sent to every worker, is an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.session import cut

MAX_NAMES = 2_000_000
DOUBT = 0.05  # least share of true names that the gazetteer may miss: none is complete
KINDS = ("email", "address", "id_number", "phone", "name")

_LOCAL = r"[\w.+%-]+"
_HOST = r"[A-Za-z0-9](?:[\w-]*)"
EMAIL = re.compile(
    rf"(?P<plain>{_LOCAL}[@＠﹫]{_HOST}(?:\.[A-Za-z0-9-]+)+)"
    rf"|(?P<spaced>{_LOCAL} ?[@＠] ?{_HOST}(?: ?\. ?[A-Za-z0-9-]+)+"
    rf"|{_LOCAL} ?(?:\(at\)|\[at\]|\{{at\}}) ?{_HOST}(?: ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}| dot ) ?[A-Za-z0-9-]+)+"
    rf"|{_LOCAL} at {_HOST}(?: dot [A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)?)+)",
    re.IGNORECASE,
)
ANY_AT = re.compile(r"[^\s@＠﹫]*[@＠﹫][^\s@＠﹫]+")
# Kinds of streets.
_STREET_EN = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Square|Sq|Terrace|Place|Way|Close|Crescent|Row|Walk|Hill|Gardens|Quay)"
_NUM = r"\d{1,5}(?: ?[A-Za-z](?![\w]))?(?: ?[-–/] ?\d{1,5})?"
_NAMED = r"(?:[A-ZÀ-Þ][\w'’-]+ ){1,3}"
ADDRESS = re.compile(
    rf"(?:(?:Apt|Apartment|Flat|Suite|Unit)\.? ?\w{{1,5}}, )?\b{_NUM},? {_NAMED}{_STREET_EN}\b\.?(?:, ?(?:Flat|Apt|Apartment|Suite|Unit|Floor)\.? ?\w{{1,5}})?"
    rf"|\bP\.? ?O\.? ?Box (?:no\.? ?)?\d{{1,8}}|\b(?:Postfach|Boîte postale|B\.?P\.?|Apartado(?: de correos)?|Casilla) \d{{2,8}}"
    rf"|\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|weg|platz|gasse|allee|ufer|damm)[ ,]+\d{{1,5}} ?[a-z]?\b|\b{_NUM} [A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse)\b"
    rf"|\b\d{{1,5}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|route)(?: (?:de|du|des|la|le|l'))* ?[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?"
    rf"|\b(?:calle|avenida|avda\.?|plaza|paseo|camino|carrera|c/)(?: (?:de|del|la|las|los|el))* [A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?,? (?:n\.?º ?)?\d{{1,5}}\b"
    rf"|(?:عمارة|عماره|مبنى|منزل|فيلا|بناية|شقة) ?\d{{1,5}}(?:[ ،,]+(?:شقة|الدور|الطابق|دور) ?\d{{1,4}})*[ ،,]+(?:شارع|ش\.?|طريق|حي|ميدان) ?[^\W\d_]+(?: ال[^\W\d_]+)?"
    rf"|(?:شقة \d{{1,4}}[ ،,]+)?\d{{1,5}}[ ،,]+(?:شارع|ش\.?|طريق|ميدان) [^\W\d_]+(?:[ ،,]+(?:شقة|الدور|الطابق|دور) ?\d{{1,4}})*|(?:شارع|طريق|ميدان) [^\W\d_]+(?: ال[^\W\d_]+)?[ ،,]+(?:رقم|عمارة|مبنى|منزل|بناية) ?\d{{1,5}}(?:[ ،,]+(?:شقة|الدور) ?\d{{1,4}})*"
    rf"|(?:صندوق بريد|صندوق البريد|ص\.? ?ب\.?) ?(?:رقم )?\d{{1,8}}",
)
STREET = re.compile(rf"\b{_NAMED}{_STREET_EN}\b|\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|platz|gasse|allee)\b|\b(?:rue|calle|avenida|plaza) (?:(?:de|du|des|la|le|del) )*[A-ZÀ-Þ][\w'’-]+|(?:شارع|ميدان) [^\W\d_]+")
_TOWN = re.compile(r",? \d{4,6} [A-ZÀ-Þ][\w-]+(?: [A-Z][\w-]+)?|, [A-ZÀ-Þ][\w-]+(?: (?!The\b|It\b|In\b|We\b|You\b)[A-Z][a-z][\w-]+)?(?: \d{4,6}\b)?")
NUMBER = re.compile(r"(?<![\w@./\\-])(?:[A-Z]{2} ?\d{6,9}|(?:\+|\(\+?\d|\d)[\d ()./-]*\d)(?![\w@\\]|[.,]\d)(?: ?(?:ext|x|poste|Durchwahl)\.? ?\d{1,5})?")
_NUMBER_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zéro|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|صفر|واحد|اثنين|اثنان|إثنين|ثلاثة|تلاتة|أربعة|اربعة|خمسة|ستة|سبعة|ثمانية|تمانية|تسعة".split("|")
_SPELLED_WORD = f"(?:{'|'.join(_NUMBER_WORDS)})"
LEAST_SPELLED = 6
SPELLED = re.compile(rf"\b{_SPELLED_WORD}(?:[ ,،-]+{_SPELLED_WORD}){{5,}}\b", re.IGNORECASE)
# Words around numbers.
PHONE_WORDS = re.compile(r"\b(?:phone|tel|call|calls|text me|mobile|cell|ring|fax|whatsapp|number is|telefon|téléphone|teléfono|appelez|llame|móvil|nummer|rufen|anrufen|portable)\b|هاتف|الهاتف|جوال|موبايل|محمول|تليفون|تلفون|كلم|اتصل|واتساب", re.IGNORECASE)
ID_WORDS = re.compile(r"\b(?:passport|pasaporte|passeport|reisepass|national id|identity|id (?:card|number|no)|my id|ssn|social security|tax|insurance number|ausweis\w*|steuer\w*|personalausweis|dni|nie|nif|carte d.identité|numéro (?:fiscal|de sécurité)|sécurité sociale|seguridad social|identidad|identificación|sozialversicherung\w*)\b|الهوية|هوية|القومي|جواز|البطاقة|بطاقة|ضريبي|الضريبي|التأمين", re.IGNORECASE)
OTHER_WORDS = re.compile(r"\b(?:order|ticket|batch|page|build|version|ratio|run|rows|row|commit|model card|release|invoice no|log|port|line|lines|room|floor|max_tokens|top_k|size|limit|id=|between|and|counted|use|says|isbn|sku|item|issue|bestellung|commande|pedido|lot)\b|الطلب|الدفعة|الصفحة|صفحة|الإصدار|النسبة|الخطأ|الطابق|القاعة|تذكرة|يوم|السطر", re.IGNORECASE)
ID_AFTER = re.compile(r"^\W*(?:was issued|belongs to|is mine|حسب البطاقة|باسم|عشان تسجلوه)")
ID_SHAPE = re.compile(r"\d{2}/\d{7}/\d|\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{6,9}|\d{14}|\d \d{6} \d{2} \d{4} \d|\d{9}|\d{12,13}|\d{1,3}(?:\.\d{3}){2}-?[\dA-Z]")
NOT_NUMBER = re.compile(r"\d{4}-\d{2}-\d{2}(?: \d{2})?.*|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,3}(?:\.\d{1,3}){3}|\d+\.\d+|\d+\.\d+\.\d+|\d{15,}|\d{4}-\d{4}-\d{2}|\d{4} \d{3}|\d{1,6}|\d-\d{1,5}|\d{1,4} ?[-–] ?\d{1,4}")
ORDER_SHAPE = re.compile(r"\d{4}-\d{4}-\d{2}|\d{4} \d{3}|\d{4}-\d{2}-\d{2}(?: \d{2})?")
PHONE_SHAPE = re.compile(r"(?:\+|00)[1-9]\d?.*|\(0?\d{2,4}\).*|0\d(?:\D?\d){7,}|1800 .*|\d{3}[-. ]\d{4}(?: ?(?:ext|x)\.? ?\d+)?|\d{3}[-. ]\d{3}[-. ]\d{4}|[2-9]\d{9}")
_ASCII_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_LONG = re.compile(r"\d(?:[ ()./-]{0,3}\d){5}")
_EXT = re.compile(r"^(?:ext|x|poste|Durchwahl)", re.IGNORECASE)

# What stands before a name.
_CTX_LATIN = r"(?:(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Herrn|Madame|Monsieur|Mme|Señora?|Don|Doña|Sr|Sra)\.?|[Mm]y name is|I(?:'|’)m|I am|[Aa]sk for|spoke with|met with|belongs to|Regards,|Thanks,|Cheers,|Sincerely,|Best,|Contact:|Je m(?:'|’)appelle|chez|[Ii]ch heiße|Me llamo|Atentamente,|Saludos,|Cordialement,|Grüßen,|Grüße,|geht an|(?:invoice|parcel|letter) to|is with|number of|passport of|use for|Where does|signs it, or)"
_CTX_ARABIC = r"(?:اسمي|إسمي|اسمه|اسمها|باسم|(?:ب|ل|و)?(?:ال)?سيدة?|الأستاذة?|الدكتورة?|الشيخ|مع التحية،|تحياتي،|قابلت|سلم(?:لي)? على|موبايل|لـ|أنا|هوية|هاتف|بريد|يسكن|تسكن|عند|مع)"
STRONG_ARABIC = re.compile(r"(?:اسمي|إسمي|باسم|سيدة?|الأستاذة?|الدكتورة?|التحية،|قابلت|على|موبايل)$")
_AR_CTX_END = re.compile(_CTX_ARABIC + "$")
NOT_NAMES = frozenset("the a an i it in on at to of and or but we you he she they this that these those most some each nobody about when if try there what which who how why can could would please give thanks thank ask call send sarah mon mit wie was der die das ich wir le la les je nous el los mi por para".split())


TAIL, GIVEN, FAMILY, CONTEXT, PLACE, AT, WORDS = (1 << i for i in range(7))
_ARABIC_ANCHORS = "اسمي |إسمي |اسمه |اسمها |باسم |السيد |السيدة |بالسيد |بالسيدة |للسيد |سيدة |الأستاذ |الأستاذة |الدكتور |الدكتورة |الشيخ |التحية، |تحياتي، |قابلت |سلملي على |سلم على |موبايل |لـ |لـ|أنا |هوية |هاتف |بريد |يسكن |تسكن ".split("|")
_PLACE_ANCHORS = ("street", " st", "avenue", " ave", "road", " rd", "lane", " ln", "court", " ct", "drive", " dr", "boulevard", "blvd", "square", "terrace", "place", " way", "close", "crescent", " row", " walk", " hill", "gardens", "quay", "box", "postfach", "postale", "b.p", "bp ", "rue", "عمارة", "عماره", "مبنى", "منزل", "فيلا", "بناية", "شقة", "صب", "ص.ب", "ص. ب", "حي", "apartado", "casilla", "straße", "strasse", "weg", "platz", "gasse", "allee", "ufer", "damm", "rue ", "chemin", "impasse", "allée", "quai", "route", "calle", "avenida", "avda", "plaza", "paseo", "camino", "carrera", "c/", "شارع", "ش ", "ش.", "طريق", "ميدان", "صندوق", "ص.ب", "ص. ب", "ص ب", "حي ")


# Unicode capitals of the Latin script, and names built of them: O'Brien, Łucja Nowak, Nguyễn Văn An, Ana de la Cruz.
_UP = "".join(c for c in map(chr, [*range(0x41, 0x250), *range(0x1E00, 0x1F00)]) if c.isupper())
_TOKEN = rf"[{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*"
# What may stand between the words of a name.
_PARTICLE = r"(?:(?:de|da|del|della|van|von|den|der|bin|ibn|al|el|la|le|di|dos|du|y) ){0,2}"
OPEN = re.compile(rf"(?<![\w@./'’-]){_TOKEN}(?: {_PARTICLE}(?:{_TOKEN}|[{_UP}]\.)){{0,3}}(?![\w@])")
_WORD_AHEAD = re.compile(r"([^\W\d_]+\.?)(?:\s+|$)")
# Words that lead to a name and are no part of it.
LEADS = frozenset("contact ask call meet dear hi hello hey thanks tell email write mr mrs ms miss dr prof professor herr herrn frau madame monsieur mme señor señora don doña sr sra kontakt liebe lieber hallo bonjour cher chère hola estimado estimada querido querida regards".split())
_CTX_BEFORE = re.compile(rf"(?:{_CTX_LATIN}|\b(?:name is|named|met|meet|contact|dear|hello|hi|signed|m(?:'|’)appelle|s(?:'|’)appelle|nom est|rencontré|contactez|heißt|heiße|Name ist|getroffen|kontaktieren|llamo|llama|nombre es|conocí a|contacte a)[,:]?)\s+$")
_TITLE_BEFORE = re.compile(r"\b(?:(?:Mrs|Mr|Ms|Dr|Prof|Sra?)\.?|Miss|Professor|Herrn?|Frau|Madame|Monsieur|Mme|Señora?|Doña|Don)\s+$")
# What stands before places and things, and behind them.
_PLACE_BEFORE = re.compile(r"(?:^|\s)(?:in|at|from|near|the|to|on|through|around|across|via|der|die|das|im|am|nach|aus|bei|le|la|les|à|au|du|dans|el|los|las|en|hacia|une?|an?)\s+$", re.IGNORECASE)
_THING_AFTER = re.compile(r" (?:Street|St|Road|Rd|Avenue|Ave|Lane|Court|Drive|Square|Bay|River|Lake|Library|Museum|School|University|Station|Park|Market|Bridge|Workshop|Garden|Kitchen|Reader)\b|[:@/_]|-?\d")
_PERSON_AFTER = re.compile(r"(?:['’]s)? (?:said|says|wrote|writes|called|asked|lives|works|told|phoned|will call|a dit|habite|sagte|wohnt|dijo|vive|(?:phone|number|email|e-mail|address|passport)\b)")
# Capitalised words that are no names: days, months, languages, and what texts and programs begin with.
COMMON = frozenset(
    """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december english arabic french german spanish
    montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember deutsch englisch lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo
    internet python java sql api html css json okay ok yes no sure note example summary step question answer hello sorry""".split()
)


class Names:
    """What the gazetteer tells: listed names, and beginnings and endings that names are built of."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        self.listed = {(p, n.lower()) for n, p, _ in rows}
        self.given = {n.lower() for n, p, s in rows if p == "given"}
        self.family = {n.lower() for n, p, s in rows if p == "family"}
        alt = lambda xs: "|".join(sorted(map(re.escape, xs), key=lambda x: (-len(x), x))) or r"(?!x)x"
        parts = {}
        self._tails: dict[str, set[str]] = {}
        for part in ("given", "family"):
            words = [n.lower() for n, p, s in rows if p == part and s == "latin"]
            heads, tails = Counter(), Counter()
            for w in words:
                for k in range(2, len(w) - 2):
                    heads[w[:k]] += 1
                    tails[w[k:]] += 1
            # A split counts if both sides occur in several names.
            built = Counter()
            for w in words:
                good = [(min(heads[w[:k]], tails[w[k:]]), -abs(k - len(w) / 2), w[:k], w[k:]) for k in range(2, len(w) - 2) if heads[w[:k]] >= 2 and tails[w[k:]] >= 2 and len(w[k:]) >= 3]
                if good:
                    best = max(good)
                    built[("h", best[2])] += 1
                    built[("t", best[3])] += 1
            self._tails[part] = {x for (k, x), n in built.items() if k == "t" and n >= 2}
            parts[part] = f"(?:{alt({x for (k, x), n in built.items() if k == 'h'})})(?:{alt({x for (k, x), n in built.items() if k == 't' and n >= 2})})"
        given = f"(?:{parts['given']}|{alt({n.lower() for n, p, s in rows if p == 'given' and s == 'latin'})})"
        family = f"(?:{parts['family']}|{alt({n.lower() for n, p, s in rows if p == 'family' and s == 'latin'})})"
        family = f"{family}(?:-{family})?"
        self.latin = re.compile(rf"\b(?P<g>{given})\b(?P<i> [A-Z]\.)?(?P<f>[ \t]{family}\b|(?(i)(?: [A-Z][\w-]+)?))?|\b(?P<only>{family})\b", re.IGNORECASE)
        ar_given = alt({n for n, p, s in rows if p == "given" and s == "arabic"})
        ar_family = [n for n, p, s in rows if p == "family" and s == "arabic"]
        ends = Counter(n[-3:] for n in ar_family)
        end = alt({e for e in ends} | {"اني", "اوي"}) if ar_family else "اني|اوي"
        self.ar_tail = re.compile(rf"^ال[^\W\d_]{{3,}}(?:{end})$")
        self.ar_given = {n for n, p, s in rows if p == "given" and s == "arabic"}
        self.ar_family = set(ar_family)
        self.tails = {x for part in ("given", "family") for x in self._tails[part]} | {n.lower() for n, p, s in rows if s == "latin" and not any(n.lower().endswith(x) for x in self._tails[p])}
        self.flags = self._automaton()
        self.ar_context = re.compile(rf"(?P<c>{_CTX_ARABIC}) ?(?<=[\sـ])(?P<n>\w{{3,}})(?P<s> ال\w{{4,}})?")

    def _automaton(self):
        """One pass tells which of the patterns can match at all, and where Arabic names and their contexts stand."""
        import ahocorasick

        words: dict[str, int] = {}

        def put(flag: int, xs) -> None:
            for x in xs:
                words[x] = words.get(x, 0) | flag

        put(TAIL, self.tails)
        put(GIVEN, self.ar_given)
        put(FAMILY, self.ar_family)
        put(CONTEXT, _ARABIC_ANCHORS)
        put(PLACE, _PLACE_ANCHORS)
        put(AT, ("@", "＠", "﹫", "(at)", "[at]", "{at}", " dot "))
        put(WORDS, _NUMBER_WORDS)
        auto = ahocorasick.Automaton()
        for w, f in words.items():
            auto.add_word(w, (len(w), f))
        auto.make_automaton()
        return auto


def _add(out: list, taken: list, s: int, e: int, kind: str, votes: str) -> None:
    out.append((s, e, kind, votes))
    taken.append((s, e))


def _free(taken: list, s: int, e: int) -> bool:
    return not any(a < e and s < b for a, b in taken)


def candidates(text: str, names: Names) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, votes): votes is a string of +, - and 0, one place for each labeler of the kind."""
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    low = text.lower()
    if len(low) != len(text):  # places would differ; letters that change their number are kept as they are
        low = "".join(x if len(x) == 1 else c for c, x in zip(text, map(str.lower, text)))
    seen, anchors, numbers = 0, [], 0
    for end, (n, f) in names.flags.iter(low):
        seen |= f
        numbers += bool(f & WORDS)
        if f & (GIVEN | FAMILY | CONTEXT):
            anchors.append((end + 1 - n, end + 1, f))
    if seen & AT:
        for m in EMAIL.finditer(text):
            s, e = m.span()
            spaced = m["spaced"]
            while s < e and text[s] in ".-+%":
                s += 1
            before = text[max(0, s - 30) : s]
            sign = "@" in m[0] or "＠" in m[0] or "﹫" in m[0]
            url = "://" in before.split()[-1:][0] if before.split() and not before[-1:].isspace() else False
            dotted = bool(re.search(r"[.]|dot", text[s:e].split("@")[-1]))
            masked = bool(spaced) and not sign and bool(re.search(r"\(at\)|\[at\]|\{at\}|\bdot\b", m[0], re.IGNORECASE))
            shape = "+" if (sign and not spaced) or masked or (spaced and sign) else "-"
            tld = "+" if re.search(r"[A-Za-z]{2,}$", text[s:e]) and not re.search(r"\.(?:py|js|md|txt|latest)$", text[s:e]) else "-"
            ctx = "+" if re.search(r"(?:mail|reach me|write|contact|send|على|مراسل|adresse|correo|escrib|Regards|التحية|/|<|\(|\bto|:|-) ?[<(]?$", before, re.IGNORECASE) else "0"
            _add(out, taken, s, e, "email", (shape if dotted else "-") + (tld if dotted else "-") + ("-" if url else "+") + ctx)
        for m in ANY_AT.finditer(text):
            if _free(taken, *m.span()):
                out.append((*m.span(), "email", "--+0"))
    if seen & PLACE and re.search(r"\d", text):
        for m in ADDRESS.finditer(text):
            s, e = m.span()
            if not _free(taken, s, e):
                continue
            town = _TOWN.match(text, e)
            before, after = text[max(0, s - 40) : s], text[e : e + 25]
            ctx = "+" if re.search(r"(?:live at|lives at|moved to|go to|to|sent? to|chez|an|;|address|adresse|wohne|habite|vivo|,|أسكن في|ساكن في|يسكن في|إلى|العنوان هو|العنوان) ?$", before) else "0"
            neg = "-" if re.match(r"\W*(?:junction|scenes|was closed|closed|festival)", after) else "+"
            box = "+" if town else "0"
            _add(out, taken, s, town.end() if town else e, "address", "+" + ctx + neg + box)
    if seen & PLACE:
        out += [(*m.span(), "address", "-0" + ("-" if re.match(r"\W*(?:junction|scenes|was closed|closed|festival)", text[m.end() : m.end() + 25]) else "0") + "0") for m in STREET.finditer(text) if _free(taken, *m.span())]
    if _LONG.search(text):
        for m in NUMBER.finditer(text):
            s, e = m.span()
            body = m[0].strip().translate(_ASCII_DIGITS)
            n = sum(c.isdigit() for c in body)
            if n < 6 or not _free(taken, s, e):
                continue
            before, after = text[max(0, s - 42) : s], text[e : e + 30]
            tail = before[max(before.rfind(". "), before.rfind("? "), before.rfind("! "), before.rfind("؟ "), -2) + 2 :] if not before.rstrip().lower().endswith((" no.", "tel.", "ext.")) else before
            near = tail[-26:]
            idw, phw, oth = ID_WORDS.search(near), PHONE_WORDS.search(near), OTHER_WORDS.search(near)
            core = re.sub(r" ?(?:ext|x|poste|Durchwahl)\.? ?\d+$", "", body)
            id_shape, ph_shape, no = bool(ID_SHAPE.fullmatch(body)), bool(PHONE_SHAPE.fullmatch(core)), bool(NOT_NUMBER.fullmatch(core)) and core == body
            ph_shape = ph_shape and sum(c.isdigit() for c in core) >= 7 and not ORDER_SHAPE.fullmatch(core)
            no = no and not ph_shape
            last = [(w.end(), k) for k, rx in (("id", ID_WORDS), ("ph", PHONE_WORDS), ("ot", OTHER_WORDS)) for w in rx.finditer(near)]
            closest = max(last)[1] if last else ""
            after_id = bool(ID_AFTER.match(after))
            as_id = (closest == "id" and not (ph_shape and body[0] in "+(")) or (id_shape and closest != "ph" and not ph_shape) or (after_id and not ph_shape)
            if as_id:
                votes = ("+" if id_shape else "-" if no else "0") + ("+" if idw else "0") + ("+" if after_id else "0") + ("-" if closest == "ot" else "0") + ("+" if 7 <= n <= 15 else "-")
                _add(out, taken, s, e, "id_number", votes)
            else:
                list_ctx = re.search(r"(?:[;,/:]|@\S+|>|\n|\bor)\s*$", before) is not None
                votes = ("+" if ph_shape and not no else "-" if no else "0") + ("+" if phw else "0") + ("-" if closest == "ot" else "0") + ("+" if list_ctx else "0") + ("+" if 7 <= n <= 15 else "-")
                _add(out, taken, s, e, "phone", votes)
    if numbers >= LEAST_SPELLED:
        for m in SPELLED.finditer(text):
            if _free(taken, *m.span()):
                near = text[max(0, m.start() - 30) : m.start()]
                _add(out, taken, *m.span(), "phone", "+" + ("+" if PHONE_WORDS.search(near) else "0") + "0" + ("+" if re.search(r"[;,/:\n]\s*$", near) else "0") + "+")
    spans: list[tuple[int, int, str]] = []
    for m in names.latin.finditer(text) if seen & TAIL else ():
        fam_word = (m["f"] or "").strip().lower()
        word = m["g"] or m["only"]
        s, e = m.span()
        upper = word[0].isupper()
        if not upper and not (fam_word and m["i"] is None):
            continue
        ctx = _before(text, s)
        if m["only"] and ctx != "+":
            continue
        spans.append((s, e, "+" + ("+" if fam_word else "0") + ctx + _after(text, e) + "0" + _titled(text, s) + ("+" if upper else "0")))
    covered = [(a, b) for a, b, _ in spans]
    for m in OPEN.finditer(text):
        s, e, led = _trim(text, *m.span())
        if e <= s or not _free(taken, s, e) or not _free(covered, s, e):
            continue
        words = text[s:e].split()
        # a word that the text also writes small, or one that is no name, speaks against
        common = any(w.lower() in COMMON for w in words) or words[0].lower() in NOT_NAMES or (len(words) == 1 and f" {words[0].lower()} " in text)
        loud = len(words[0]) > 1 and text[s:e].isupper()
        spans.append((s, e, "-" + ("+" if len(words) > 1 else "-") + (led or _before(text, s)) + _after(text, e) + ("-" if common or loud else "0") + _titled(text, s) + "+"))
    for s, e, f in anchors:
        whole = not (e < len(text) and (text[e].isalnum() or "\u064b" <= text[e] <= "\u0652"))
        before = text[s - 1] if s else " "
        free = not before.isalnum() or (before in "وبل" and (s < 2 or not text[s - 2].isalnum()))
        near = text[max(0, s - 14) : s].rstrip()
        if f & GIVEN and whole and free:
            fam = re.compile(r" ال\w{4,}").match(text, e)
            tail = fam is not None and (fam[0].strip() in names.ar_family or names.ar_tail.match(fam[0].strip()) is not None)
            spans.append((s, fam.end() if tail else e, "+" + ("+" if tail else "0") + ("+" if _AR_CTX_END.search(near) else "0") + "+"))
        elif f & FAMILY and whole and not before.isalnum():
            prev = re.search(r"(\w{3,}) $", text[max(0, s - 24) : s])
            if prev and prev[1] not in names.ar_given:
                inner = _AR_CTX_END.fullmatch(prev[1]) is not None or prev[1] in NOT_NAMES or prev[1].startswith("ال")
                begin = s if inner else s - len(prev[0])
                ctx = inner or _AR_CTX_END.search(text[max(0, begin - 14) : begin].rstrip()) is not None
                spans.append((begin, e, "0+" + ("+" if ctx else "0") + "+"))
        elif f & CONTEXT and (not before.isalnum() or before in "وبل"):
            m = names.ar_context.match(text, s)
            if m and m["n"] not in names.ar_given and m["n"] not in NOT_NAMES and not m["n"].startswith("ال"):
                fam = (m["s"] or "").strip()
                tail = names.ar_tail.match(fam) is not None or fam in names.ar_family
                if tail or m["c"] in ("اسمي", "إسمي"):
                    spans.append((m.start("n"), m.end("s") if tail else m.end("n"), "0" + ("+" if tail else "0") + ("+" if STRONG_ARABIC.search(m["c"]) else "0") + ("+" if fam in names.ar_family else "0")))
    for s, e, votes in sorted(spans, key=lambda x: (x[0], -x[1])):
        if _free(taken, s, e):
            _add(out, taken, s, e, "name", votes)
    return sorted(out)


def _trim(text: str, s: int, e: int) -> tuple[int, int, str]:
    """A run of capitalised words without words that introduce or follow a name; the vote of those before."""
    led = ""
    while True:
        m = _WORD_AHEAD.match(text, s, e)
        if not m or m[1].lower().rstrip(".") not in LEADS and m[1].lower() not in NOT_NAMES:
            break
        led = "+" if m[1].lower().rstrip(".") in LEADS else ""
        s = m.end()
    for ending in ("'s", "’s", "'", "’", "-"):
        if text[s:e].endswith(ending):
            e -= len(ending)
    return s, e, led


def _before(text: str, s: int) -> str:
    """The vote of the words before a name."""
    near = text[max(0, s - 32) : s]
    if _CTX_BEFORE.search(near):
        return "+"
    return "-" if _PLACE_BEFORE.search(near) else "0"


def _titled(text: str, s: int) -> str:
    """The vote of a title right before a name."""
    return "+" if _TITLE_BEFORE.search(text[max(0, s - 12) : s]) else "0"


def _after(text: str, e: int) -> str:
    """The vote of the words behind a name."""
    near = text[e : e + 24]
    return "-" if _THING_AFTER.match(near) else "+" if _PERSON_AFTER.match(near) else "0"


def fit(counts: list[tuple[str, str, int]], rounds: int = 60) -> dict[tuple[str, str], float]:
    """Probability of each (kind, votes) pattern, from pattern counts alone.

    Expectation-maximisation estimates for each labeler how often it votes +, 0 and - on
    true and on false spans; a logistic regression on the votes, trained on the posteriors
    and weighted by the counts, gives the probability.
    """
    out: dict[tuple[str, str], float] = {}
    # Names of the two scripts have their own labelers, told by their number.
    for kind, width in sorted({(k, len(v)) for k, v, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind and len(v) == width]
        x = np.array([["0+-".index(c) for c in v] for v, _ in rows])
        n = np.array([float(c) for _, c in rows])
        # start from the balance of votes
        score = ((x == 1).sum(1) - 1.5 * (x == 2).sum(1)).astype(float)
        post = 1 / (1 + np.exp(-2.0 * (score - 0.5)))
        for _ in range(rounds):
            prior = np.clip((n * post).sum() / n.sum(), 0.02, 0.98)
            lp, lq = np.full(len(rows), math.log(prior)), np.full(len(rows), math.log(1 - prior))
            for j in range(width):
                for value in (1, 2):  # a labeler that doesn't vote says nothing
                    hit = x[:, j] == value
                    # a labeler's vote for is never taken as evidence against, nor the other way round
                    a = ((n * post)[hit].sum() + (2 if value == 1 else 0.5)) / ((n * post).sum() + 3)
                    b = ((n * (1 - post))[hit].sum() + (2 if value == 2 else 0.5)) / ((n * (1 - post)).sum() + 3)
                    if value == 1:
                        a = max(a, b)
                    if value == 2:
                        if kind == "name" and j == 0:
                            a = max(a, DOUBT)
                        b = max(a, b)
                    lp[hit] += math.log(a)
                    lq[hit] += math.log(b)
            new = 1 / (1 + np.exp(np.clip(lq - lp, -40, 40)))
            if np.abs(new - post).max() < 1e-5:
                break
            post = new
        f = np.concatenate([np.ones((len(rows), 1)), (x == 1).astype(float), (x == 2).astype(float)], axis=1)
        w, weight = np.zeros(f.shape[1]), np.sqrt(n) / np.sqrt(n).sum()  # rare patterns count for more than their rows
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            grad = f.T @ (weight * (p - post)) + 1e-4 * w
            hess = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        out |= {(kind, v): float(q) for (v, _), q in zip(rows, p)}
    return out


def _texts(df: DataFrame, tbl: str, id_col: str, fields: list[str]) -> DataFrame:
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("p")
    return df.where(F.col(id_col).isNotNull()).select(F.lit(tbl).alias("tbl"), F.col(id_col).cast("bigint").alias("row_id"), parts).select("tbl", "row_id", "p.field", "p.text").where("text is not null and text <> ''")


def _silent(kind: str, votes: str) -> bool:
    """Whether no labeler but that of the letters' case votes for a candidate, so that it is counted and not written."""
    return kind == "name" and len(votes) == LATIN_LABELERS and "+" not in votes[:-1] or kind in ("email", "address") and votes[0] == "-"


LATIN_LABELERS = 7
SPANS = "tbl string, row_id bigint, field string, start int, end int, kind string, votes string, n bigint"


def _spans(texts: DataFrame, names, wanted: frozenset | None) -> DataFrame:
    """Candidates of texts; without ``wanted`` silent ones as counts (null ``tbl``), else only those of its (kind, votes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, own = TaskContext.get().partitionId(), Names(names.value)
        for no, b in enumerate(batches):
            tbl, row, field, text = (b.column(c).to_pylist() for c in ("tbl", "row_id", "field", "text"))
            out, silent = [], Counter()
            for i, t in enumerate(text):
                for c in candidates(t, own):
                    if wanted is not None:
                        if c[2:] in wanted:
                            out.append((tbl[i], row[i], field[i], *c, 1))
                    elif _silent(*c[2:]):
                        silent[c[2:]] += 1
                    else:
                        out.append((tbl[i], row[i], field[i], *c, 1))
            out += [(None, None, None, pid, no, kind, votes, n) for (kind, votes), n in silent.items()]
            cols = list(zip(*out)) or [()] * 8
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split(" ")[0] for x in SPANS.split(", ")])

    return texts.mapInArrow(run, SPANS).distinct()


def scored(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(tbl, row_id, field, kind, start, end, p) of candidates that a labeler votes for, or that are accepted."""
    listed = gazetteer.where("name is not null").select("name", "name_part", "script").distinct()
    rows = listed.limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the gazetteer has more than {MAX_NAMES} names")
    spark = texts.sparkSession
    names = spark.sparkContext.broadcast(sorted((r["name"], r["name_part"] or "", r["script"] or "") for r in rows))  # bounded by MAX_NAMES
    found = cut(_spans(texts, names, None))
    # At most three to the power of the labelers of patterns for each kind.
    counts = [(r["kind"], r["votes"], r["n"]) for r in found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()]
    table = fit(counts)
    scores = F.broadcast(spark.createDataFrame([(k, v, p) for (k, v), p in table.items()], "kind string, votes string, p double"))
    written = found.where("tbl is not null")
    missing = frozenset(key for key, p in table.items() if p >= 0.5 and _silent(*key))
    if missing:
        written = written.unionByName(_spans(texts, names, missing))
    return written.join(scores, ["kind", "votes"]).select("tbl", "row_id", "field", "kind", "start", "end", "p")


def find(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(tbl, row_id, field, kind, start, end, p) of accepted spans in (tbl, row_id, field, text)."""
    return scored(texts, gazetteer).where("p >= 0.5")


def numbered(spans: DataFrame) -> DataFrame:
    """Number the spans of a kind within a field; the group is one text."""
    w = Window.partitionBy("tbl", "row_id", "field", "kind").orderBy("start", "end")
    return spans.select("tbl", "row_id", "field", "kind", F.row_number().over(w).alias("nth"))


def mask(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(tbl, row_id, field, text) with each span replaced by a placeholder such as ``[EMAIL]``."""
    packed = spans.groupBy("tbl", "row_id", "field").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind")), asc=False).alias("spans"))  # of one text
    text: Column = F.expr("aggregate(spans, text, (t, s) -> concat(substring(t, 1, s.start), '[', upper(s.kind), ']', substring(t, s.end + 1, length(t))))")
    return texts.join(packed, ["tbl", "row_id", "field"]).select("tbl", "row_id", "field", text.alias("text")).distinct()
