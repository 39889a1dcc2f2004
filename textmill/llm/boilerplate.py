"""Problem 3: the main content of web pages.

The text has no markup, so a page's tree is read from its lines: the page, its zones
(head, article, tail), blocks of lines of one make, and lines. Each line becomes a row of
node features: its attribute tokens (words, first and last characters, weighted by how
often they stand in boilerplate), the density of text in its block, above and below it,
its depth in the page, and the attributes of its siblings. Gradient-boosted trees give
each line a probability of being boilerplate, and a hierarchical decoder picks the zone
that fits the probabilities best, so that no line of the tail counts as article while its
zone does not.

No labels are given. The trees learn from three weak sources on a bounded sample of
pages: a line that returns on most pages of its host is boilerplate; the metadata's title
is article; and rules over classes of lines say the rest. The first two overrule the
rules. No class or result of a rule is a feature, so that the trees decide by the text
and the shape of the page; ``report`` tells, on hosts held out, how often they differ from
the rules and are borne out by the other two sources.

Defined results: null or blank text has no lines; a page without an article loses every
line; a page of any length is read whole; pages that are repeated give the same lines
once; null metadata only loses the title and the host as evidence; an empty table gives an
empty result; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.lookalike import canonical
from textmill.operators.sample import bounded_sample

# The sample: pages chosen by a hash, and up to ``HOST_PAGES`` pages of each of ``MAX_HOSTS`` hosts, whose lines are compared.
MAX_PAGES = 1_000
MAX_HOSTS, HOST_PAGES, LEAST_HOST = 40, 25, 8
REPEATED = 0.5  # share of a host's pages on which a line of the site stands
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 40, 5, 0.25, 32, 20
LEAST_TOKEN = 3
LEAST_ZONE = 1.5  # log odds that an article's lines must have together
PAGES_AT_ONCE = 500

# Classes of lines, by the words they are made of. The first that matches holds.
CLASSES = (
    ("says", r".{1,40} (?:says|said|wrote|writes|écrit|a écrit|يقول|تقول|كتب|schreibt|sagt|dice|escribe)\s*[:：]"),
    ("related", r"(?:you may also (?:like|enjoy)|related (?:articles?|posts?|stories|reading)|latest (?:posts|articles|news)|trending(?: now)?|most (?:read|popular|viewed|shared)|editor.?s picks?|from the same author|more in .{1,30}|more from .{1,40}|recommended(?: for you)?|popular posts|see also|further reading|articles? liés|les plus lus|à lire aussi|sur le même sujet|du même auteur|derniers articles|voir aussi|قد يعجبك أيضا?ً?ا?|مقالات ذات صلة|الأكثر قراءة|أحدث المقالات|اقرأ أيضا?ً?ا?|من الكاتب نفسه|للكاتب نفسه|مواضيع ذات صلة|المزيد (?:في|من).{1,30}|اخترنا لك|ähnliche artikel|meistgelesen|das könnte sie.{0,30}|artículos relacionados|lo más leído|también te puede.{0,20})\s*:?"),
    ("pointer", r"(?:read (?:also|more|next|on)|see also|related|more on this|also read|à lire aussi|lire aussi|lire la suite|voir aussi|اقرأ أيضا?ً?ا?|اقرأ المزيد|شاهد أيضا?ً?ا?|انظر أيضا?ً?ا?|lesen sie auch|lea también|ver también)\s*[:：-].*"),
    ("ad", r"\[?(?:advertisement|advert|ad|sponsored(?: content)?|publicité|annonce|إعلان(?: ممول)?|anzeige|werbung|publicidad|anuncio)(?:\s*[-–—:]\s*.{0,20})?\]?|story continues (?:below|after).{0,30}|(?:la suite|l.article continue).{0,40}|suite après la publicité|يتبع بعد الإعلان|(?:تتمة|يتابع|تابع القراءة).{0,30}|continue reading.{0,20}|der artikel (?:geht|wird).{0,40}|continúa después.{0,30}"),
    ("comment", r"(?:leave a (?:comment|reply)|post (?:a )?comment|your (?:comment|name|e-?mail).{0,30}|add a comment|write a comment|reply|submit|send|laisser un commentaire|votre (?:commentaire|nom|adresse).{0,30}|publier le commentaire|envoyer(?: le commentaire)?|ajouter un commentaire|اترك تعليقا?ً?ا?|إرسال التعليق|أدخل (?:بريدك|اسمك|تعليقك).{0,30}|تعليقك.{0,20}|اسمك.{0,20}|أضف تعليقا?ً?ا?|enter your .{0,30}|(?:ihr )?kommentar.{0,30}|deja un comentario|tu comentario.{0,20}|comments?|التعليقات|commentaires?)\s*:?(?:\(.{0,20}\))?"),
    ("subscribe", r"(?:subscribe|join \d+|sign up|get the|abonnez-vous|inscrivez-vous|rejoignez|اشترك|انضم(?: إلى)?|سجل معنا|abonnieren|melden sie sich|suscr[ií]b).{0,90}"),
    ("counter", r"[\d٠-٩.,]+\s+(?:comments?|shares?|views?|likes?|replies|commentaires?|partages?|vues|تعليق\S*|تعليقات|مشاركة|مشاركات|مشاهدة|مشاهدات|kommentare?|comentarios?|veces compartido)"),
    ("share", r"(?:share(?: (?:this|on|via).{0,20})?|partager(?: .{0,20})?|شارك(?: الصفحة| المقال)?|مشاركة|teilen|compartir|tweet|pin|mail|print|save|imprimer|enregistrer|طباعة|حفظ|follow us|drucken|merken)(?:\s*[|·•/,]\s*.{1,20}){0,4}"),
    ("date", r"(?:updated|published|posted|last (?:updated|modified)|mis à jour|publié|آخر تحديث|نُ?شر|تاريخ النشر|aktualisiert|veröffentlicht|actualizado|publicado)\b.{0,60}|(?:by|par|بقلم|von|por|كتبه|إعداد)\s.{1,60}[|·–—-]\s*.{0,40}\d{4}.{0,30}|(?:by|par|بقلم|von|por) (?:the |la |le |فريق |هيئة )?.{1,40}(?:desk|team|staff|editors?|rédaction|التحرير)\b.{0,60}|.{0,50}\b\d+ (?:min(?:ute)?s? read|min de lecture|دقائق قراءة|minutes? de lecture).{0,10}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2} \S{3,10} \d{4}"),
    ("tags", r"(?:tags?|tagged|filed under|categories|topics|mots-clés|étiquettes|catégories|الوسوم|وسوم|كلمات مفتاحية|الكلمات الدلالية|تصنيفات|schlagwörter|etiquetas)\s*[:：].*"),
    ("legal", r"©.*|\(c\) \d{4}.*|copyright.*|.*(?:all rights reserved|tous droits réservés|جميع الحقوق محفوظة|alle rechte vorbehalten|todos los derechos reservados).*|(?:terms|privacy|imprint|legal notice|mentions légales|confidentialité|الشروط|الخصوصية|impressum|datenschutz|aviso legal|privacidad|cookies?|conditions)(?:\s*[|·•/]\s*.{1,30}){0,4}"),
    ("footer", r"(?:site map|sitemap|back to top|top|plan du site|haut de page|retour en haut|خريطة الموقع|العودة إلى الأعلى|nach oben|volver arriba|mapa del sitio|report a (?:problem|bug|mistake).{0,40}|signaler .{0,40}|أبلغ عن خطأ.{0,30}|powered by .*|propulsé par .*|made with .{0,60}|fait avec .{0,60}|version [\d.]+|الإصدار [\d.]+|prices include.*|les prix .*|delivery within.*|follow us.*|suivez-nous.*|تابعونا.*|تابعنا.*|skip to (?:content|main).*|aller au contenu|تخطّ?ي? إلى المحتوى|انتقل إلى المحتوى|.{1,40} is a (?:small|little) .{0,60}we publish.*|.{1,40}(?:مساحة صغيرة|موقع صغير).{0,80}|.{1,40} est (?:un|une) petite? .{0,120}|صنع(?:ت)? ب.{0,40}|الأسعار تشمل.*|تشمل الأسعار.*|بدعم من .*)"),
    ("cookie", r".{0,60}(?:we use cookies|cookies? help us|uses? cookies|with the help of cookies|utilisons des cookies|utilise des cookies|ملفات تعريف الارتباط|يحفظ هذا الموقع|نستخدم ملفات|stores small files|your privacy matters|vie privée|خصوصيتك تهم|you accept that we|vous acceptez que|verwenden cookies|usamos cookies|utilizamos cookies|باستخدام(?:ك)? .{1,40}(?:توافق|تقبل)).{0,260}|(?:accept all|reject all|accept|reject|settings|manage preferences|ok, got it|tout accepter|accepter|refuser|قبول الكل|رفض|consent)\b(?:\s*[|·:].*)?|consent:.*"),
    ("lang", r"(?:english|français|deutsch|español|العربية|italiano|en|ar|fr|de|es)(?:\s*[|·•/]\s*(?:english|français|deutsch|español|العربية|italiano|en|ar|fr|de|es))+"),
)
NAMES = [n for n, _ in CLASSES]
_FIRST = re.compile("|".join(f"(?P<{n}>(?:{rx})\\s*$)" for n, rx in CLASSES), re.IGNORECASE)
_ROW = re.compile(r"(?:^[^.!?؟]{1,28}?(?:\s*[|·•]\s*|\s{2,})(?=\S))(?:[^.!?؟|·•]{1,28}(?:\s*[|·•]\s*|\s{2,}|$)){1,}$")
_CRUMB = re.compile(r"^\[?[^.!?؟>»/]{1,30}\]?\s+[>»/›]\s+\[?[^.!?؟>»/]{1,40}")
_CRUMB_END = re.compile(r"\s[>»/›]\s")
_BULLET = re.compile(r"^\s*(?:[-*•–·▪]|\d{1,2}[.)])\s+\S")
_BRACKET = re.compile(r"^\[[^\[\]]{1,40}\]$")
# Names of menu entries.
MENU = frozenset("home|about|about us|contact|contact us|help|faq|archive|archives|guides|recipes|maps|forum|shop|store|sign in|log in|login|register|newsletter|workshops|calendar|events diary|events|gallery|jobs|careers|tools|search|menu|news|blog|press|support|community|accueil|à propos|aide|agenda|galerie|boutique|connexion|outils|ateliers|recettes|cartes|emplois|lettre|calendrier|recherche|الرئيسية|من نحن|اتصل بنا|مساعدة|المنتدى|المتجر|تسجيل الدخول|الأرشيف|الأدلة|التقويم|أدوات|ورش العمل|معرض الصور|النشرة|وصفات|خرائط|وظائف|البحث|القائمة|startseite|über uns|hilfe|kontakt|inicio|ayuda|contacto|tienda".split("|"))
KINDS = [*NAMES, "row", "crumb", "bracket", "menu", "bullet", "para", "quote", "short", "blank"]
KIND = {k: i for i, k in enumerate(KINDS)}
SURE_BAD = {KIND[k] for k in ("pointer", "ad", "counter", "share", "date", "tags", "legal", "footer", "subscribe", "says", "related", "comment", "cookie", "lang", "row", "crumb", "bracket")}
TAIL = {KIND[k] for k in ("related", "comment", "tags", "legal", "footer", "subscribe", "says", "cookie")}
BODY = {KIND[k] for k in ("para", "quote")}




def _stops(t: str) -> bool:
    return t.rstrip("\"'”»’)]")[-1:] in (".", "!", "?", "؟", "…")


_DIGITS = re.compile(r"[\d٠-٩]+")


def kind_of(line: str) -> int:
    """The class of a line by the rules."""
    t = line.strip()
    return _kind_of(t) if t else KIND["blank"]


def _kind_of(t: str) -> int:
    m = _FIRST.match(t)
    if m and not (len(t) > 120 and _stops(t) and m.lastgroup not in ("cookie", "footer", "legal", "subscribe")):
        return KIND[m.lastgroup]
    if _BRACKET.match(t):
        return KIND["bracket"]
    if _CRUMB.match(t) and not _stops(t):
        return KIND["crumb"]
    if _ROW.match(t):
        return KIND["row"]
    bare = re.sub(r"^[-*•–·▪]\s+", "", t).strip("[] ").lower()
    if bare in MENU:
        return KIND["menu"]
    if _BULLET.match(t):
        return KIND["bullet"]
    if t[0] in "“\"«„>" and len(t) > 40:
        return KIND["quote"]
    if _stops(t) and len(t) > 45 or len(t) > 110:
        return KIND["para"]
    return KIND["short"]


def find_title(lines: list[str], kinds: list[int], title: str | None) -> int:
    """The line that holds the title, or -1: the metadata's title, the end of a breadcrumb, or the last short line before the article's text."""
    want = re.sub(r"\s+", " ", canonical(title)).strip() if title else None
    if want:
        for i, t in enumerate(lines):
            if t == want:
                return i
    for i, k in enumerate(kinds):
        if k == KIND["crumb"]:
            stub = re.split(r"\s[>»/›]\s", lines[i])[-1].strip()
            if len(stub) >= 8:
                for j, t in enumerate(lines):
                    if j != i and t.startswith(stub):
                        return j
    first = next((i for i, k in enumerate(kinds) if k in BODY or k == KIND["bullet"] and not lines[i].lstrip("-*•–·▪ ").lower() in MENU), None)
    if first is None:
        return -1
    for j in range(first - 1, -1, -1):
        if kinds[j] == KIND["short"] and len(lines[j].split()) >= 2:
            # the list of a related block directly above belongs to that block, but for its last line
            return j
        if kinds[j] in TAIL and kinds[j] != KIND["cookie"] or kinds[j] in (KIND["row"], KIND["crumb"], KIND["lang"]):
            break
    return -1


def states(lines: list[str], kinds: list[int], title_at: int) -> np.ndarray:
    """What rules are sure of: 1 boilerplate, 0 article, with the zones of the page."""
    n = len(lines)
    bad = np.ones(n, dtype=np.int8)
    start = title_at
    if start < 0:  # text that isn't a reader's comment
        start = next((i for i, k in enumerate(kinds) if k in BODY or k in (KIND["says"], KIND["comment"])), n)
        if start < n and kinds[start] not in BODY:
            start = n
    if start < n:
        bad[start] = 0
    i, said, in_list = start + 1, False, False
    while i < n:
        k = kinds[i]
        if k == KIND["blank"]:
            i += 1
            continue
        if k in TAIL:
            # an aside within the article is followed by text of its own
            j, heads = i, 0
            while j < n and (kinds[j] in SURE_BAD or kinds[j] in (KIND["blank"], KIND["menu"], KIND["short"])):
                heads += kinds[j] in (KIND["comment"], KIND["legal"], KIND["footer"], KIND["says"])
                j += 1
            if heads or j >= n or kinds[j] not in BODY or kinds[i] == KIND["says"]:
                break
            # related lines, then the article goes on
            i = j
            continue
        if k in SURE_BAD:
            i += 1
            continue
        bad[i] = 0
        i += 1
    return bad


def tokens(line: str) -> list[str]:
    return _DIGITS.sub("0", line.lower()).split()


def attributes(words: list[str]) -> set[str]:
    """Attribute tokens of a line: its words, and what it begins and ends with."""
    return {*words, "^" + words[0], words[-1] + "$", "^" + words[0][0], words[-1][-1] + "$"} if words else set()


def learn_odds(lines: list[str], bad: np.ndarray) -> dict[str, float]:
    """Log odds of boilerplate for each attribute token of a labelled sample, rare ones left out."""
    seen = (Counter(), Counter())
    for t, b in zip(lines, bad):
        seen[int(b)].update(attributes(tokens(t)))
    n = (int((bad == 0).sum()) + 1, int((bad == 1).sum()) + 1)
    good, poor = seen
    return {w: float(np.log((poor[w] + 0.5) / n[1]) - np.log((good[w] + 0.5) / n[0])) for w in {*good, *poor} if good[w] + poor[w] >= LEAST_TOKEN}


OWN = 11


class Lines:
    """Features of single lines; short lines, which return on many pages, are remembered."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds, self.seen = odds, {}

    def __call__(self, t: str) -> tuple:
        out = self.seen.get(t)
        if out is None:
            out = self._of(t)
            if len(t) <= 60 and len(self.seen) < 200_000:  # a cache; the result is the same without
                self.seen[t] = out
        return out

    def _of(self, t: str) -> tuple:
        w = tokens(t)
        if not w:
            return (0.0,) * OWN
        get = self.odds.get
        o = [get(x, 0.0) for x in w]
        total = sum(o)
        return (
            total / len(o), max(o), min(o), get("^" + w[0][0], 0.0), get(w[-1][-1] + "$", 0.0), get("^" + w[0], 0.0), get(w[-1] + "$", 0.0),
            max(-40.0, min(40.0, total)), float(len(w)), float(_stops(t)), float(len(_DIGITS.findall(t))),
        )


def features(pages: list[tuple[list[str], int]], own: Lines) -> np.ndarray:
    """Rows of node features for the lines of pages (lines, line of the title or -1), one page behind the other."""
    sizes = np.array([len(p[0]) for p in pages], dtype=np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros((0, 1), dtype=np.float32)
    page = np.repeat(np.arange(len(pages)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(n)
    lines = [t for p in pages for t in p[0]]
    line = np.array([own(t) for t in lines], dtype=np.float32)
    odds, stops = line[:, 0], line[:, 9]
    size = np.array([len(t) for t in lines], dtype=np.float32)
    full = np.flatnonzero(size)

    def sibling(v: np.ndarray, step: int) -> np.ndarray:
        """The value of the line ``step`` non-blank lines before (behind, if negative) within the page."""
        out = np.zeros(n, dtype=np.float32)
        k = abs(step)
        if len(full) > k:
            a, b = (full[:-k], full[k:]) if step > 0 else (full[k:], full[:-k])
            same = page[a] == page[b]
            out[b[same]] = v[a[same]]
        return out

    def upto(v: np.ndarray) -> np.ndarray:
        """Sums within the page, this line included."""
        c = np.cumsum(v)
        return c - (c - v)[first]

    def since(mark: np.ndarray) -> np.ndarray:
        """Lines since the last marked one of the page."""
        last = np.maximum.accumulate(np.where(mark, at, -1))
        return np.where(last >= first, at - last, 99)

    body = ((size > 60) & (stops > 0)) * size.astype(np.float64)
    whole = np.bincount(page, body)[page]
    above = upto(body) - body
    poor = odds > 2
    order, total = upto((size > 0).astype(np.float64)), np.bincount(page, size > 0)[page]
    title = np.repeat(np.array([p[1] for p in pages]), sizes)
    rel = np.where(title >= 0, at - first - title, -999)
    # blocks: runs of lines of one make
    make = (size > 60) * 2 + (stops > 0) + 4 * (size == 0)
    edge = np.concatenate(([True], (make[1:] != make[:-1]) | (page[1:] != page[:-1])))
    block = np.cumsum(edge) - 1
    length = np.bincount(block)
    cols = (
        *line.T, size, *[sibling(odds, k) for k in (1, 2, 3, -1, -2, -3)], sibling(line[:, 4], 1), sibling(line[:, 4], -1), *[sibling(size, k) for k in (1, 2, -1, -2)],
        above, whole - above - body, above / np.maximum(whole, 1), order, total - order, order / np.maximum(total, 1), rel, rel == 0,
        upto(poor.astype(np.float64)) - poor, since(poor), since(body > 0), upto(np.maximum(odds, 0).astype(np.float64)), length[block], (np.bincount(block, odds) / length)[block],
    )
    return np.stack([np.asarray(c, dtype=np.float32) for c in cols], axis=1)


class Trees:
    """Gradient-boosted trees on binned features, by logistic loss; arrays of fixed size."""

    def __init__(self, cuts: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], base: float) -> None:
        self.cuts, self.trees, self.base = cuts, trees, base

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(b), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit ``TREES`` trees of ``DEPTH`` on rows and 0/1 labels, each split by the gain over histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Trees(cuts, [], float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    b = model.binned(x).astype(np.int64)
    score = np.full(len(y), model.base)
    nodes = 2**DEPTH - 1
    rng, some = np.random.default_rng(7), min(x.shape[1], max(x.shape[1] // 2, 8))
    for _ in range(TREES):  # each from some of the features
        columns = rng.permutation(x.shape[1])[:some]
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, 255, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            best = np.zeros(wide)
            for j in columns:
                key = (node - first) * (BINS + 1) + b[:, j]
                gs = np.bincount(key, g, wide * (BINS + 1)).reshape(wide, -1).cumsum(1)
                hs = np.bincount(key, h, wide * (BINS + 1)).reshape(wide, -1).cumsum(1)
                cs = np.bincount(key, minlength=wide * (BINS + 1)).reshape(wide, -1).cumsum(1)
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(cs < LEAST_LEAF) | (ct - cs < LEAST_LEAF)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(wide), top]
                win = value > best + 1e-9
                best[win] = value[win]
                feature[first : first + wide][win], cut[first : first + wide][win] = j, top[win]
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - nodes
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        model.trees.append((feature, cut, value))
        score += value[leaf]
    return model


def lines_of(text: str) -> list[str]:
    return [t.strip() for t in canonical(text).split("\n")]


def given_title(lines: list[str], title: str | None) -> int:
    """The line that the metadata or a breadcrumb names as the title, or -1."""
    want = re.sub(r"\s+", " ", canonical(title)).strip() if title else None
    if want and want in lines:
        return lines.index(want)
    for i, t in enumerate(lines):
        if len(t) < 120 and (">" in t or "»" in t or "/" in t or "›" in t):
            stub = _CRUMB_END.split(t)[-1].strip()
            if 8 <= len(stub) < len(t):
                for j, other in enumerate(lines):
                    if j != i and other.startswith(stub):
                        return j
    return -1



def rule_labels(lines: list[str], title: str | None) -> np.ndarray:
    """What the rules say of each line: 1 boilerplate, 0 article."""
    kinds = [kind_of(t) for t in lines]
    return states(lines, kinds, find_title(lines, kinds, title))


def weak_labels(pages: list[tuple[list[str], str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the lines of pages (lines, title, host), and what the rules alone say; blank lines have none."""
    count: Counter = Counter(h for _, _, h in pages if h)
    on: defaultdict = defaultdict(int)
    keys = [[_DIGITS.sub("0", t.lower()) for t in lines] for lines, _, _ in pages]
    for (_, _, h), k in zip(pages, keys):
        if h and count[h] >= LEAST_HOST:
            for t in {*k}:
                on[h, t] += 1
    rules = np.concatenate([rule_labels(lines, title) for lines, title, _ in pages]) if pages else np.zeros(0, dtype=np.int8)
    out, i = rules.copy(), 0
    for (lines, title, h), k in zip(pages, keys):
        want = re.sub(r"\s+", " ", canonical(title)).strip() if title else None
        for t, key in zip(lines, k):
            if want and t == want:
                out[i] = 0
            elif h and count[h] >= LEAST_HOST and on[h, key] >= REPEATED * count[h]:
                out[i] = 1
            i += 1
    return out, rules


def decode(lines: list[str], title_at: int, p: np.ndarray) -> np.ndarray:
    """Boilerplate lines of a page: the best zone first, then lines within it.

    The head reaches to the first article line, the tail from the last; outside the zone
    every line is boilerplate whatever its own probability, inside each line decides. A
    page whose best zone has hardly any evidence has no article.
    """
    live = np.array([bool(t) for t in lines])
    gain = np.where(live, np.log(np.clip(1 - p, 1e-6, 1)) - np.log(np.clip(p, 1e-6, 1)), 0.0)
    inside = np.maximum(gain, 0.0) + np.where(live & (gain < 0), -0.02, 0.0)
    # the zone of the largest sum over lines, of which those beyond it would have to be boilerplate
    cost = np.where(gain > 0, inside, np.maximum(gain, -1.5) * 0.15).tolist()
    best, run, start, zone = 0.0, 0.0, 0, (0, 0)
    for i, c in enumerate(cost):
        if run <= 0:
            run, start = 0.0, i
        run += c
        if run > best:
            best, zone = run, (start, i + 1)
    bad = live.copy()
    if best < LEAST_ZONE:
        return bad
    bad[zone[0] : zone[1]] &= gain[zone[0] : zone[1]] <= 0
    if title_at >= 0 and p[title_at] < 0.5:
        bad[title_at] = False
    return bad


class Model:
    """Attribute odds and trees; both of fixed size."""

    def __init__(self, odds: dict[str, float], trees: Trees | None) -> None:
        self.odds, self.trees = odds, trees

    def read(self, pages: list[tuple[str, str | None]], own: Lines) -> list[np.ndarray]:
        """The boilerplate lines of pages (text, title)."""
        split = [lines_of(t) for t, _ in pages]
        at = [given_title(ls, title) for ls, (_, title) in zip(split, pages)]
        if self.trees is None:
            return [np.array([bool(t) for t in ls]) for ls in split]
        p = self.trees.predict(features(list(zip(split, at)), own))
        ends = np.cumsum([len(ls) for ls in split])
        return [decode(ls, a, p[e - len(ls) : e]) for ls, a, e in zip(split, at, ends)]


def train(pages: list[tuple[str, str | None, str | None]]) -> Model:
    """Fit on pages (text, title, host)."""
    read = [(lines_of(t), title, host) for t, title, host in pages]
    bad, _ = weak_labels(read)
    lines = [t for ls, _, _ in read for t in ls]
    keep = np.array([bool(t) for t in lines], dtype=bool)
    if keep.sum() < 2 * LEAST_LEAF or len({*bad[keep].tolist()}) < 2:
        return Model({}, None)
    odds = learn_odds([t for t in lines if t], bad[keep])
    x = features([(ls, given_title(ls, title)) for ls, title, _ in read], Lines(odds))
    return Model(odds, boost(x[keep], bad[keep].astype(np.float64)))


def sample(pages: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """At most ``MAX_PAGES`` pages by a hash of the id, and up to ``MAX_HOSTS * HOST_PAGES`` pages of hosts chosen by a hash."""
    pages = pages.where("id is not null and text is not null")
    if "host" not in pages.columns:
        pages = pages.withColumn("host", F.lit(None).cast("string"))
    some = bounded_sample(pages, "id", MAX_PAGES).collect()
    big = pages.where("host is not null").groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_HOST)
    big = F.broadcast(big.orderBy(F.md5("host"), "host").limit(MAX_HOSTS))  # of fixed size
    share = F.conv(F.substring(F.md5(F.col("id")), 9, 8), 16, 10).cast("double") / float(2**32)
    more = pages.join(big, "host").where(share * F.col("n") < HOST_PAGES).orderBy(F.md5("id"), "id").limit(MAX_HOSTS * HOST_PAGES).collect()
    rows = {r["id"]: (r["text"], r["title"], r["host"]) for r in [*some, *more]}
    return [rows[k] for k in sorted(rows)]


def fit(pages: DataFrame) -> Model:
    return train(sample(pages))


def report(pages: DataFrame) -> dict[str, float]:
    """Fit on half of the sample's hosts and compare trees with rules on the other half.

    ``differ`` is the share of lines on which they differ, ``checked`` the number of these
    that the title or the repetition on the host bears on, ``right`` the share of them on
    which the trees are right.
    """
    import hashlib

    rows = sample(pages)
    half = lambda r: hashlib.md5((r[2] or r[0]).encode("utf-8", "surrogatepass")).digest()[0] % 2
    model, held = train([r for r in rows if half(r) == 0]), [r for r in rows if half(r) == 1]
    read = [(lines_of(t), title, host) for t, title, host in held]
    labels, rules = weak_labels(read)
    own = Lines(model.odds)
    got = np.concatenate([*model.read([r[:2] for r in held], own), np.zeros(0, dtype=bool)])
    live = np.array([bool(t) for ls, _, _ in read for t in ls], dtype=bool)
    differ = live & (got != (rules == 1))
    checked = live & (labels != rules)
    return {"lines": int(live.sum()), "differ": float(differ.sum() / max(live.sum(), 1)), "checked": int(checked.sum()), "right": float((got == (labels == 1))[checked].mean()) if checked.any() else 1.0}


def pages_of(df: DataFrame, title: Column | None = None) -> DataFrame:
    """(id, text, title, host) of pages with metadata."""
    host = F.regexp_extract(F.col("metadata.url"), r"^[a-z]+://([^/?#]+)", 1)
    return df.select(F.col("id").cast("string").alias("id"), "text", (title if title is not None else F.col("metadata.title")).alias("title"), F.when(host != "", host).alias("host"))


def boilerplate_lines(pages: DataFrame, model: Model) -> DataFrame:
    """(id, line_no) of the non-blank lines that aren't part of the article."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        own = Lines(m.odds)
        for b in batches:
            rows = [r for r in zip(*(b.column(c).to_pylist() for c in ("id", "text", "title"))) if r[1]]
            out_id, out_no = [], []
            for lo in range(0, len(rows), PAGES_AT_ONCE):
                part = rows[lo : lo + PAGES_AT_ONCE]
                for (i, _, _), bad in zip(part, m.read([r[1:] for r in part], own)):
                    nos = np.flatnonzero(bad)
                    out_id += [i] * len(nos)
                    out_no += nos.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_no, pa.int32())], ["id", "line_no"])

    return pages.where("id is not null and text is not null").select("id", "text", "title").mapInArrow(run, "id string, line_no int")


def main_content(pages: DataFrame, model: Model) -> DataFrame:
    """(id, text) with only the lines of the article."""
    bad = boilerplate_lines(pages, model).distinct().groupBy("id").agg(F.collect_set("line_no").alias("bad"))  # lines of one page
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (t, i) -> not array_contains(coalesce(bad, array()), i)), '\\n')")
    return pages.where("id is not null and text is not null").dropDuplicates(["id"]).join(bad, "id", "left").select("id", kept.alias("text"))
