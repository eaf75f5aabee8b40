"""Sentence boundaries across languages and scripts.

Every character of a text gets the tag *boundary* (last character of a sentence) or *inside*. Two linear chains, both
averaged structured perceptrons decoded with Viterbi, share the work line by line:

* Lines with end marks, and Thai (blanks). Characters that cannot end a sentence have one admissible tag. The chain also
  tags quotations: a path may enter a quotation or bracket at its opening mark and leave it at its closing mark, and no
  boundary lies inside; so stray marks, quotations that never close and straight marks that may open or close are
  weighed against the sentence ends they would swallow, over the whole line and at any distance.
* Lines of Chinese or Japanese without any punctuation. Every gap between two characters is a place, with windows of
  characters as features; trained on punctuation-stripped text.

The models are trained here, when they are first needed, on documents composed of the sentences below: with and without
blanks between them, in lower and upper case, one a line without end marks, with stray quotation marks, and
punctuation-stripped. That takes a few seconds and is the same every time.

Fixed by the problem's statement, so that one tag is left: a line feed ends a sentence; an ellipsis ends one only before a
capital or an opening mark, and never in scripts without capitals; a point between digits or inside an address ends none.
All else is decided by the weights.

Defined results: NULL, blank and letterless texts have no sentences; stretches without letter and digit are none; spans
carry no white space at either end and never overlap; very long texts are tagged whole, line by line. Unpunctuated text in
scripts with blanks stays whole, as no line feed or mark says where its sentences end.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.langid_seed import SEEDS

# Abbreviations that go on, and abbreviations that may also close a sentence (both without points).
GOES_ON = frozenset(
    """sr sra srta sres dr dra dres ing lic prof profa profe ud uds vd av avda avd ave cra cr cll cl kr kra tv dg diag dpto depto fac núm num nº no nro nr n pág pag págs vol
    art cap aprox ej tel tfno cel ext p pp vs st sto sta mr mrs ms mx ee c a i e g u z b d h bzw ca str hr fr mme mlle m env ex cf sig dott dra rev gen col cap d.
    apto apt edif urb mz cc ti ce doc ref fig op cit ed eds rua r al pça jun jan feb sept oct nov dic dez av. rd blvd ul г ул т е н им стр руб тыс д. د أ डॉ श्री प्रो सु rs esq pl plz km""".split()
)
MAY_END = frozenset("etc ecc usw uu s др п д m jr sr. co inc eua etc. ss".split())
# Words that rarely open a sentence.
GOING_ON = frozenset("me te se le les nos os que de del con desde".split())
# German month names, after which an ordinal number keeps its point.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner".split())

_OPEN = frozenset("¿¡«\"“‘([「『„—")
_MARK = re.compile(r"[.!?…。！？｡।॥؟](?:[.!?…。！？｡।॥؟]|(?<=[!?]) (?=[!?]))*(?:[   ]?»|[\"”’)\]」』]|'(?=\s|$))*")
_THAI = re.compile(r"(?<=[฀-๿])[^\S\n]+(?=\S)")
_HAS_THAI = re.compile(r"[฀-๿]")
_WORD_AFTER = re.compile(r"(?:[^\W_]|[̀-ͯऀ-ःऺ-्ัิ-๎ً-ْ])+")
_HOUR = re.compile(r"[ap]\. ?m\Z", re.IGNORECASE)
_ALNUM = re.compile(r"[^\W_]")
_PLACE = re.compile(r"\[[^\[\]\n]{1,40}\]")
_NOCASE = re.compile(r"[฀-๿぀-ヿ㐀-鿿؀-ۿऀ-ॿ]")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]{4,}\Z")
_SIGNS = frozenset(chr(c) for a, b in ((0x300, 0x36F), (0x900, 0x903), (0x93A, 0x94D), (0xE31, 0xE31), (0xE34, 0xE4E), (0x64B, 0x652)) for c in range(a, b + 1))
_CLOSERS = frozenset("\"”’)]」』»'   ")
PAIRS = {"«": "»", "“": "”", "„": "“", "(": ")", "[": "]", "「": "」", "『": "』"}
_QUOTE = re.compile("[«»“”„()\\[\\]「」『』\"]")
INSIDE, BOUNDARY = 0, 1
#: Least characters of a sentence in unpunctuated Chinese and Japanese, and by how much a boundary must be better than none (in training: worse).
SHORT, CAUTION = 4, 1.0


_KINDS = {".": "dot", "…": "ellipsis", "...": "ellipsis", "!": "ask", "?": "ask", "؟": "ask", "！": "ask", "？": "ask", "。": "stop", "।": "stop"}


def _kind_after(text: str, at: int) -> tuple[str, int]:
    """What follows ``at``: its kind and its place, blanks skipped."""
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    if at >= n:
        return "end", at
    c = text[at]
    if c.islower():
        return "lower", at
    if c in _OPEN:
        return "open", at
    if c.isdigit() or c == "+":
        return "digit", at
    if c.isupper() or c.istitle():
        return "upper", at
    if c.isalpha() or _NOCASE.match(c):
        return "letter", at
    return "punct", at


def _regime(line: str) -> str:
    part = _PLACE.sub(" ", line) if "[" in line else line
    if part.islower():
        return "lower"
    if part.isupper():
        return "upper"
    return "mixed" if part.lower() != part.upper() else "nocase"


def _side(c: str) -> str:
    return "0" if not c else "b" if c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else c if c in ".,:;!?¿¡…。，" else "p"


def quotations(line: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(opening place, closing place, features) of every span that may be a quotation or a bracket of the line."""
    spans, open_at, straight = [], [], []
    for m in _QUOTE.finditer(line):
        c, i = m.group(), m.start()
        if c == '"':
            straight.append(i)
        elif open_at and c == open_at[-1][0]:
            spans.append((open_at.pop()[1], i, "typed"))
        elif c in PAIRS:
            open_at.append((PAIRS[c], i))
    spans += [(a, b, "even" if k % 2 == 0 else "odd") for k, (a, b) in enumerate(zip(straight, straight[1:]))]
    whole = "paired" if len(straight) % 2 == 0 else "unpaired"
    out = []
    for a, b, how in spans:
        c = line[a]
        before, first, last, after = (_side(line[k : k + 1] if k >= 0 else "") for k in (a - 1, a + 1, b - 1, b + 1))
        kind = how if how == "typed" else f"{how}-{whole}"
        out.append((a, b, (f"q:{kind}", f"q:{c}|{kind}", f"q:{kind}|{before}>{first}", f"q:{kind}|{last}<{after}", f"q:{kind}|{before}>{first}|{last}<{after}", f"q:{kind}|size{min((b - a).bit_length(), 9)}")))
    return out


def _features(key: tuple) -> list[str]:
    """Features of a mark from what is known of its place."""
    kind_of, kind, closers, gap, regime, cls, last, follows, prev_nocase, next_char, month = key
    shut = bool(closers)
    feats = [
        kind_of, f"{kind_of}|{kind}", f"{kind_of}|{kind}|{shut}|{regime}", f"{kind_of}|{cls}|{kind}", f"{kind_of}|{cls}|{kind}|{regime}", f"{kind_of}|gap{gap}|{kind}", f"{kind_of}|nocase{prev_nocase}|{kind}|{shut}",
    ]
    if shut and prev_nocase:
        feats += [f"{kind_of}|close>{next_char}", f"{kind_of}|close|{closers}|{gap}"]
    if last:
        feats += [f"abbr:{last}|on{follows in GOING_ON}|{regime}", f"abbr:{last}", f"abbr:{last}|{kind}|{regime}", f"abbr:{last}>{follows}"]
    if cls == "number":
        feats.append(f"number|month{month}|{kind}")
    return feats


def places(line: str) -> list[tuple[int, int, int, tuple]]:
    """(start, end, admissible tag or -1, key) of each place of a line where a sentence may end, the line's end left out."""
    out: list[tuple[int, int, int, tuple]] = []
    regime = ""
    odd: frozenset[int] | None = None
    n = len(line)
    for m in _MARK.finditer(line):
        a, b = m.span()
        core = b - a
        closers = ""
        if core > 1:
            while core > 1 and line[a + core - 1] in _CLOSERS:
                core -= 1
            if b > a + core and line[b - 1] == '"':
                # A straight quotation mark after the end mark may open the next quotation.
                if odd is None:
                    odd = frozenset([i for i, c in enumerate(line) if c == '"'][::2])
                while b > a + core and b - 1 in odd:
                    b -= 1
            closers = line[a + core : b].strip()
        if b + 1 < n and line[b] == " " and line[b + 1].isupper():
            kind, nxt = "upper", b + 1
        else:
            kind, nxt = _kind_after(line, b)
        if kind == "end":
            continue
        if not regime:
            regime = _regime(line)
        gap = nxt > b
        mark = line[a : a + core]
        prev = line[a - 1] if a else ""
        prev_nocase = prev >= "\u0600" and bool(_NOCASE.match(prev))
        kind_of = _KINDS.get(mark)
        if kind_of is None:
            if set(mark) <= {".", "…"}:
                kind_of = "ellipsis"
            elif any(c in "!?؟！？" for c in mark):
                kind_of = "ask"
            else:
                kind_of = "stop"
        k = a
        while k and ((c := line[k - 1]).isalnum() or c in _SIGNS):
            k -= 1
        last = line[k:a].casefold()
        if last == "m" and not _HOUR.search(line, max(0, a - 5), a):
            cls = "initial"
        elif not last:
            cls = "placeholder" if prev == "]" else "none"
        elif last.isdigit():
            cls = "number"
        elif last in MAY_END:
            cls = "may_end"
        elif last in GOES_ON:
            cls = "goes_on"
        elif len(last) == 1 and not prev_nocase:
            cls = "initial"
        elif k > 1 and line[k - 1] == "." and line[k - 2].isalnum():
            cls = "dotted"
        else:
            cls = "word"
        tag = -1
        if kind_of == "ellipsis":
            tag = INSIDE if prev_nocase or kind not in ("upper", "open") else BOUNDARY
        elif kind_of == "dot" and not gap and not closers:
            if kind in ("digit", "lower") or cls in ("initial", "dotted") or (cls == "number" and kind != "upper"):
                tag = INSIDE
            else:
                blank = line.rfind(" ", 0, a)
                token = line[blank + 1 : a]
                if "@" in token or "www." in token or "://" in token or (blank > 0 and line[blank - 1] == "@"):
                    tag = INSIDE
                elif kind in ("upper", "letter"):
                    until = line.find(" ", nxt)
                    if (len(last) < 2 and cls != "number") or "@" in line[nxt : until if until > 0 else len(line)]:
                        tag = INSIDE
        short = cls in ("goes_on", "may_end", "initial")
        follows = ""
        if short or cls == "number":
            after = _WORD_AFTER.match(line, nxt)
            follows = after.group().casefold() if after else ""
        month = cls == "number" and follows in MONTHS
        shut = bool(closers) and prev_nocase
        out.append((a, b, tag, (kind_of, kind, closers[:1], gap, regime, cls, last if short else "", follows if short else "", prev_nocase, line[nxt : nxt + 1] if shut else "", month)))
    if _HAS_THAI.search(line):
        for m in _THAI.finditer(line):
            a, b = m.span()
            digit = line[a - 1].isdigit() or line[b].isdigit()
            kind, _ = _kind_after(line, b)
            out.append((a, a, -1, ("thai", "digit" if digit else kind, "", False, "", "thai", "", "", True, "", False)))
        out.sort(key=lambda p: p[1])
    return out


class Tagger:
    """Weights of the chains and their decoders."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.w = weights
        self.known: dict[tuple, float] = {}
        self.gaps: dict[str, float] = {}
        get = weights.get
        self.step = (get("t00", 0.0), get("t01", 0.0), get("t10", 0.0), get("t11", 0.0))

    def score(self, key: tuple) -> float:
        """Score of a boundary at a place; equal places are added up once."""
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            get = self.w.get
            found = self.known[key] = sum(get(f, 0.0) for f in _features(key))
        return found

    def decode(self, line: str, marks: list[tuple[int, int, int, tuple]]) -> tuple[list[int], list[int]]:
        """Viterbi over the places of a line: the tag of each place, and the quotations taken (as places in ``quotations``).

        A state is the last tag. At an opening mark the path may jump to its closing mark, past every place between; a
        place whose closing marks hold that closing mark comes after it.
        """
        spans = quotations(line) if _QUOTE.search(line) else []
        t00, t01, t10, t11 = self.step
        if not spans:
            s0, s1, back = 0.0, float("-inf"), []
            for _, _, tag, key in marks:
                stay0, stay1 = s0 + t00, s1 + t10
                go0, go1 = s0 + t01, s1 + t11
                c0, c1 = stay1 > stay0, go1 > go0
                gain = self.score(key) if tag < 0 else 0.0
                s0 = float("-inf") if tag == BOUNDARY else (stay1 if c0 else stay0)
                s1 = float("-inf") if tag == INSIDE else (go1 if c1 else go0) + gain
                back.append((c0, c1))
            tags, now = [], s1 > s0
            for came in reversed(back):
                tags.append(int(now))
                now = came[now]
            return tags[::-1], []
        # Events: a place lies just before its end, so that a closing mark it holds comes first.
        events: list[tuple[float, int, int]] = [(m[1] - 0.5, 0, k) for k, m in enumerate(marks)] + [(float(s[0]), 1, k) for k, s in enumerate(spans)]
        events.sort()
        ends = [e[0] for e in events]
        marks_before = [0, *accumulate(1 - e[1] for e in events)]
        best = [[float("-inf")] * 2 for _ in range(len(events) + 1)]
        came: list[list] = [[None, None] for _ in range(len(events) + 1)]
        best[0][0] = 0.0
        trans = ((t00, t01), (t10, t11))
        for e, (_, is_span, k) in enumerate(events):
            for old in (0, 1):
                here = best[e][old]
                if here == float("-inf"):
                    continue
                if is_span:
                    moves = [(e + 1, old, here, None)]
                    a, b, feats = spans[k]
                    to = bisect_left(ends, b)
                    gain = sum(self.w.get(f, 0.0) for f in feats) + self.w.get(f"{feats[0]}|each", 0.0) * (marks_before[to] - marks_before[e + 1])
                    moves.append((to, old, here + gain, k))
                else:
                    tag, key = marks[k][2], marks[k][3]
                    moves = []
                    if tag != BOUNDARY:
                        moves.append((e + 1, INSIDE, here + trans[old][0], None))
                    if tag != INSIDE:
                        moves.append((e + 1, BOUNDARY, here + trans[old][1] + (self.score(key) if tag < 0 else 0.0), None))
                for to, new, value, took in moves:
                    if value > best[to][new]:
                        best[to][new] = value
                        came[to][new] = (e, old, took)
        tags, taken = [INSIDE] * len(marks), []
        at, now = len(events), int(best[-1][1] > best[-1][0])
        while at:
            e, old, took = came[at][now]
            if took is not None:
                taken.append(took)
            elif not events[e][1]:
                tags[events[e][2]] = now
            at, now = e, old
        return tags, sorted(taken)

    def gap_scores(self, line: str) -> list[float]:
        get = self.w.get
        out = []
        for k in range(1, len(line)):
            near = line[max(0, k - 3) : k + 2]
            key = f"{min(k, 3)}{near}"
            found = self.gaps.get(key)
            if found is None:
                if len(self.gaps) > 200_000:
                    self.gaps.clear()
                found = self.gaps[key] = sum(get(f, 0.0) for f in _gap_features(line, k))
            out.append(found)
        return out

    def decode_gaps(self, line: str, caution: float = CAUTION) -> list[int]:
        """Places in a line without punctuation after which a sentence ends: Viterbi with the distance to the last boundary, up to ``SHORT``, as state."""
        if len(line) <= SHORT:
            return []
        scores = self.gap_scores(line)
        bias = self.w.get("gap:bias", 0.0) - caution
        # far: best score of a path whose last boundary is at least SHORT back; a boundary may only be set there.
        n = len(line)
        best, came = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0], far, where = 0.0, float("-inf"), 0
        for k in range(1, n + 1):
            if k - SHORT >= 0 and best[k - SHORT] > far:
                far, where = best[k - SHORT], k - SHORT
            if far > float("-inf"):
                best[k] = far + (scores[k - 1] + bias if k < n else 0.0)
                came[k] = where
        ends, k = [], came[n]
        while k:
            ends.append(k)
            k = came[k]
        return ends[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences of a text."""
        out, offset = [], 0
        for line in text.split("\n") if "\n" in text else (text,):
            marks = places(line)
            if marks:
                ends = [m[1] for m, tag in zip(marks, self.decode(line, marks)[0]) if tag]
            elif _HAN.match(line):
                ends = self.decode_gaps(line)
            else:
                ends = ()
            start, n = 0, len(line)
            for end in (*ends, n):
                a, b = start, end
                while a < b and line[a].isspace():
                    a += 1
                while b > a and line[b - 1].isspace():
                    b -= 1
                if a < b and (line[a].isalnum() or _ALNUM.search(line, a, b)):
                    out.append((offset + a, offset + b))
                if end > start:
                    start = end
            offset += n + 1
        return out


def _gap_features(line: str, k: int) -> list[str]:
    """Windows of characters around the gap before ``line[k]``."""
    two, one, nxt, far = line[max(0, k - 2) : k], line[k - 1], line[k], line[k : k + 2]
    return [f"g1:{one}", f"g2:{two}", f"g3:{line[max(0, k - 3) : k]}", f"n1:{nxt}", f"n2:{far}", f"gn:{one}{nxt}", f"g2n:{two}{nxt}", f"g2n2:{two}|{far}"]


# Training sentences, written for this file; "_" stands for a sentence that keeps its form in every variant.
SEED = {
    "es": """El Dr. [NOMBRE] me vio el lunes y la Sra. Pinto llamó después.|Tomé 2.5 mg cada noche.|Fuimos al parque, al cine, etc. y volvimos tarde.|Compré pan, leche, queso, etc.|Me pesan las deudas, las visitas, las filas, etc.|Hablamos de trabajo, de la casa, etc.|Vendían frutas, panes, etc.|Llegué a las 8:15 a. m. y salí a las 9 p. m. con mucho sueño.
    |Mi hermano vive en EE. UU. desde el año pasado.|¿Usted qué cree?|¡No lo puedo creer!|Me dijo: "No corras tanto."|«¿Estás bien?», preguntó mi tía.|Pensé (¿y si me voy?) que era mejor callar.|La canción dice "¿quién vendrá?" y todos cantan.|Le grité "¡espera!" y ella siguió.
    |Primero leo... luego duermo... y al final nada.|No sé… quizá mañana.|Vivo en la Cra. 15 # 20-31, apto. 201 con mi gata.|Escriba a ana.perez@correo.example cuando pueda.|Fue el 12.03.2024 en la sede núm. 4.|Pesé 61.5 kg en mayo.|Las tareas, las visitas, etc. me tienen cansado.|Está en la pág. 14 del libro.
    |Hablé con el Depto. de Becas y con la Fac. de Artes.|Como Ud. ya dijo, todo cambia.|El código era F32.1 según la hoja, versión 2.0.1, y nada más.|Mi tel. 3001234567 no funciona.|Gasté aprox. 30.000 pesos, p. ej. en buses.|"¡Basta!", gritó mi primo.|Estaba en el piso 3.|Eran ya las 8.|¿Cómo así?!|[NOMBRE] me llamó desde [LUGAR].|El Prof. [NOMBRE] y la Lic. [NOMBRE] salieron.""",
    "en": """Dr. Lane and Mrs. Hill came at 5 p.m. yesterday.|I slept 3.5 hours, i.e. less than usual.|She said, "Just wait."|"Are you ok?" asked my friend.|I feel... tired, maybe.|He lives in the U.S. now.|Bring fruit, e.g. apples.|What now?|Stop!|We bought rice, beans, etc.|I live at 12 Elm St., near the park.|Mr. Fox waited.|Mr. [NOMBRE] and J. Stone left.|[NOMBRE] called me.""",
    "pt": """O Dr. [NOMBRE] falou de 2,5 mg por dia.|A Sra. Lima mora na Av. principal.|"Tudo bem?", perguntou ela.|Eu me sinto... não sei, vazio.|Vi filmes, p. ex. comédias.|Você acha mesmo?|Que dia!|Saiu às 7 h.""",
    "fr": """M. Petit et Mme Roy sont venus.|M. [NOMBRE] et Mme [NOMBRE] m'ont parlé.|[NOMBRE] est parti.|« Ça va ? » m'a demandé Luc.|J'ai dormi 4,5 heures, env. la moitié.|Il a dit : « Attends un peu. »|Tu viens ?|Quel jour !|J'ai vu des films, etc. et puis rien.|Je suis… fatigué.""",
    "it": """Il Dott. [NOMBRE] dice che servono 2,5 settimane, ecc. ecc., e basta.|«Come stai?», mi ha chiesto Ugo.|Non so... forse domani.|Che cosa fai?|Che giorno!|Abito in via Po 3.""",
    "de": """Am 12. Mai um 8.30 Uhr war ich da.|Es dauert 2,5 Wochen, d. h. bis zum 3. Oktober, und dann Schluss.|Ich mag z. B. Tee.|„Geht es dir gut?“, fragte Tom.|Was nun?|Halt!|Ich bin... müde.|Wir kauften Brot usw. und gingen.|Er wohnt in Haus 7.""",
    "ca": """El Dr. [NOMBRE] diu que calen 2,5 setmanes.|«Com estàs?», va preguntar la mare.|Què fas?|Quin dia!|No ho sé... potser demà.|Visc al núm. 4.""",
    "ru": """Я сплю 4,5 часа, т. е. мало.|«Как ты?» — спросила мама.|Я не знаю... может быть, завтра.|Что делать?|Стой!|Он сказал: «Подожди.»|Мы взяли хлеб и т. д.|Дома тихо.""",
    "zh": """我每天只睡4.5个小时，很累。|“你好吗？”妈妈问我，我点头。|你说呢？|太好了！|他说：“别担心。”|我说：“没关系。”|我……我也不知道。|今天没有课。""",
    "ja": """毎日4.5時間しか寝ていません。|「大丈夫？」と母に聞かれました。|どうでしょうか？|すごい！|母は「大丈夫。」と言いました。|その…うまく言えません。|今日は休みです。""",
    "ar": """قال د. [NOMBRE] إن الأمر بسيط.|هل تظن ذلك؟|أنام 4.5 ساعات فقط.|لا أعرف... ربما غدا.|يا له من يوم!|قالت لي: "لا تقلق."|أمشي كل صباح.""",
    "hi": """डॉ. [NOMBRE] ने कहा कि समय लगेगा।|क्या यह सच है?|मैं 4.5 घंटे सोता हूँ।|पता नहीं... शायद कल।|मैं घर पर हूँ।|वाह!""",
    "th": """ฉันนอนแค่ 4.5 ชั่วโมงต่อคืน|แม่บอกว่าไม่เป็นไร|ฉันตื่น 3 ครั้งแล้วก็หลับ|วันนี้อากาศดี|คุณคิดอย่างไร|ฉันชอบอ่านหนังสือ""",
}


# More sentences without any punctuation, for the chain over gaps; also written for this file.
BARE = {
    "zh": """我昨天晚上没睡好|他今天不来上课了|你吃过饭了吗|我们一起去图书馆吧|妈妈让我早点回家|我觉得压力很大|老师说下周考试|朋友给我打了电话|天气越来越冷了|我不想让家人担心|这件事我想了很久|最近工作特别忙|她已经毕业两年了|我每天走路上学|房租又涨了|我一个人住在外面|晚上我听音乐放松|你最近怎么样|我真的很累|爸爸在工厂上班
    |我喜欢下雨的日子|周末我在家看书|弟弟考上大学了|我把手机关掉了|奶奶身体不太好|我们吵了一架|后来我们和好了|我不知道该怎么说|心里总是很乱|明天还要早起|这里的人都很好|我想换一个专业|作业还没写完|我开始学做饭|他们都不明白我|有时候我会哭|医生说没有大问题|我慢慢习惯了|大家都在准备考试|我给自己泡了杯茶
    |那天我没有去|我想回老家看看|姐姐下个月结婚|其实我有点害怕|钱总是不够用|室友经常熬夜|我已经好多了|谢谢你听我说|希望一切都会好|我们明年再见|今年冬天来得早|孩子们在楼下玩|他对我很好|我从来没有迟到过|她喜欢唱歌|你可以帮我吗|我刚搬到这个城市|早上我喝一杯咖啡|公司离家很远|我会再试一次
    |虽然外面下着大雨可是我还是走路去了公司|因为昨天加班到很晚所以今天早上起不来|我跟同学商量了半天最后决定换一个题目|自从爸爸生病以后家里的事情都是我来做|如果明天不下雨我们就去山上看日出|每次经过那家书店我都会想起以前的老师|我一边听音乐一边整理房间里的旧东西|他告诉我不管发生什么都不要放弃学习|听说下个学期的学费又要涨价|要是能早一点知道这件事就好了|你觉得是不是应该先跟家里人商量一下|希望弟弟的病能早一点好起来
    |让我最难过的是好朋友突然不跟我说话|一到晚上我就开始担心自己的将来|为了准备面试我把所有的计划都取消了|搬家以后我总是觉得身边少了什么|从小到大我都不敢在很多人面前说话|妹妹说她想去国外学习可是家里没有钱""",
    "ja": """昨日は全然眠れませんでした|今日は学校を休みます|友達が電話をくれました|母は心配しています|試験が近いです|毎朝コーヒーを飲みます|仕事がとても忙しいです|一人で暮らしています|最近疲れています|週末は本を読みます|父は工場で働いています|弟が大学に入りました|雨の日が好きです|何をすればいいか分かりません|先生に相談しました|家賃が高くなりました|祖母の体調がよくないです|夜になると不安になります|少しずつ慣れてきました|音楽を聴くと落ち着きます
    |昨日友達とけんかしました|でも仲直りしました|明日は早く起きます|みんな優しい人です|来月姉が結婚します|料理を始めました|時々泣いてしまいます|お金が足りません|薬は飲んでいません|また頑張ってみます|この町に引っ越しました|会社は家から遠いです|子供たちが外で遊んでいます|宿題がまだ終わりません|散歩に行きましょうか|あなたはどう思いますか|今年の冬は寒いですね|来年また会いましょう|先週映画を見ました|話を聞いてくれてありがとう
    |雨がたくさん降っていたのに会社まで歩いて行きました|昨日遅くまで働いたので今朝は起きられませんでした|父が病気になってから家のことは全部私がしています|明日晴れたら山へ日の出を見に行くつもりです|音楽を聴きながら部屋の古い物を片付けました|来学期の授業料がまた上がるそうです|もっと早く知っていればよかったと思います|先に家族と相談したほうがいいのではないでしょうか|弟の病気が早くよくなってほしいです|一番つらかったのは親友が急に話さなくなったことです|夜になると自分の将来が心配になってしまいます|面接の準備のために全部の予定を取り消しました|引っ越してからいつも何かが足りない気がします|子供の時から人の前で話すのが怖かったです|妹は外国で勉強したいと言っていますがお金がありません|あの本屋の前を通るたびに昔の先生を思い出します""",
}


def compose(rng: random.Random) -> tuple[str, list[int]]:
    """A training document and the ends of its sentences."""
    lang = rng.choice([*SEED, "es", "es", "es"])
    pool = [s.strip() for s in SEED[lang].replace("\n", "").split("|")]
    chosen = [rng.choice(pool) for _ in range(rng.randint(2, 8))]
    style = rng.choice(["plain", "plain", "lower", "lower", "upper", "tight", "lines", "wide", "stray", "speech"])
    if style in ("lower", "upper") and (any("…" in s or "..." in s for s in chosen) or lang in ("zh", "ja", "ar", "hi", "th", "de")):
        style = "plain"
    if style == "speech":
        # Speech of several sentences inside one.
        inner = [s for s in pool if not _QUOTE.search(s) and s[-1] in ".!?。！？।؟"]
        if inner and lang != "th":
            first, last = rng.choice([('"', '"'), ("«", "»"), ("“", "”"), ("(", ")")] if lang not in ("zh", "ja") else [("“", "”"), ("「", "」")])
            lead, rest = {"es": ("Me dijo: ", ", y se fue."), "en": ("He said, ", " and left."), "zh": ("他说", "我点头。"), "ja": ("母は", "と言いました。")}.get(lang, ("Anna: ", ", Anna."))
            chosen[rng.randrange(len(chosen))] = lead + first + ("" if lang in ("zh", "ja") else " ").join(rng.choice(inner) for _ in range(rng.randint(2, 7))) + last + rng.choice([rest, rest, "." if lang not in ("zh", "ja") else "。"])
    if style == "stray":
        # Opening marks that never close, and straight marks that stand for inches.
        k = rng.randrange(len(chosen))
        if '"' not in chosen[k]:
            chosen[k] = rng.choice(["(", "«", "“", '"']) + chosen[k] if rng.random() < 0.5 or lang not in ("es", "en", "pt", "it", "ca") else {"es": 'La pantalla es de 15" y pesa poco.', "en": 'The screen has 15" and works.', "pt": 'A tela tem 15" e pesa pouco.', "it": 'Lo schermo ha 15" e pesa poco.', "ca": 'La pantalla té 15" i pesa poc.'}[lang]
    text, ends = "", []
    for k, s in enumerate(chosen):
        if style == "lower":
            s = _PLACE.sub(lambda m: m.group().upper(), s.lower())
        elif style == "upper":
            s = s.upper()
        elif style == "lines":
            s = s.rstrip(".!?。")
        if k:
            tight = lang in ("zh", "ja") or (style == "tight" and lang != "th" and (s[0].isupper() or s[0] in _OPEN) and text[-1] not in '"”»' and not (text[-3:-2].isspace() and text[-2].isalpha()))
            text += {"lines": "\n", "wide": rng.choice(["   ", "\t", "\n\n", " "])}.get(style, "" if tight else " ")
        text += s
        ends.append(len(text))
    return text, ends


def true_quotations(line: str, ends: set[int], spans: list[tuple[int, int, tuple[str, ...]]]) -> list[int]:
    """Of the possible quotations of a line those that lie in one sentence, the outermost, from left to right."""
    out, reach = [], -1
    for k, (a, b, _) in sorted(enumerate(spans), key=lambda s: (s[1][0], -s[1][1])):
        if a > reach and not any(a < e <= b for e in ends):
            out.append(k)
            reach = b
    return sorted(out)


def stripped(rng: random.Random, lang: str, pool: list[str]) -> tuple[str, list[int]]:
    """One to four sentences without any punctuation and the places of the gaps between them."""
    text, ends = "", []
    for k in range(rng.randint(1, 4)):
        if k:
            ends.append(len(text))
        text += rng.choice(pool)
    return text, ends


def bare_pools(share: tuple[float, float] = (0.0, 1.0)) -> dict[str, list[str]]:
    """Chinese and Japanese sentences of the seeds without punctuation; ``share`` picks a stretch of them (held-out tests)."""
    out = {}
    for lang in ("zh", "ja"):
        raw = re.split(r"[。！？]", SEEDS[lang]) + [s.strip() for s in SEED[lang].replace("\n", "").split("|")]
        flat = [re.sub(r"[^぀-ヿ㐀-鿿]+", "", s) for s in raw] + [s.strip() for s in BARE[lang].split("|")]
        keep = sorted({s for s in flat if len(s) >= 4}, key=lambda s: zlib.crc32(s.encode()))
        out[lang] = keep[int(share[0] * len(keep)) : int(share[1] * len(keep))]
    return out


class Averaged:
    """Weights with their running average."""

    def __init__(self) -> None:
        self.w: dict[str, float] = defaultdict(float)
        self.total: dict[str, float] = defaultdict(float)
        self.steps = 0

    def add(self, changes: dict[str, float]) -> None:
        for f, v in changes.items():
            self.w[f] += v
            self.total[f] += v * self.steps

    def mean(self) -> dict[str, float]:
        return {f: v - self.total[f] / (self.steps + 1) for f, v in self.w.items() if v or self.total[f]}


def _train_marks(documents: int, epochs: int, seed: int) -> dict[str, float]:
    rng = random.Random(seed)
    data = []
    for _ in range(documents):
        text, ends = compose(rng)
        offset = 0
        for line in text.split("\n"):
            marks = places(line)
            if marks:
                known = {e - offset for e in ends if 0 < e - offset <= len(line)}
                spans = quotations(line)
                data.append((line, marks, [int(m[1] in known) for m in marks], spans, true_quotations(line, known, spans)))
            offset += len(line) + 1
    model = Averaged()
    for _ in range(epochs):
        rng.shuffle(data)
        for line, marks, gold, spans, quoted in data:
            model.steps += 1
            guess, took = Tagger(model.w).decode(line, marks)
            if guess == gold and took == quoted:
                continue
            changes: dict[str, float] = defaultdict(float)
            for tags, taken, sign in ((gold, quoted, 1.0), (guess, took, -1.0)):
                held = [(spans[k][0], spans[k][1]) for k in taken]
                old = INSIDE
                for (_, end, fixed, key), tag in zip(marks, tags):
                    if any(a < end - 0.5 < b for a, b in held):
                        continue
                    changes[f"t{old}{tag}"] += sign
                    if tag == BOUNDARY and fixed < 0:
                        for f in _features(key):
                            changes[f] += sign
                    old = tag
                for k in taken:
                    a, b, feats = spans[k]
                    for f in feats:
                        changes[f] += sign
                    changes[f"{feats[0]}|each"] += sign * sum(a < m[1] - 0.5 < b for m in marks)
            model.add({f: v for f, v in changes.items() if v})
    return model.mean()


def _train_gaps(documents: int, epochs: int, seed: int, pools: dict[str, list[str]]) -> dict[str, float]:
    rng = random.Random(seed)
    data = [stripped(rng, lang, pool) for lang, pool in pools.items() for _ in range(documents)]
    model = Averaged()
    for _ in range(epochs):
        rng.shuffle(data)
        for line, gold in data:
            model.steps += 1
            guess = Tagger(model.w).decode_gaps(line, -1.0)
            if guess == gold:
                continue
            changes: dict[str, float] = defaultdict(float)
            for ends, sign in ((gold, 1.0), (guess, -1.0)):
                for k in ends:
                    changes["gap:bias"] += sign
                    for f in _gap_features(line, k):
                        changes[f] += sign
            model.add({f: v for f, v in changes.items() if v})
    return model.mean()


def train(documents: int = 2500, epochs: int = 4, seed: int = 11, pools: dict[str, list[str]] | None = None) -> Tagger:
    """Both chains over composed documents."""
    return Tagger(_train_marks(documents, epochs, seed) | _train_gaps(400, 4, seed, pools or bare_pools()))


_TRAINED: list[Tagger] = []


def tagger() -> Tagger:
    """The trained model; trained once a process."""
    if not _TRAINED:
        _TRAINED.append(train())
    return _TRAINED[0]


def _sentences(weights: dict[str, float], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [model.spans(t) for t in texts]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            flat = np.array([x for spans in found for x in spans], dtype=np.int32).reshape(-1, 2)
            owner = np.repeat(np.arange(len(found)), counts)
            first = np.repeat(np.cumsum(counts) - counts, counts)
            out = [batch.column(0).take(pa.array(owner)), pa.array((np.arange(len(owner)) - first).astype(np.int32)), pa.array(flat[:, 0]), pa.array(flat[:, 1])]
            if with_text:
                out.append(pa.array([t[a:b] for t, spans in zip(texts, found) for a, b in spans], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["ident", "sentence", "sent_start", "sent_end", "sent_text"][: len(out)])

    return run


def split_sentences(df: DataFrame, ident: str = "row_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row a sentence: ``ident``, ``sentence`` (from 0), ``sent_start``, ``sent_end`` and, unless ``with_text`` is off, ``sent_text``. Only the model's weights travel."""
    kind = df.schema[ident].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    made = rows.mapInArrow(_sentences(tagger().w, with_text), f"ident {kind}, sentence int, sent_start int, sent_end int{', sent_text string' if with_text else ''}")
    return made.withColumnRenamed("ident", ident)
