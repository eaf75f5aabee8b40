"""Personal information in free text: found by candidate gradient boosting, replaced by typed placeholders.

High-recall generators propose spans that may overlap: whatever stands around an at sign or a word for it, runs of digits
and of number words, every street word with what follows, runs of capitalised or name-like words. Boosted trees, one set
for each kind, score them by format and context; calibrated thresholds decide; of overlapping spans the surest stays, with
e-mail addresses and street addresses before the names and numbers inside them. The trees are trained here, on sentences
composed from the templates in ``pii_seed`` (the same every time; a quarter of a minute on one core).

Case as evidence: how often a word is written with a capital inside sentences, at their start, and in small letters,
counted over the whole corpus, tells names from words also in texts without capitals. Of the counts those of words are
kept that make up at least ``LEAST_SHARE`` of all words; there can't be more than 1 / ``LEAST_SHARE`` = 500,000 of those, at
any size of the corpus. A rarer word counts as unseen.

Defined results: NULL and blank texts have no mention; placeholders are no mentions; everything outside a mention stays
as it is, byte for byte; repeated rows give equal rows; texts are searched whole.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import pii_seed as seed
from tallyframe.llm.boosting import Boosted
from tallyframe.session import materialise

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
LEAST_SHARE = 2e-6

_L = r"[^\W\d_]"
_PLACE = re.compile(r"\[[^\[\]\n@]{1,40}\]")
_AT, _DOT = r"(?:arroba|\[at\]|\(at\)|\bat\b|chiocciola|arobase|klammeraffe)", r"(?:punto|ponto|point|punkt|\[dot\]|\(dot\)|\bdot\b)"
# A local part starts at the start of its token and has at most 64 characters (RFC 5321), so a long token costs one look.
_EMAIL = re.compile(
    rf"(?<![\w.+-])(?:[\w.+-]{{1,64}} ?@ ?[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,4}}\.[A-Za-z]{{2,24}}|[\w.+-]{{1,64}}(?: {_DOT} [\w+-]{{1,64}}){{0,3}} {_AT} [\w-]{{1,63}}(?: ?{_DOT} ?[\w-]{{1,63}}|\.[\w-]{{1,63}}){{1,3}})", re.IGNORECASE | re.ASCII
)
# Looser: handles, at signs between words, words for the sign without a point after them.
_NEAR_AT = re.compile(r"(?<![\w.+-])[\w.+-]{0,64} ?@ ?[\w-]{1,63}(?:\.[\w-]{1,63}){0,5}", re.IGNORECASE | re.ASCII)
_SAID_AT = re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}} (?:arroba|\[at\]|\(at\)|chiocciola|arobase|klammeraffe) [\w-]{{1,63}}", re.IGNORECASE | re.ASCII)
_AT_WORDS = ("arroba", "[at]", "(at)", " at ", "chiocciola", "arobase", "klammeraffe")
_DIGITS = re.compile(r"(?<![A-Za-zÀ-ɏ0-9_$€£.,/:#-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\) ?)?(?:[A-Za-z]{1,3}-?)?\d+(?:[ .-]{1}\d+){0,6}(?: ?- ?[A-Za-z](?![\w])|[A-Za-z](?!\w))?")
_DIGIT_RUN = re.compile(r"\d(?:[ .()-]{0,2}\d){5,}")
_ANY_DIGIT = re.compile(r"\d")
_NUMBER_WORD = "|".join(sorted(seed.DIGIT_WORDS, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?<!\w)(?:{_NUMBER_WORD})(?:[ ,-]+(?:{_NUMBER_WORD})){{5,}}(?!\w)", re.IGNORECASE)
_STREET = "|".join(sorted(map(re.escape, seed.STREETS), key=len, reverse=True))
_UNIT = r"(?:,? ?(?:apto|apt|apartamento|apartment|piso|torre|int|interior|casa|bloque|of|oficina|local|andar|sala|bl|etg|unit|floor)\.? ?\d+[A-Za-z]?)*"
_NUMBER = r"(?:#|n[o°º]\.?|n\.º|nro\.?|núm\.?|numero|número|nr\.?|num\.?)"
_ADDRESS = re.compile(
    rf"(?<![\w@])(?:{_STREET})\.? {{1,2}}(?:\d{{1,4}}[A-Za-z]?\b(?: bis)?|(?:(?:de|da|do|dos|das|del|la|las|los|el|du|des) )*{_L}[\w'-]*(?: {_L}[\w'-]*){{0,2}}?)"
    rf"(?:,? ?{_NUMBER} ?\d{{1,4}}[A-Za-z]?\b(?: ?- ?\d{{1,3}})?| con (?:{_STREET})\.? ?\d{{1,4}}|,? \d{{1,4}}\b(?: ?- ?\d{{1,3}})?)?{_UNIT}",
    re.IGNORECASE,
)
_HOUSE_FIRST = re.compile(rf"(?<![\w.,#-])\d{{1,5}}[A-Za-z]?,? (?:(?:{'|'.join(seed.FRENCH_STREETS)}) (?:(?:de|du|des|la|le|les) )*{_L}[\w'-]+|(?:{_L}[\w'-]+ ){{1,3}}(?:{'|'.join(seed.ENGLISH_STREETS)})\b\.?){_UNIT}", re.IGNORECASE)
_COMPOUND = re.compile(rf"(?<!\w){_L}+(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer) \d{{1,4}}[a-z]?\b", re.IGNORECASE)
_COMPOUND_END = re.compile(r"(?:straße|strasse|str|gasse|weg|platz|allee|ufer)\Z", re.IGNORECASE)
_HOUSE_WORDS = frozenset({*seed.FRENCH_STREETS, *seed.ENGLISH_STREETS})
_SIGN = re.compile("[\u0300-\u036f]")
_TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+(?:['’-](?:[^\W\d_][\u0300-\u036f]*)+)*")
_PLAIN_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ELIDED = re.compile(r"(?:[jlmntsc]|qu)['’]", re.IGNORECASE)
_END = re.compile(r"[.!?…\n¿¡。！？:«\"“(]")
_GERMAN_NAMING = ("heiße", "heisse", "heißt", "namens")


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    flat = unicodedata.normalize("NFKD", word.lower())
    return flat if flat.isascii() else "".join(c for c in flat if not unicodedata.combining(c))


class Evidence:
    """Counts of a folded word: with a capital inside a sentence, in small letters, with a capital at a start."""

    def __init__(self, counts: dict[str, tuple[int, int, int]] | None = None) -> None:
        self.counts = counts or {}

    def of(self, folded: str) -> tuple[float, float, float]:
        """Share of capitals inside sentences (0.5: unseen), count, and how much more often the word opens sentences than it has a capital inside them (near 1: no name)."""
        a, b, c = self.counts.get(folded, (0, 0, 0))
        return (a + 0.5) / (a + b + 1.0), float(a + b), c / (a + c + 2.0) if c > 2 * a else 0.0


_OPENING = re.compile(r"[.!?…\n¿¡。！？:«\"“(][^\w]*([^\W\d_]+(?:['’-][^\W\d_]+)*)")


def count_case(texts: list[str], into: dict[str, list[int]]) -> None:
    """Add the words of texts to the counts; texts without both cases say nothing, placeholders and e-mail addresses are no words.

    All words are counted at once, and then those at the start of a sentence; what is left of a capital stands inside one.
    """
    kept = []
    for text in texts:
        plain = _PLACE.sub(" ", text) if "[" in text else text
        if "@" in plain or "arroba" in plain or "[at]" in plain:
            plain = _EMAIL.sub(" ", plain)
        if not (plain.islower() or plain.isupper()):
            kept.append(unicodedata.normalize("NFC", plain) if _SIGN.search(plain) else plain)
    whole = "\n".join(["", *kept])
    opening = Counter(_OPENING.findall(whole))
    for word, n in Counter(_PLAIN_TOKEN.findall(whole)).items():
        if word[0].islower():
            into[fold(word)][1] += n
        elif word[0].isupper() and (len(word) == 1 or not word.isupper()):
            counts, first = into[fold(word)], min(n, opening.get(word, 0))
            counts[0] += n - first
            counts[2] += first


class Lexicon:
    def __init__(self, given: list[str]) -> None:
        self.given = frozenset(fold(g) for g in given if g)


GERMAN = frozenset(
    """ich und der die das ist mit nicht mein meine meinem ein eine einem den dem auf für von habe hat war wie wenn vor jedem jeden jede seit am im zu zum zur bei beim aus nach sich mir mich
    sie es wir dass weil dann auch noch nur schon sehr wird kann soll bin mehr keinen kein über ihm ihr""".split()
)


class Word(NamedTuple):
    """What is known of a word whatever its place."""

    folded: str
    given: bool
    common: bool
    title: bool
    capital: bool
    all_capitals: bool
    letters: bool
    share: float
    count: float
    opener: float
    german: bool
    calendar: bool
    street: bool
    digit: bool
    house: bool
    flags: int


def _key(words: list[str], keys: frozenset[str], last: int) -> float:
    """How near the nearest of the keys is, 0 where there is none."""
    for d, w in enumerate(reversed(words[-last:])):
        if w in keys:
            return 1.0 / (1 + d)
    return 0.0


class Prepared:
    """A text with its words: what is known of them and, when they are first asked for, their places."""

    __slots__ = ("_ends", "_starts", "pattern", "regime", "text", "words")

    def __init__(self, text: str, finder: Finder) -> None:
        self.text = text
        self.pattern = _TOKEN if _SIGN.search(text) else _PLAIN_TOKEN
        known = finder.words.get
        self.words = [known(w) or finder.word(w) for w in self.pattern.findall(text)]
        self._starts: list[int] | None = None
        self._ends: list[int] = []
        self.regime = finder.regime(text, self.words)

    @property
    def starts(self) -> list[int]:
        if self._starts is None:
            places = [m.span() for m in self.pattern.finditer(self.text)]
            self._starts, self._ends = [a for a, _ in places], [b for _, b in places]
        return self._starts

    @property
    def ends(self) -> list[int]:
        return self._ends if self._starts is not None else self.starts and self._ends

    def around(self, a: int, b: int, before: int = 6, after: int = 4) -> tuple[list[str], list[str]]:
        """Folded words before and after a span."""
        i, j = bisect_left(self.ends, a + 1), bisect_left(self.starts, b)
        return [w.folded for w in self.words[max(0, i - before) : i]], [w.folded for w in self.words[j : j + after]]

    def opens(self, k: int) -> bool:
        """Whether word ``k`` stands at the start of a sentence."""
        return k == 0 or bool(_END.search(self.text, self.ends[k - 1], self.starts[k]))

    def joined(self, k: int) -> bool:
        """Whether one blank stands between word ``k`` and the next."""
        return k + 1 < len(self.words) and self.starts[k + 1] - self.ends[k] == 1 and self.text[self.ends[k]] == " "


class Finder:
    """Generators, features and models."""

    def __init__(self, models: dict[str, Boosted], odds: dict[str, dict[str, float]], lexicon: Lexicon, evidence: Evidence) -> None:
        self.models, self.odds, self.lexicon, self.evidence = models, odds, lexicon, evidence
        self.words: dict[str, Word] = {}

    def word(self, w: str) -> Word:
        if len(self.words) > 300_000:
            self.words.clear()
        f = fold(w)
        share, count, opener = self.evidence.of(f)
        named = len(w) >= 2 and ord(w[0]) < 0x400 and not _ELIDED.match(w)
        low = w.lower()
        street, digit, house, compound = low in seed.STREETS, low in seed.DIGIT_WORDS, low in _HOUSE_WORDS, bool(_COMPOUND_END.search(w))
        made = self.words[w] = Word(
            f, f in self.lexicon.given, f in seed.COMMON, f in seed.TITLES, w[0].isupper(), w.isupper(), named, share, count, opener, low in GERMAN, f in seed.CALENDAR, street, digit, house, street + 2 * house + 4 * digit + 8 * compound,
        )
        return made

    # Generators ------------------------------------------------------------------------------------------------

    def spans(self, t: Prepared) -> list[tuple[str, int, int]]:
        out, text = [], t.text
        low = text.lower() if "@" not in text else ""
        if "@" in text or any(w in low for w in _AT_WORDS):
            for pattern in (_EMAIL, _NEAR_AT, _SAID_AT):
                for m in pattern.finditer(text):
                    a = m.start()
                    while a < m.end() and text[a] in ".+- ":
                        a += 1
                    if a < m.end():
                        out.append(("email", a, m.end()))
        digits = bool(_ANY_DIGIT.search(text))
        if digits:
            at = 0
            for run in _DIGIT_RUN.finditer(text):
                if run.start() < at:
                    continue
                for m in _DIGITS.finditer(text, max(at, run.start() - 12)):
                    if m.start() >= run.end():
                        break
                    at = m.end()
                    if sum(map(str.isdigit, m.group())) >= 6:
                        out += [("phone", *m.span()), ("id_number", *m.span())]
        kinds = {w.flags for w in t.words}
        street, house = any(k & 1 for k in kinds), any(k & 2 for k in kinds)
        if any(k & 4 for k in kinds) and sum([w.digit for w in t.words]) >= 6:
            for m in _SPOKEN.finditer(text):
                out += [("phone", *m.span()), ("id_number", *m.span())]
        if street:
            at = 0
            for k, w in enumerate(t.words):
                if w.street and t.starts[k] >= at and (m := _ADDRESS.match(text, t.starts[k])):
                    out.append(("address", *m.span()))
                    at = m.end()
        if house and digits:
            out += [("address", *m.span()) for m in _HOUSE_FIRST.finditer(text)]
        if digits and any(k & 8 for k in kinds):
            out += [("address", *m.span()) for k, w in enumerate(t.words) if w.flags & 8 and (m := _COMPOUND.match(text, t.starts[k]))]
        out += [("name", t.starts[i], t.ends[j - 1]) for i, j in self.names(t)]
        return out

    def names(self, t: Prepared) -> list[tuple[int, int]]:
        """Runs of words that may be names, as (first word, end), and all their stretches of up to four words."""
        words, mixed, out = t.words, t.regime == "mixed", []
        if mixed and not any(w.capital and not (w.common and not w.given) for w in words):
            return out
        text, starts, ends = t.text, t.starts, t.ends
        taken = [(m.start(), m.end()) for m in _PLACE.finditer(text)] if "[" in text else []
        where = [a for a, _ in taken]
        last = len(words) - 1
        like = bytearray(len(words))
        some = False
        for k, w in enumerate(words):
            if mixed and not w.capital or w.common and not w.given:
                continue
            ok = False
            if w.letters and not w.title:
                if w.given:
                    ok = not mixed or not w.all_capitals or len(w.folded) > 3
                elif mixed:
                    ok = (not w.all_capitals or len(w.folded) > 3) and ((w.share > 0.1 or w.count < 0.5) and w.opener < 0.7 or not t.opens(k))
                else:
                    ok = (w.share > 0.5 or w.count < 0.5 and len(w.folded) > 3) and w.opener < 0.6
            if not ok and k < last and len(w.folded) >= 3:
                after = words[k + 1]
                ok = (not mixed or after.capital) and after.share > 0.75 and starts[k + 1] - ends[k] == 1 and text[ends[k]] == " "
            if ok and taken:
                p = bisect_left(where, starts[k] + 1) - 1
                ok = p < 0 or starts[k] >= taken[p][1]
            if ok:
                like[k] = some = True
        if not some:
            return out
        k = like.find(1)
        while k >= 0:
            end = k + 1
            while end <= last and like[end] and starts[end] - ends[end - 1] == 1 and text[ends[end - 1]] == " ":
                end += 1
            out += [(i, j) for i in range(k, end) for j in range(i + 1, min(end, i + 4) + 1)]
            if end - k > 4:
                out.append((k, end))
            k = like.find(1, end)
        return out

    # Features --------------------------------------------------------------------------------------------------

    def context(self, t: Prepared, i: int, j: int) -> tuple[str, str, str, str]:
        """Words before (the nearest first) and after the words ``i`` to ``j``, cut at sentence ends."""
        p1 = p2 = "^"
        if not t.opens(i):
            p1 = t.words[i - 1].folded
            p2 = t.words[i - 2].folded if i > 1 else "^"
        n1 = n2 = "$"
        if j < len(t.words) and t.text[t.ends[j - 1] : t.ends[j - 1] + 1] not in ".!?\n":
            n1 = t.words[j].folded
            n2 = t.words[j + 1].folded if j + 1 < len(t.words) else "$"
        return p1, p2, n1, n2

    def features(self, t: Prepared, kind: str, a: int, b: int) -> list[float]:
        text = t.text
        span = text[a:b]
        if kind == "name":
            return self.name_features(t, bisect_left(t.starts, a), bisect_left(t.starts, b))
        left, right = t.around(a, b)
        if kind == "email":
            host = re.split(rf"@|{_AT}", span, maxsplit=1, flags=re.I)[-1].strip()
            return [
                float("@" in span), float(len(span)), float(host.count(".")), float(bool(re.search(_AT, span, re.I))), float(len(re.findall(_DOT, host, re.I))), float(len(span.split())), _key(left, seed.MAIL_KEYS, 4),
                float(span[:1] == "@"), float(len(host)), float(bool(re.search(r"[.t] ?[A-Za-z]{2,24}\Z", host))), float(text[b : b + 1] == "."), float(span.count(" @") + span.count("@ ")), float(any(c.isdigit() for c in span)),
            ]
        if kind in ("phone", "id_number"):
            digits = re.sub(r"\D", "", span)
            sizes = [len(g) for g in re.findall(r"\d+", span)]
            before, after = text[max(0, a - 2) : a], text[b : b + 2]
            return [
                float(len(digits)), float(span[:1] == "+"), float("(" in span), float(len(sizes)), float(max(sizes, default=0)), float(sizes[-1] if sizes else 0), float("." in span), float("-" in span), float(" " in span),
                float(span[:1].isalpha() and len(digits) > 0), float(span[-1:].isalpha() and len(digits) > 0), float(int(digits[0]) if digits else -1), float(len(digits) == 0), float(all(s == 3 for s in sizes[1:]) and len(sizes) > 2),
                _key(left, seed.ID_KEYS, 4), _key(left, seed.PHONE_KEYS, 5), _key(right[:3][::-1], seed.PHONE_KEYS, 3), float(any(c in before for c in "$€£")), float(bool(right[:1]) and right[0] in seed.UNITS), float(len(left) > 0 and left[-1] in seed.UNITS),
                float(bool(re.fullmatch(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2}", span))), float(len(span)), float(after[:1] in ("%", "/", ":")), float(bool(re.fullmatch(r"\d{3}-\d{2}-\d{4}", span))),
            ]
        words = [w for w in t.words[bisect_left(t.starts, a) : bisect_left(t.starts, b)]]
        first = words[0].folded if words else ""
        return [
            float(any(c.isdigit() for c in span)), float(len(re.findall(r"\d+", span))), float("#" in span), float(bool(re.search(_NUMBER, span, re.I))), float(" con " in span), float(len(span)), float(span[:1].isdigit()), float(span[:1].isupper()),
            float(any(w.capital for w in words[1:])), float(bool(re.search(r"\d\s*-\s*\d", span))), _key(left, seed.PLACE_KEYS, 3), float(bool(left) and left[-1] in ("la", "las", "una", "the", "uma", "die")), float(first in ("carrera", "calle", "avenida", "via", "st", "cr", "av", "cl")),
            float(bool(re.search(r",? \d{1,4}\b", span))), float(len(words)), words[1].share if len(words) > 1 else 0.5, float(bool(_COMPOUND.fullmatch(span))), float(bool(right[:1]) and right[0] in seed.UNITS), float(words[1].common) if len(words) > 1 else 0.0,
        ]

    def name_features(self, t: Prepared, i: int, j: int) -> list[float]:
        text, words, odds = t.text, t.words[i:j], self.odds
        first, last = words[0], words[-1]
        mixed = t.regime == "mixed"
        initial = t.opens(i)
        p1, p2, n1, n2 = self.context(t, i, j)
        runs_on = t.joined(j - 1) and (t.words[j].capital if mixed else t.words[j].share > 0.6)
        before = t.words[i - 1] if i else None
        follows_capital = before is not None and not initial and t.joined(i - 1) and mixed and before.capital and not before.title
        german = sum(w.german for w in t.words[max(0, i - 12) : i]) + sum(w.german for w in t.words[j : j + 12])
        announced = before is not None and (before.title or before.folded in _GERMAN_NAMING)
        glue = text[t.ends[j - 1] : t.ends[j - 1] + 1]
        return [
            float(len(words)), float(first.given), float(sum(w.given for w in words[1:])), first.share, first.opener, last.share, float(initial), float(mixed), float(t.regime == "upper"),
            odds["p1"].get(p1, 0.0), odds["p2"].get(f"{p2} {p1}", 0.0), odds["n1"].get(n1, 0.0), odds["n2"].get(f"{n1} {n2}", 0.0), float(runs_on), float(follows_capital),
            float(before is not None and before.title), float(german), float(first.calendar), float(len(first.folded)), float(first.common), float(last.common), float(glue == ","), min(w.share for w in words),
            float(first.title), float(any(w.street or w.folded in seed.STREET_WORDS for w in words)), float(german > 1 and not announced and not first.given and not runs_on and not follows_capital and len(words) == 1), first.count,
        ]

    # Decision --------------------------------------------------------------------------------------------------

    @staticmethod
    def regime(text: str, words: list[Word]) -> str:
        """Lower, upper (but for a fiftieth of small letters) or mixed case; placeholders and e-mail addresses do not count."""
        plain = _EMAIL.sub(" ", _PLACE.sub(" ", text)) if "@" in text or "[" in text else text
        if plain.islower():
            return "lower"
        if plain.isupper():
            return "upper"
        small = sum([not w.all_capitals for w in words])
        if small * 3 > len(words) and len(text) < 12 * len(words):
            return "mixed"
        ups, downs = sum(map(str.isupper, plain)), sum(map(str.islower, plain))
        return "upper" if ups and downs <= 0.02 * ups else "mixed"

    def candidates(self, text: str) -> list[tuple[str, int, int, list[float]]]:
        t = Prepared(text, self)
        return [(k, a, b, self.features(t, k, a, b)) for k, a, b in sorted(set(self.spans(t)))]

    def decide(self, scored: list[tuple[float, str, int, int]]) -> list[tuple[int, int, str, float]]:
        """Of overlapping spans the surest; e-mail addresses and street addresses come before numbers, numbers before names."""
        rank = {"email": 3, "address": 2, "phone": 1, "id_number": 1, "name": 0}
        taken: list[tuple[int, int, str, float]] = []
        covered = bytearray(max((s[3] for s in scored), default=0))
        for p, kind, a, b in sorted(scored, key=lambda s: (-rank[s[1]], -round(s[0], 3), -(s[3] - s[2]), s[2])):
            if not any(covered[a:b]):
                covered[a:b] = b"\1" * (b - a)
                taken.append((a, b, kind, p))
        return sorted(taken)

    def mentions(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Mentions of many texts; the trees run over all candidates of a kind at once."""
        found = [self.candidates(t) for t in texts]
        scored: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
        for kind in KINDS:
            where = [(n, c) for n, cands in enumerate(found) for c in cands if c[0] == kind]
            if not where:
                continue
            model = self.models[kind]
            for (n, (_, a, b, _)), p in zip(where, model.probability(np.array([c[3] for _, c in where]))):
                if p >= model.threshold:
                    scored[n].append((float(p), kind, a, b))
        return [self.decide(s) for s in scored]


def _odds(rows: list[tuple[str, int]]) -> dict[str, float]:
    count: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for key, y in rows:
        count[key][y] += 1
    total = [sum(c[y] for c in count.values()) + 1 for y in (0, 1)]
    return {k: float(np.log((c[1] + 0.5) / total[1]) - np.log((c[0] + 0.5) / total[0])) for k, c in count.items() if sum(c) >= 3}


def train(given: list[str], documents: int = 14000, random_seed: int = 23) -> tuple[dict[str, Boosted], dict[str, dict[str, float]]]:
    """Models and context odds from composed documents."""
    rng = random.Random(random_seed)
    composed = [seed.compose(rng, given) for _ in range(documents)]
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    count_case([text for text, _ in composed], counts)
    # Some words stay unseen, as in a small corpus.
    evidence = Evidence({w: tuple(c) for w, c in counts.items() if rng.random() > 0.1})
    empty: dict[str, dict[str, float]] = {"p1": {}, "p2": {}, "n1": {}, "n2": {}}
    finder = Finder({}, empty, Lexicon(given), evidence)
    # Context odds come from the first half of the documents, trees from the second, so that odds are not learned by heart.
    half = documents // 2
    rows: dict[str, list[tuple[str, int]]] = {k: [] for k in empty}
    for text, gold in composed[:half]:
        truth = {(a, b) for kind, a, b in gold if kind == "name"}
        t = Prepared(text, finder)
        for i, j in finder.names(t):
            a, b = t.starts[i], t.ends[j - 1]
            y = int((a, b) in truth)
            if not y and any(a < e and s < b for s, e in truth):
                continue
            p1, p2, n1, n2 = finder.context(t, i, j)
            for name, key in (("p1", p1), ("p2", f"{p2} {p1}"), ("n1", n1), ("n2", f"{n1} {n2}")):
                rows[name].append((key, y))
    finder.odds = {k: _odds(v) for k, v in rows.items()}
    x: dict[str, list[list[float]]] = {k: [] for k in KINDS}
    y: dict[str, list[int]] = {k: [] for k in KINDS}
    for text, gold in composed[half:]:
        truth = {(kind, a) for kind, a, _ in gold}
        exact = {(a, b) for kind, a, b in gold if kind == "name"}
        for kind, a, b, feats in finder.candidates(text):
            if kind == "name":
                # Contexts that say nothing: the trees must not lean on one side alone.
                for side in ((9, 10), (11, 12)):
                    if rng.random() < 0.2:
                        for k in side:
                            feats[k] = 0.0
            x[kind].append(feats)
            y[kind].append(int((a, b) in exact if kind == "name" else (kind, a) in truth))
    models = {k: Boosted(rounds=70, least=15).fit(np.array(x[k]), np.array(y[k])) for k in KINDS}
    return models, finder.odds


_TRAINED: dict[tuple, tuple] = {}


def models_for(given: list[str]) -> tuple[dict[str, Boosted], dict[str, dict[str, float]]]:
    key = tuple(sorted(given))
    if key not in _TRAINED:
        _TRAINED[key] = train(list(key))
    return _TRAINED[key]


#: Distinct words a task counts before it hands its counts on.
MOST_WORDS = 500_000


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

    def rows() -> pd.DataFrame:
        found = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 3)
        return pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "capital": found[:, 0], "small": found[:, 1], "initial": found[:, 2]})

    for batch in batches:
        count_case(batch["text"].tolist(), counts)
        if len(counts) > MOST_WORDS:
            yield rows()
            counts.clear()
    yield rows()


def case_evidence(df: DataFrame, text: str = "text") -> Evidence:
    """Counts over all texts; of the words those reach the driver that make up at least ``LEAST_SHARE`` of all, at most 1 / ``LEAST_SHARE``."""
    rows = df.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    names = ("capital", "small", "initial")
    counted = materialise(rows.mapInPandas(_count_words, "word string, capital bigint, small bigint, initial bigint").groupBy("word").agg(*[F.sum(n).alias(n) for n in names]), "words")
    seen = F.col("capital") + F.col("small") + F.col("initial")
    total = counted.agg(F.sum(seen)).first()[0] or 0
    kept = counted.where(seen >= LEAST_SHARE * total).toPandas()
    return Evidence(dict(zip(kept["word"], zip(*(kept[n].tolist() for n in names)))))


def _find(models, odds, given: list[str], shared, chunk: int = 2000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(models, odds, Lexicon(given), Evidence(shared.value))
        for batch in batches:
            for s in range(0, len(batch), chunk):
                part = batch.iloc[s : s + chunk]
                out = []
                for ident, text, found in zip(part["ident"], part["text"], finder.mentions(part["text"].tolist())):
                    out += [(ident, kind, a, b, text[a:b], round(p, 4)) for a, b, kind, p in found]
                yield pd.DataFrame(out, columns=["ident", "kind", "char_start", "char_end", "mention", "confidence"])

    return run


def _redact(models, odds, given: list[str], shared, chunk: int = 2000):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(models, odds, Lexicon(given), Evidence(shared.value))
        for batch in batches:
            for s in range(0, len(batch), chunk):
                part = batch.iloc[s : s + chunk]
                texts = [t or "" for t in part["text"]]
                out = []
                for text, found in zip(texts, finder.mentions(texts)):
                    at, pieces = 0, []
                    for a, b, kind, _ in found:
                        pieces += [text[at:a], PLACEHOLDER[kind]]
                        at = b
                    out.append("".join(pieces) + text[at:])
                plain = [None if t is None else o for t, o in zip(part["text"], out)]
                yield pd.DataFrame({"ident": part["ident"].to_numpy(), "redacted": pd.Series(plain, dtype=object)})

    return run


#: Given names are collected; more than these are refused, not cut.
MOST_NAMES = 100_000


def _prepare(df: DataFrame, names: DataFrame, text: str):
    rows = names.select("given_name").where(F.col("given_name").isNotNull()).distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names: they are held by every worker")
    given = sorted(r[0] for r in rows)
    models, odds = models_for(given)
    return models, odds, given, df.sparkSession.sparkContext.broadcast(case_evidence(df, text).counts)


def find_mentions(df: DataFrame, names: DataFrame, ident: str = "row_id", text: str = "text") -> DataFrame:
    """One row a mention: ``ident``, ``kind``, ``char_start``, ``char_end``, ``mention``, ``confidence``."""
    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    made = rows.mapInPandas(_find(*_prepare(df, names, text)), f"ident {kind}, kind string, char_start int, char_end int, mention string, confidence double")
    return made.withColumnRenamed("ident", ident)


def redact(df: DataFrame, names: DataFrame, ident: str = "row_id", text: str = "text") -> DataFrame:
    """``ident`` and ``redacted``: each text with typed placeholders; NULL stays NULL."""
    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    return rows.mapInPandas(_redact(*_prepare(df, names, text)), f"ident {kind}, redacted string").withColumnRenamed("ident", ident)
