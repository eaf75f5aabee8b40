"""Languages of documents and of their segments, by a byte convolutional network.

The network looks at windows of 64 bytes: an embedding of each byte, filters of widths 2 to 5, maximum over the window,
softmax over 13 languages. It is trained here in numpy, on the seed texts and on a bounded sample of labelled rows (at
most ``per_lang`` rows a label, of 20 to 4000 characters, by hash). Labels are often wrong, so the network first learns from
the seeds, keeps the sampled sentences whose label it finds plausible (or doubts only between sentences it is sure of),
learns again, keeps those it agrees with, and learns once more.

Each document is cut into sentences; a sentence's score is the mean over its windows; a chain over the sentences with a
price for each change of language smooths them. Neighbouring sentences of one language form a segment. A language is in
a document if all of it, or at least two neighbouring sentences, are in it; a shorter stretch counts to the text around
it. Where no language has two neighbouring sentences, the document has the one most of its letters are in.

The label has no part in the decision; it only serves to choose training rows, and afterwards to tell the cases. Equal
sentences are scored once a task (a bounded memory, emptied when full, that never changes a score).

Before scoring, bracketed placeholders, tags, addresses, digits and short quotations inside a longer sentence go.

Defined results: NULL and letterless texts have no segment; labels count in any case, with a region, or as three
letters; texts of any length are scored whole; repeated rows give equal rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.langid_seed import SEEDS
from tallyframe.llm.sentences import Tagger, tagger

LANGS = list(SEEDS)
# Three-letter codes of the languages.
THREE = {"spa": "es", "eng": "en", "por": "pt", "cat": "ca", "fra": "fr", "fre": "fr", "ita": "it", "deu": "de", "ger": "de", "rus": "ru", "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja", "ara": "ar", "hin": "hi", "tha": "th"}
NO_LANGUAGE = ["", "und", "unknown", "unk", "none", "null", "nan", "na", "n/a", "mul", "mis", "zxx", "xx", "?"]

WINDOW, WIDTHS = 64, (2, 3, 4, 5)
_DROP = re.compile(r"\[[^\[\]\n]{1,40}\]|<[^<>\n]{1,60}>|https?://\S+|(?<!\S)\S{1,64}@\S+|#\w+|[\d_]+")
_QUOTED = re.compile(r"\"[^\"\n]{1,60}\"|«[^»\n]{1,60}»|“[^”\n]{1,60}”|„[^“\n]{1,60}“|「[^」\n]{1,40}」")
_MAY_DROP = re.compile(r"[\[<@#_\d/]")


def code_of(label: Column) -> Column:
    """Two-letter code of a label, NULL where it names no language; other codes stay as they are."""
    plain = F.element_at(F.split(F.lower(F.trim(F.regexp_replace(label, r"(?U)\s+", " "))), "[-_ .]"), 1)
    known = F.create_map(*[F.lit(x) for pair in THREE.items() for x in pair])
    return F.when(label.isNotNull() & ~plain.isin(NO_LANGUAGE), F.coalesce(known[plain], plain))


def clean(sentence: str) -> str:
    text = sentence.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if _MAY_DROP.search(text):
        text = _DROP.sub(" ", text)
    if any(c in text for c in '"«“„「'):
        rest = _QUOTED.sub(" ", text)
        if sum(map(str.isalpha, rest)) >= 12:
            text = rest
    return " ".join(text.split())


def windows(text: str) -> list[bytes]:
    """Windows of ``WINDOW`` bytes over the whole text; the last one reaches back so as to be full."""
    raw = text.encode()
    if len(raw) <= WINDOW:
        return [raw]
    starts = list(range(0, len(raw) - WINDOW + 1, WINDOW))
    if starts[-1] + WINDOW < len(raw):
        starts.append(len(raw) - WINDOW)
    return [raw[s : s + WINDOW] for s in starts]


def matrix(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), WINDOW)


class ByteNet:
    """Embedding, multi-width filters, max pooling, softmax; Adam on cross entropy."""

    def __init__(self, dim: int = 8, filters: int = 24, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.filters = dim, filters
        self.p = {"E": rng.normal(0, 0.5, (256, dim)), "W": rng.normal(0, 0.1, (filters * len(WIDTHS), len(LANGS))), "c": np.zeros(len(LANGS))}
        for w in WIDTHS:
            self.p[f"K{w}"] = rng.normal(0, (2 / (w * dim)) ** 0.5, (w * dim, filters))
            self.p[f"b{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pool(self, x: np.ndarray):
        """Maxima of each filter over a window and their places; places come last in memory, where looking for a maximum is cheapest."""
        e = self.p["E"][x]
        pooled, at = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            col = np.concatenate([e[:, k : k + n] for k in range(w)], axis=2).reshape(-1, w * self.dim)
            out = (self.p[f"K{w}"].T @ col.T).reshape(-1, n)
            where = out.argmax(1)
            pooled.append(out[np.arange(len(out)), where].reshape(self.filters, -1).T + self.p[f"b{w}"])
            at.append(where.reshape(self.filters, -1).T)
        return np.concatenate(pooled, 1), at

    def merged(self) -> np.ndarray:
        """The filters of all widths side by side, as one matrix over as many bytes as the widest sees."""
        widest = max(WIDTHS)
        out = np.zeros((widest * self.dim, self.filters * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            out[: w * self.dim, k * self.filters : (k + 1) * self.filters] = self.p[f"K{w}"]
        return out

    def log_probs(self, x: np.ndarray, batch: int = 64) -> np.ndarray:
        """Log probabilities of windows: one product for the filters of all widths, then each width's maximum over its own places."""
        kernel, bias, widest, f = self.merged(), np.concatenate([self.p[f"b{w}"] for w in WIDTHS]), max(WIDTHS), self.filters
        places, out = WINDOW - min(WIDTHS) + 1, []
        room = np.zeros((batch, places + widest - 1, self.dim), np.float32)
        for s in range(0, len(x), batch):
            rows = x[s : s + batch]
            e = room[: len(rows)]
            e[:, :WINDOW] = self.p["E"][rows]
            seen = np.lib.stride_tricks.as_strided(e, (len(rows), places, widest * self.dim), (e.strides[0], e.strides[1], e.strides[2]))
            got = (seen.reshape(-1, widest * self.dim) @ kernel).reshape(len(rows), places, -1)
            pooled = got[:, : WINDOW - widest + 1].max(1)
            for k, w in enumerate(WIDTHS):
                for at in range(WINDOW - widest + 1, WINDOW - w + 1):
                    np.maximum(pooled[:, k * f : (k + 1) * f], got[:, at, k * f : (k + 1) * f], out=pooled[:, k * f : (k + 1) * f])
            pooled += bias
            z = np.maximum(pooled, 0) @ self.p["W"] + self.p["c"]
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(LANGS)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.004, batch: int = 128, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                xb = x[pick]
                pooled, at = self._pool(xb)
                h = np.maximum(pooled, 0)
                keep = (rng.random(h.shape) > 0.2).astype(np.float32) / 0.8
                z = (h * keep) @ self.p["W"] + self.p["c"]
                z -= z.max(1, keepdims=True)
                q = np.exp(z)
                q /= q.sum(1, keepdims=True)
                q[np.arange(len(pick)), y[pick]] -= 1
                q /= len(pick)
                g = {"W": (h * keep).T @ q, "c": q.sum(0), "E": np.zeros(self.p["E"].size)}
                columns = np.arange(self.dim)
                dh = (q @ self.p["W"].T) * keep * (pooled > 0)
                for k, w in enumerate(WIDTHS):
                    d = dh[:, k * self.filters : (k + 1) * self.filters]
                    where = xb[np.arange(len(pick))[:, None, None], at[k][:, :, None] + np.arange(w)].astype(np.int64)
                    g[f"K{w}"] = np.einsum("bf,bfc->cf", d, self.p["E"][where].reshape(len(pick), self.filters, -1))
                    g[f"b{w}"] = d.sum(0)
                    back = (d[:, :, None] * self.p[f"K{w}"].T[None]).reshape(len(pick), self.filters, w, self.dim)
                    g["E"] += np.bincount((where.reshape(-1, 1) * self.dim + columns).ravel(), back.ravel(), g["E"].size)
                g["E"] = g["E"].reshape(self.p["E"].shape).astype(np.float32)
                step += 1
                for name, a in self.p.items():
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                    a -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
            rate *= 0.7


def _examples(pairs: list[tuple[str, str]], stride: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    parts, labels = [], []
    for lang, text in pairs:
        plain = clean(text)
        raw = plain.encode()
        for w in windows(plain) if stride == WINDOW else [raw[s : s + WINDOW] for s in range(0, max(1, len(raw) - WINDOW // 2), stride)]:
            if len(w) >= 12:
                parts.append(w)
                labels.append(LANGS.index(lang))
    return matrix(parts), np.array(labels)


def _balanced(x: np.ndarray, y: np.ndarray, each: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``each`` rows of every language, drawn with replacement where there are fewer."""
    pick = [rng.choice(own, each, replace=len(own) < each) for k in range(len(LANGS)) if len(own := np.flatnonzero(y == k))]
    pick = np.concatenate(pick)
    return x[pick], y[pick]


def train(labelled: list[tuple[str, str]], model: Tagger, most_windows: int = 60_000, seed: int = 17) -> ByteNet:
    """The network from seed texts and labelled texts (language, text); at most ``most_windows`` windows of the latter.

    A labelled sentence is kept where the network so far finds its label plausible, or where it doubts it between
    sentences of the same text that it is sure of.
    """
    rng = np.random.default_rng(seed)
    sx, sy = _examples(list(SEEDS.items()), stride=13)
    net = ByteNet()
    net.fit(*_balanced(sx, sy, 300, rng), 12)
    parts, owner, said, ends = [], [], [], []
    for k in rng.permutation(len(labelled)):
        lang, text = labelled[k]
        if len(parts) >= most_windows:
            break
        for a, b in model.spans(text):
            mine = [w for w in windows(clean(text[a:b])) if len(w) >= 12]
            if mine:
                parts += mine
                owner += [len(said)] * len(mine)
                said.append(LANGS.index(lang))
        ends.append(len(said))
    if not parts:
        return net
    x, owner, said = matrix(parts), np.array(owner), np.array(said)
    each_has = np.bincount(owner, minlength=len(said))[:, None]
    first = np.zeros(len(said) + 1, bool)
    first[[0, *ends]] = True
    for ratio, each, epochs in ((0.5, 500, 2), (0.5, 800, 2), (1.0, 1200, 4)):
        score = np.zeros((len(said), len(LANGS)))
        np.add.at(score, owner, net.log_probs(x))
        score = np.exp(score / each_has)
        own = score[np.arange(len(said)), said] / score.max(1)
        sure = own >= 1.0
        beside = np.ones(len(said), bool)
        beside[1:] &= first[1:-1] | sure[:-1]
        beside[:-1] &= first[1:-1] | sure[1:]
        beside &= ~(first[:-1] & first[1:])
        keep = ((own >= ratio) | beside & (own >= 0.02))[owner]
        bx, by = _balanced(x[keep], said[owner][keep], each, rng)
        tx, ty = _balanced(sx, sy, 80, rng)
        net.fit(np.concatenate([bx, tx]), np.concatenate([by, ty]), epochs)
    return net


_TRAINED: dict[tuple, ByteNet] = {}


def fit_on(docs: DataFrame, text: str = "text", label: str = "lang", ident: str = "doc_id", per_lang: int = 500) -> ByteNet:
    """Train on the seeds and on at most ``per_lang`` labelled rows of each language, chosen by a hash of text and id."""
    order = Window.partitionBy("code").orderBy(F.xxhash64("id", "text"), "id")
    rows = docs.select(code_of(F.col(label)).alias("code"), F.col(ident).alias("id"), F.col(text).alias("text")).where(F.col("code").isin(LANGS) & F.col("text").isNotNull() & (F.char_length("text").between(20, 4000)))
    sample = sorted((r["code"], r["text"]) for r in rows.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= per_lang).select("code", "text").collect())
    key = (len(sample), hash(tuple(sample)))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = train(sample, tagger())
    return _TRAINED[key]


def smooth(scores: np.ndarray, change: float = 4.0) -> np.ndarray:
    """Viterbi over the sentences of a document; a change of language costs ``change``."""
    alone = scores.argmax(1)
    if (alone == alone[0]).all():
        return alone
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - change
        back.append(np.where(stay, np.arange(len(row)), top))
        best = np.where(stay, best, best[top] - change) + row
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return np.array(path[::-1])


def long_runs(path: np.ndarray, letters: np.ndarray) -> list[tuple[int, int, int]]:
    """(first sentence, end, language) of the runs of a path; a run of one sentence joins the long run before it, the first ones the long run after them.

    One pass: short runs never split a long one, as equal neighbours are one run. Where there is no long run, all sentences have the language
    most of the letters are in.
    """
    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
    runs = [(a, b, int(path[a])) for a, b in zip(cuts, cuts[1:])]
    if len(runs) == 1:
        return runs
    kept = [r for r in runs if r[1] - r[0] >= 2]
    if not kept:
        return [(0, len(path), int(np.bincount(path, weights=letters, minlength=len(LANGS)).argmax()))]
    out: list[tuple[int, int, int]] = []
    for a, b, lang in kept:
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], b, lang)
        else:
            out.append((a if out else 0, b, lang))
    edges = [a for a, _, _ in out] + [len(path)]
    return [(a, b, lang) for (a, _, lang), b in zip(out, edges[1:])]


def segment(spans: list[tuple[int, int]], letters: np.ndarray, scores: np.ndarray) -> list[list]:
    """[start, end, language, letters, sentences, confidence] of each stretch in one language."""
    path = smooth(np.maximum(scores, -8.0) * np.minimum(1.0, letters / 10.0)[:, None])
    out = []
    for a, b, lang in long_runs(path, letters):
        weight = letters[a:b]
        sure = float((np.exp(scores[a:b, lang]) * weight).sum() / max(weight.sum(), 1e-9))
        out.append([spans[a][0], spans[b - 1][1], lang, int(weight.sum()), b - a, round(sure, 4)])
    return out


#: Distinct sentences a task remembers the scores of before it forgets them all.
REMEMBERED = 100_000


class Scorer:
    """Number of letters and mean log probabilities of sentences; equal ones are scored once."""

    def __init__(self, net: ByteNet) -> None:
        self.net, self.known = net, {}

    def learn(self, sentences: set[str]) -> None:
        new = [s for s in sentences if s not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(sentences)
        parts, owner, letters = [], [], []
        for k, raw in enumerate(new):
            plain = clean(raw)
            n = sum(map(str.isalpha, plain))
            letters.append(n)
            if n:
                mine = windows(plain)
                parts += mine
                owner += [k] * len(mine)
        sums = np.zeros((len(new), len(LANGS)))
        if parts:
            np.add.at(sums, owner, self.net.log_probs(matrix(parts)))
            sums /= np.maximum(1, np.bincount(owner, minlength=len(new)))[:, None]
        self.known.update(zip(new, zip(letters, sums)))


def _segments(weights: dict[str, float], net: ByteNet, chunk: int = 500):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, scorer = Tagger(weights), Scorer(net)
        for whole in batches:
            for s in range(0, len(whole), chunk):
                batch = whole.iloc[s : s + chunk]
                docs = [(ident, label, text, model.spans(text)) for ident, label, text in zip(batch["ident"], batch["label"], batch["text"])]
                scorer.learn({text[a:b] for _, _, text, spans in docs for a, b in spans})
                known = [scorer.known[text[a:b]] for _, _, text, spans in docs for a, b in spans]
                letters = np.array([n for n, _ in known], dtype=float)
                scores = np.stack([v for _, v in known]) if known else np.zeros((0, len(LANGS)))
                alone = np.where(letters > 0, scores.argmax(1), -1).tolist() if known else []
                letters_to = np.concatenate([[0.0], np.cumsum(letters)]).tolist()
                surest_to = np.concatenate([[0.0], np.cumsum(np.exp(scores.max(1)) * letters)]).tolist() if known else [0.0]
                out, at = [], 0
                for ident, label, text, every in docs:
                    end = at + len(every)
                    mine = alone[at:end]
                    langs = set(mine)
                    langs.discard(-1)
                    if langs:
                        if len(langs) == 1:
                            # One language throughout: no path can be better.
                            n = letters_to[end] - letters_to[at]
                            where = [k for k, x in enumerate(mine) if x >= 0]
                            found = [[every[where[0]][0], every[where[-1]][1], langs.pop(), int(n), len(where), round((surest_to[end] - surest_to[at]) / n, 4)]]
                        else:
                            heard = np.array(mine) >= 0
                            found = segment([x for x, h in zip(every, heard) if h], letters[at:end][heard], scores[at:end][heard])
                        total: dict[int, int] = {}
                        for r in found:
                            total[r[2]] = total.get(r[2], 0) + r[3]
                        main = max(total, key=lambda k: (total[k], -k))
                        for k, (a, b, lang, n, sents, sure) in enumerate(found):
                            out.append((ident, label, k, a, b, LANGS[lang], sure, n, sents, LANGS[main], len(total)))
                    at = end
                if out:
                    yield pd.DataFrame(out, columns=["ident", "label", "segment", "char_start", "char_end", "seg_lang", "confidence", "letters", "sentences", "doc_lang", "doc_langs"])

    return run


def identify(docs: DataFrame, net: ByteNet, ident: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """One row a segment: ``ident``, the label's ``code``, ``segment``, places, ``seg_lang``, ``confidence``, ``letters``, ``sentences``, ``doc_lang`` and ``doc_langs``."""
    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(F.col(ident).alias("ident"), code_of(F.col(label)).alias("label"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    fields = f"ident {kind}, label string, segment int, char_start int, char_end int, seg_lang string, confidence double, letters bigint, sentences int, doc_lang string, doc_langs int"
    return rows.mapInPandas(_segments(tagger().w, net), fields).withColumnsRenamed({"ident": ident, "label": "code"})


def doubtful(segments: DataFrame, ident: str = "doc_id") -> DataFrame:
    """A row for each language of each document whose label is missing, wrong, or not the whole truth."""
    case = F.col("code").isNull() | (F.col("code") != F.col("doc_lang")) | (F.col("doc_langs") > 1)
    return segments.where(case).select(ident, "seg_lang").distinct()
