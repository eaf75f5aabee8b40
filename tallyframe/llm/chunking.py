"""Cut oversized texts at natural boundaries, by lexical cohesion.

White space runs are made single blanks first; the limit holds for that form. Every sentence end is a gap. The
similarity of the blocks of words before and after a gap gives a curve whose valleys are topic boundaries; in the
window of sizes a piece may have, the deepest valley is cut. Without a sentence end in the window the last blank is cut,
without a blank the limit itself (never between a letter and its marks). The next piece begins about ``overlap``
characters before the cut, at the nearest word start.

Defined results: NULL, blank and short texts have one piece or none and do not count as oversized; the text is whole,
never a prefix; repeated rows give equal pieces once each row id; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"(?U)[\s ]+"
_BLANK = re.compile(r"[\s ]+")
_GAP = re.compile(r"[.!?…。！？।؟]+[\"'»”’)\]」』]*(?=\s|[。！？]|[^\x00-\x7f])\s?|[。！？।]+[」』”’]*")
_TOKEN = re.compile(r"[^\W\d_]+")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def collapse(text: str) -> str:
    return _BLANK.sub(" ", text).strip(" ")


def valley_depths(text: str, gaps: list[int], block: int) -> np.ndarray:
    """Depth of the similarity curve at each gap: how far it lies under the peaks on either side."""
    words, ends = [], []
    ids: dict[str, int] = {}
    for m in _TOKEN.finditer(text.lower()):
        w = m.group()
        for part in [w] if len(w) < 12 or ord(w[0]) < 0x0E00 else [w[i : i + 2] for i in range(0, len(w), 2)]:
            words.append(ids.setdefault(part, len(ids)))
            ends.append(m.end())
    if not words or not gaps:
        return np.zeros(len(gaps))
    seq, end = np.array(words), np.array(ends)
    near = np.empty(len(gaps))
    for k, gap in enumerate(gaps):
        at = int(np.searchsorted(end, gap, side="right"))
        a, b = Counter(seq[max(0, at - block) : at].tolist()), Counter(seq[at : at + block].tolist())
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        near[k] = sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0
    left, right = near.copy(), near.copy()
    for k in range(1, len(near)):
        left[k] = max(near[k], left[k - 1]) if near[k - 1] >= near[k] else near[k]
        j = len(near) - 1 - k
        right[j] = max(near[j], right[j + 1]) if near[j + 1] >= near[j] else near[j]
    return (left - near) + (right - near)


def _safe(text: str, at: int) -> int:
    while 0 < at < len(text) and (unicodedata.combining(text[at]) or unicodedata.category(text[at]) in ("Mn", "Mc", "Me", "Cf")):
        at -= 1
    return at


def cut(text: str, limit: int, overlap: int, least: float = 0.5, block: int = 30) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a collapsed text; each at most ``limit`` long, together all of it."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    gaps = sorted({m.end() for m in _GAP.finditer(text) if 0 < m.end() < len(text)})
    depth = valley_depths(text, gaps, block)
    at = np.array(gaps, dtype=np.int64)
    pieces, start = [], 0
    while len(text) - start > limit:
        lo, hi = start + max(int(limit * least), overlap + 1), start + limit
        i, j = (int(k) for k in np.searchsorted(at, (lo, hi), side="right"))
        if j > i:
            end = int(at[i + np.lexsort((-at[i:j], -np.round(depth[i:j], 9)))[0]])
        else:
            end = text.rfind(" ", lo, hi + 1) + 1 or _safe(text, hi)
            if not lo < end <= hi:
                end = hi
        pieces.append((start, end))
        back = end - overlap
        word = text.rfind(" ", max(start, back - 30), back + 1) + 1
        word = word or text.find(" ", back, end - 1) + 1
        begin = word if word and word < end else _safe(text, back)
        start = begin if begin > start else end
    pieces.append((start, len(text)))
    return pieces


def _pieces(limit: int, overlap: int, least: float, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ident, text in zip(batch["ident"], batch["text"]):
                last = 0
                for k, (a, b) in enumerate(cut(text, limit, overlap, least, block)):
                    piece = text[a:b].strip(" ")
                    out.append((ident, k, a, b, max(0, last - a), piece))
                    last = b
            yield pd.DataFrame(out, columns=["ident", "piece", "char_start", "char_end", "overlap", "text"])

    return run


def split_oversized(df: DataFrame, ident: str = "row_id", text: str = "text", limit: int = 1200, overlap: int = 100, least: float = 0.5, block: int = 30) -> DataFrame:
    """The pieces of each text longer than ``limit``: ``ident``, ``piece``, ``char_start``, ``char_end`` (in the collapsed text), ``overlap``, ``text``."""
    if not 0 <= overlap < limit * least:
        raise ValueError("the overlap must be smaller than the smallest piece")
    kind = df.schema[ident].dataType.simpleString()
    large = df.select(F.col(ident).alias("ident"), collapsed(F.col(text)).alias("text")).where(F.char_length("text") > limit).distinct()
    made = large.mapInPandas(_pieces(limit, overlap, least, block), f"ident {kind}, piece int, char_start int, char_end int, overlap int, text string")
    return made.withColumnRenamed("ident", ident)
