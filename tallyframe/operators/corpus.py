"""Corpus preparation: packing units, deterministic noise, masking draws, spans, fertility."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import lexicons as lex
from tallyframe.functions.text import draw, fold_word, sentences

_WORD = re.compile(r"[^\W\d_]+")


def pack_units(units: Column, limit: int) -> Column:
    """Greedy packing of consecutive units of a document, joined by a blank, while the joined length stays within ``limit``; a longer unit stands alone."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, u: Column) -> Column:
        joined = F.when(a["open"] == "", u).otherwise(F.concat_ws(" ", a["open"], u))
        fits = F.char_length(joined) <= limit
        return F.struct(F.when(fits | (a["open"] == ""), a["done"]).otherwise(F.array_append(a["done"], a["open"])).alias("done"), F.when(fits, joined).otherwise(u).alias("open"))

    return F.aggregate(units, zero, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def delete_words(tokens: Column, ratio: float, seed: str, ident: Column) -> Column:
    """Each word goes with probability ``ratio`` by its md5 draw; if all would go, the one with the largest draw stays."""
    drawn = F.transform(tokens, lambda w, i: F.struct((draw(F.lit(seed), ident, i) / F.lit(4294967296.0)).alias("u"), (-i).alias("i"), w.alias("w")))
    kept = F.filter(drawn, lambda d: d["u"] >= ratio)
    spared = F.array(F.array_max(drawn)["w"])
    return F.when(F.size(tokens) == 0, tokens).when(F.size(kept) == 0, spared).otherwise(F.transform(kept, lambda d: d["w"]))


def mask_plan(tokens: Column, share: float, seed: str, ident: Column) -> Column:
    """Per word: 0 untouched, 1 masked (80 %), 2 replaced (10 %), 3 kept but predicted (10 %), by md5 draws."""
    u = lambda i: draw(F.lit(seed), ident, i) / F.lit(4294967296.0)
    v = lambda i: draw(F.lit(seed + "|how"), ident, i) / F.lit(4294967296.0)
    return F.transform(tokens, lambda w, i: F.when(u(i) >= share, 0).when(v(i) < 0.8, 1).when(v(i) < 0.9, 2).otherwise(3))


def word_probability(p: float | Column, p_lexicon: float | Column, n: Column, n_lexicon: Column) -> Column:
    """Masking probability of other words that keeps the mean at ``p`` when lexicon words get ``p_lexicon``; within 0 and 1."""
    p, p_lexicon = (F.lit(x) if isinstance(x, float) else x for x in (p, p_lexicon))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(p * n - p_lexicon * n_lexicon, n - n_lexicon), p)))


def spans(text: Column, pattern: str) -> Column:
    """(start, end) of the matches of a pattern, found by walking the split text; bounded by the text."""
    parts = F.split(text, pattern)
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.char_length(z["before"])
        end = start + F.char_length(z["hit"])
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("s"), end.alias("e"))).alias("out"))

    zipped = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda b, h: F.struct(b.alias("before"), h.alias("hit")))
    return F.aggregate(zipped, zero, step, lambda a: a["out"])


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of one document that overlap (s < end and start < e): an equi-join on the document with a residual."""
    x, y = a.select(key, F.col("s").alias("as_"), F.col("e").alias("ae")), b.select(key, F.col("s").alias("bs"), F.col("e").alias("be"))
    return x.join(y, key).where((F.col("as_") < F.col("be")) & (F.col("bs") < F.col("ae")))


def split_to_fit(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit`` words: sentences are packed while they fit, a longer sentence is cut between words; a text that fits is one piece."""
    units = sentences(text, 1, limit)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, u: Column) -> Column:
        n = F.size(F.split(u, " "))
        fits = a["n"] + n <= limit
        joined = F.when(a["n"] == 0, u).otherwise(F.concat_ws(" ", a["open"], u))
        return F.struct(F.when(fits, a["done"]).otherwise(F.array_append(a["done"], a["open"])).alias("done"), F.when(fits, joined).otherwise(u).alias("open"), F.when(fits, a["n"] + n).otherwise(n).alias("n"))

    return F.aggregate(F.filter(units, lambda u: F.trim(u) != ""), zero, step, lambda a: F.when(a["n"] == 0, a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def weighted_mask_plan(tokens: Column, listed: tuple[str, ...], share: float, p_listed: float, seed: str, ident: Column) -> Column:
    """``mask_plan`` with probability ``p_listed`` for listed words and, for the others, the one that keeps the mean; where no word is drawn, the one with the smallest draw is masked."""
    known = F.array(*[F.lit(t) for t in listed])
    how = lambda i: draw(F.lit(seed + "|how"), ident, i) / F.lit(4294967296.0)
    # Each step is bound to a lambda's variable, so that tokens are made and listed words counted once a text, draws once a word.
    marked = F.transform(F.array(tokens), lambda w: F.transform(w, lambda x: F.array_contains(known, x)))
    counted = F.transform(marked, lambda l: F.struct(l.alias("l"), F.size(l).cast("double").alias("n"), F.size(F.filter(l, lambda x: x)).cast("double").alias("k")))
    weighed = F.transform(counted, lambda c: F.struct(c["l"].alias("l"), F.when(c["n"] > c["k"], word_probability(share, p_listed, c["n"], c["k"])).otherwise(F.lit(0.0)).alias("other")))
    drawn = F.transform(weighed, lambda t: F.transform(t["l"], lambda x, i: F.struct((draw(F.lit(seed), ident, i) / F.lit(4294967296.0)).alias("u"), i.alias("i"), F.when(x, F.lit(p_listed)).otherwise(t["other"]).alias("p"))))
    whole = F.transform(drawn, lambda d: F.struct(d.alias("d"), (F.size(F.filter(d, lambda x: x["u"] < x["p"])) > 0).alias("hit"), F.array_min(d)["i"].alias("first")))
    plan = F.transform(whole, lambda t: F.transform(t["d"], lambda x: F.when(~F.when(t["hit"], x["u"] < x["p"]).otherwise(x["i"] == t["first"]), 0).when(how(x["i"]) < 0.8, 1).when(how(x["i"]) < 0.9, 2).otherwise(3)))
    return F.get(plan, F.lit(0))


class EmptyCorpus(ValueError):
    """A named corpus has no text."""


def build_corpora(known: dict[str, Callable[[], DataFrame]], wanted: list[str]) -> DataFrame:
    """Union of named corpora with their names; an unknown name raises, and so does a corpus without rows."""
    unknown = sorted(set(wanted) - set(known))
    if unknown:
        raise KeyError(f"unknown corpora {unknown}; known are {sorted(known)}")
    out = None
    for name in wanted:
        df = known[name]()
        if df.isEmpty():
            raise EmptyCorpus(name)
        tagged = df.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def word_spans(text: Column) -> Column:
    """(start, end, form) of the alphabetic words of a text; the word after an opening bracket belongs to a placeholder and is left out."""
    words_ = spans(text, r"[\p{L}]+")
    return F.transform(F.filter(words_, lambda s: (s["s"] == 0) | (text.substr(s["s"], F.lit(1)) != "[")), lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), text.substr(s["s"] + 1, s["e"] - s["s"]).alias("form")))


def fertility(df: DataFrame, ident: str, text: str, offsets: Callable[[str], list[tuple[int, int]]], keep: list[str] | None = None) -> DataFrame:
    """For each word of each text the number of pieces of a tokenizer that overlap it: ``keep``, ``form``, ``pieces``, ``lexicon``.

    ``offsets`` gives the character offsets (start, end) of the pieces of a whole text; empty pieces are ignored. Words and
    pieces are both in order, so one walk over them meets every overlap.
    """
    keep = keep or []
    terms = frozenset(fold_word(t) for group in lex.SUBSCALES.values() for t in group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                kept, body = row[:-1], row[-1]
                pieces = [(s, e) for s, e in offsets(body) if e > s]
                at = 0
                for m in _WORD.finditer(body):
                    a, b = m.span()
                    if a and body[a - 1] == "[":
                        continue
                    while at < len(pieces) and pieces[at][1] <= a:
                        at += 1
                    j = at
                    while j < len(pieces) and pieces[j][0] < b:
                        j += 1
                    out.append((*kept, m.group(), j - at, fold_word(m.group()) in terms))
            yield pd.DataFrame(out, columns=[*[f"k{i}" for i in range(len(keep))], "form", "pieces", "lexicon"])

    named = df.where(F.col(text).isNotNull()).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("__text"))
    kinds = "".join(f"k{i} {named.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    made = named.mapInPandas(run, f"{kinds}form string, pieces int, lexicon boolean")
    return made.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
