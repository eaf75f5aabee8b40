"""Text functions as native column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "áàäâãåāéèëêēíìïîīóòöôõōúùüûūñçýÿ"
_PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyy"
PLACEHOLDER = r"\[[A-ZÁÉÍÓÚÑ_]+\]"


def fold(text: Column) -> Column:
    """Lower case without accents. Precomposed Latin letters by table, combining marks by pattern; other scripts stay."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), _ACCENTED, _PLAIN)


def fold_word(word: str) -> str:
    """``fold`` of a literal."""
    return word.lower().translate(str.maketrans(_ACCENTED, _PLAIN))


def numbers(text: Column) -> Column:
    """Runs of digits become " NUM "."""
    return F.regexp_replace(text, r"[0-9]+", " NUM ")


def strip_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, " ")


def normalise(text: Column) -> Column:
    """White space collapsed; a bracketed placeholder loses its accents."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    parts = F.split(F.regexp_replace(flat, rf"({PLACEHOLDER})", "\u0001$1\u0001"), "\u0001")
    plain = lambda p: F.when(p.rlike(rf"^{PLACEHOLDER}$"), F.translate(p, "ÁÉÍÓÚ", "AEIOU")).otherwise(p)
    return F.array_join(F.transform(parts, plain), "")


def words(text: Column) -> Column:
    """Folded alphabetic words of a text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}]+)"), 1)


def sentences(text: Column, least: int = 5, longest: int = 60) -> Column:
    """Sentences by end marks; shorter than ``least`` words go, longer than ``longest`` are cut, a short tail goes too."""
    pieces = F.split(F.trim(text), r"(?<=[.!?…])\s+")
    cut = F.flatten(F.transform(pieces, lambda s: _cut(F.split(F.trim(s), r"\s+"), longest)))
    return F.transform(F.filter(cut, lambda w: F.size(w) >= least), lambda w: F.array_join(w, " "))


def _cut(tokens: Column, longest: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(longest))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, F.lit(longest)))


def ellipses(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\.\.\.|…"))


def phrase_count(text: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of whole phrases in the folded text, each phrase counted for itself."""
    folded = fold(text)
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(folded, F.lit(rf"(?U)\b{fold_word(p)}\b"))
    return total


def is_any(word: Column, terms: tuple[str, ...]) -> Column:
    return fold(word).isin(sorted({fold_word(t) for t in terms}))


def count_any(tokens: Column, terms: tuple[str, ...]) -> Column:
    """How many folded tokens are among ``terms``."""
    known = F.array(*[F.lit(t) for t in sorted({fold_word(t) for t in terms})])
    return F.size(F.filter(tokens, lambda w: F.array_contains(known, w)))


def syllables(word: Column) -> Column:
    """Spanish syllables: one for each vowel group, one more for each hiatus or stressed weak vowel in it; at least 1."""
    groups = F.regexp_extract_all(F.lower(word), F.lit("([aeiouáéíóúüàèìòù]+)"), 1)

    def inside(g: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(g) - 1, F.lit(1))), lambda i: F.substring(g, i, F.lit(2)))
        parts = F.filter(pairs, lambda p: (F.char_length(p) == 2) & (p.rlike("^[aeoáéó]{2}$") | p.rlike("[íú]")))
        return F.lit(1) + F.size(parts)

    return F.greatest(F.aggregate(F.transform(groups, inside), F.lit(0), lambda a, x: a + x), F.lit(1))


def rate(count: Column, n: Column) -> Column:
    """Per hundred, 0 where there is nothing to count in."""
    return F.coalesce(F.try_divide(F.lit(100.0) * count, n), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def adjacent_repeats(tokens: Column) -> Column:
    n = F.size(tokens)
    same = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return F.when(n < 2, 0).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + x))


def mattr(tokens: Column, window: int = 50) -> Column:
    """Mean share of distinct words over all windows; a short text is one window; an empty one has 0."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(tokens, i, F.lit(window)))).cast("double"))
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, 0.0).when(n <= window, F.try_divide(F.size(F.array_distinct(tokens)).cast("double"), n)).otherwise(total / (F.size(starts) * window))


def _mtld_pass(tokens: Column, threshold: float) -> Column:
    zero = F.struct(F.array().cast("array<string>").alias("types"), F.lit(0).alias("n"), F.lit(0.0).alias("factors"))

    def step(acc: Column, w: Column) -> Column:
        types = F.array_union(acc["types"], F.array(w))
        n = acc["n"] + 1
        full = F.size(types) / n <= threshold
        return F.struct(
            F.when(full, F.array().cast("array<string>")).otherwise(types).alias("types"), F.when(full, 0).otherwise(n).alias("n"), F.when(full, acc["factors"] + 1.0).otherwise(acc["factors"]).alias("factors")
        )

    def finish(acc: Column) -> Column:
        left = F.try_divide(F.size(acc["types"]).cast("double"), acc["n"])
        return acc["factors"] + F.when((acc["n"] > 0) & (left < 1.0), (1 - left) / (1 - threshold)).otherwise(0.0)

    factors = F.aggregate(tokens, zero, step, finish)
    size = F.size(tokens).cast("double")
    return F.when(factors > 0, size / factors).otherwise(size)


def mtld(tokens: Column, threshold: float = 0.72) -> Column:
    """Lexical diversity by factor counting, mean of both directions; 0 for an empty text."""
    return F.when(F.size(tokens) == 0, 0.0).otherwise((_mtld_pass(tokens, threshold) + _mtld_pass(F.reverse(tokens), threshold)) / 2)


def hapax(tokens: Column) -> Column:
    """Words that occur once: one fold over the sorted words, which counts a run of length 1 when the next word differs."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("once"))

    def step(a: Column, w: Column) -> Column:
        same = a["last"] == w
        return F.struct(w.alias("last"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), (a["once"] + F.when(~same & (a["run"] == 1), 1).otherwise(0)).alias("once"))

    return F.aggregate(F.array_sort(tokens), zero, step, lambda a: a["once"] + F.when(a["run"] == 1, 1).otherwise(0))


def readability(syllable_count: Column, word_count: Column, sentence_count: Column) -> Column:
    """Fernández-Huerta: higher is easier."""
    return F.lit(206.84) - 60.0 * ratio(syllable_count, word_count) - 1.02 * ratio(word_count, sentence_count)


def chunk_starts(n: Column, size: int = 510, stride: int = 256) -> Column:
    """Starts of sliding chunks; the first chunk that reaches the end is the last."""
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(float(stride))) * stride)
    return F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def session_key(name: Column) -> Column:
    """Participant written in any way as site and number, or NULL."""
    number = F.regexp_extract(name, r"(?i)(utb|utc|unl)[\s_\-]*0*([0-9]+)", 2)
    return F.when(number != "", F.concat_ws("_", F.upper(F.regexp_extract(name, r"(?i)(utb|utc|unl)[\s_\-]*0*([0-9]+)", 1)), number))


def label(name: Column) -> Column:
    """Lower case without outer blanks, NULL for blank."""
    low = F.lower(F.trim(name))
    return F.when(low != "", low)


def draw(*parts: Column | str) -> Column:
    """A deterministic number in [0, 2**32) from the md5 of the parts joined by "|"."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("bigint")
