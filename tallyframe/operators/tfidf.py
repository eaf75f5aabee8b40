"""TF-IDF with a vocabulary fitted on given rows only (one vocabulary per fold)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import fold_word, words

# Function words left out by default.
STOP = tuple(
    """a al algo ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era es esa ese eso esta este esto fue ha hay la las le les lo los mas me mi mis mucho muy nada ni no nos o os otra otro para pero poco por porque que se
    ser si sin sobre son su sus tambien tan te tiene todo tu un una uno unos y ya yo""".split()
)


def stop_words(terms: tuple[str, ...] = STOP) -> tuple[str, ...]:
    """The terms and their forms without accents."""
    return tuple(sorted({*terms, *map(fold_word, terms)}))


def ngrams(tokens, n: int):
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def term_counts(df: DataFrame, ident: str, text: str, longest: int = 2, keep: list[str] | None = None) -> DataFrame:
    """One row for each term of each document with its count ``tf``; words of two letters and more, no stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words()])
    tokens = F.filter(words(F.col(text)), lambda w: (F.char_length(w) >= 2) & ~F.array_contains(stop, w))
    rows = df.where(F.col(text).isNotNull()).select(ident, *(keep or []), tokens.alias("t"))
    grams = F.concat(*[ngrams(F.col("t"), n) for n in range(1, longest + 1)])
    return rows.select(ident, *(keep or []), F.explode(grams).alias("term")).groupBy(ident, *(keep or []), "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, keys: list[str], least: int = 3, share: float = 0.9, cap: int = 300) -> DataFrame:
    """Terms in at least ``least`` documents and at most ``share`` of them, the ``cap`` most frequent by total count (then by name), with idf."""
    df = counts.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    sized = df.join(F.broadcast(n_docs), keys) if keys else df.crossJoin(F.broadcast(n_docs))
    ok = sized.where((F.col("df") >= least) & (F.col("df") <= F.col("n_docs") * share))
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.col("total").desc(), "term")
        ok = ok.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= cap).drop("__r")
    else:
        ok = ok.orderBy(F.col("total").desc(), "term").limit(cap)
    return ok.withColumn("idf", F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0)


def tfidf(counts: DataFrame, vocab: DataFrame, ident: str, keys: list[str] | None = None) -> DataFrame:
    """L2-normalised weights (1 + ln tf)·idf as rows; ``vocab`` has at most its cap of rows a key, so it is broadcast."""
    raw = counts.join(F.broadcast(vocab.select(*(keys or []), "term", "idf")), [*(keys or []), "term"]).withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*(keys or []), ident)))
    return raw.select(*(keys or []), ident, "term", "tf", (F.col("w") / length).alias("weight"))


def side_by_side(weights: DataFrame, named: DataFrame, ident: str, features: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """TF-IDF terms beside standardised named columns, as rows (``ident``, ``feature``, ``value``): ``text:<term>`` and ``named:<column>``.

    Means and population deviations (1 where 0) come from ``fitted``, the training rows, or from ``named`` itself. Zero values
    of terms are no rows; named columns always are.
    """
    base = fitted if fitted is not None else named
    sums = base.agg(*[c for f in features for c in (F.avg(F.col(f).cast("double")).alias(f"__m_{f}"), F.coalesce(F.nullif(F.stddev_pop(F.col(f).cast("double")), F.lit(0.0)), F.lit(1.0)).alias(f"__s_{f}"))])
    scaled = named.crossJoin(F.broadcast(sums)).select(ident, F.explode(F.array(*[F.struct(F.lit(f"named:{f}").alias("feature"), ((F.col(f).cast("double") - F.col(f"__m_{f}")) / F.col(f"__s_{f}")).alias("value")) for f in features])).alias("s")).select(ident, "s.*")
    text = weights.select(ident, F.concat(F.lit("text:"), "term").alias("feature"), F.col("weight").alias("value"))
    return text.unionByName(scaled)
