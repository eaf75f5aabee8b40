import pytest
from pyspark.sql import functions as F

from tallyframe.functions import lexicons as lex
from tallyframe.functions import scores, vectors
from tallyframe.functions import text as tx


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v))
    return df.select(column.alias("x")).first()[0]


def arr(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


@pytest.mark.parametrize("word,n", [("casa", 2), ("aéreo", 4), ("día", 2), ("bien", 1), ("cansado", 3), ("psicología", 5), ("mmm", 1), ("", 1)])
def test_syllables(spark, word, n):
    assert one(spark, tx.syllables(F.col("w")), w=word) == n


@pytest.mark.parametrize("items,window,want", [("abac", 3, 2.5 / 3), ("abab", 50, 0.5), ("", 50, 0.0)])
def test_mattr(spark, items, window, want):
    assert one(spark, tx.mattr(F.col("t"), window), t=arr(*items)) == pytest.approx(want)


def test_mtld(spark):
    assert one(spark, tx.mtld(F.col("t")), t=arr(*"abacdab")) == pytest.approx(7.0)
    assert one(spark, tx.mtld(F.col("t")), t=arr()) == 0.0


def test_hapax_and_repeats(spark):
    assert one(spark, tx.hapax(F.col("t")), t=arr("b", "a", "b", "c")) == 2
    assert one(spark, tx.hapax(F.col("t")), t=arr()) == 0
    assert one(spark, tx.adjacent_repeats(F.col("t")), t=arr("a", "a", "b", "b", "b")) == 3
    assert one(spark, tx.adjacent_repeats(F.col("t")), t=arr("a")) == 0


@pytest.mark.parametrize("n,want", [(0, [0]), (510, [0]), (511, [0, 256]), (1200, [0, 256, 512, 768])])
def test_chunk_starts(spark, n, want):
    assert one(spark, tx.chunk_starts(F.col("n")), n=n) == want


def test_fold_and_placeholders(spark):
    assert one(spark, tx.fold(F.col("t")), t="Ánimo ÑANDÚ über café") == "animo nandu uber cafe"
    assert one(spark, tx.strip_placeholders(F.col("t")), t="en [LUGAR] y [lugar]") == "en   y [lugar]"
    assert one(spark, tx.normalise(F.col("t")), t=" la  [INSTITUCIÓN]\n fue ") == "la [INSTITUCION] fue"
    assert one(spark, tx.numbers(F.col("t")), t="a12b") == "a NUM b"
    assert one(spark, tx.ellipses(F.col("t")), t="a... b… c....") == 3


def test_phrases_count_each_pattern_for_itself(spark):
    assert one(spark, tx.phrase_count(F.col("t"), lex.MARKER_PHRASES), t="O sea, digamos que es que no") == 3
    assert one(spark, tx.phrase_count(F.col("t"), ("que",)), t="aquí que") == 1


def test_sentences_cut_and_drop(spark):
    long = " ".join(["palabra"] * 63) + "."
    assert one(spark, tx.sentences(F.col("t")), t="Muy corta. " + long) == [" ".join(["palabra"] * 60)]


@pytest.mark.parametrize("x,b,s", [(2, 0, 0), (7, 1, 0), (12, 2, 1), (20, 3, 1), (9.6, 2, 0), (4.5, 0, 0), (4.0, 0, 0), (9.5, 2, 0), (14.5, 2, 1), (10.2, 2, 1), (5.5, 1, 0)])
def test_bands_round_half_to_even_and_screening_does_not_round(spark, x, b, s):
    assert one(spark, scores.band(F.col("x")), x=float(x)) == b
    assert one(spark, scores.screen(F.col("x")), x=float(x)) == s


def test_null_scores_stay_null(spark):
    assert one(spark, scores.band(F.lit(None).cast("double"))) is None
    assert one(spark, scores.clip(F.lit(None).cast("double"), 0.0, 27.0)) is None
    assert one(spark, scores.clip_target(F.lit(30.0), F.lit(" PHQ9_Total "))) == 27.0
    assert one(spark, scores.finite(F.lit(float("nan")))) is None


def test_vectors(spark):
    assert one(spark, vectors.unit(arr(3.0, 4.0))) == [0.6, 0.8]
    assert one(spark, vectors.unit(arr(0.0, 0.0))) == [0.0, 0.0]
    assert one(spark, vectors.cosine(arr(1.0, 0.0), arr(0.0, 0.0))) is None


@pytest.mark.parametrize("name,want", [("UTB_0001101", "UTB_1101"), (" Utb_0001101__Q02", "UTB_1101"), ("utb 1101", "UTB_1101"), ("data/UNL-0001101", "UNL_1101"), ("nobody", None), ("", None)])
def test_session_key(spark, name, want):
    assert one(spark, tx.session_key(F.col("t")), t=name) == want


def test_percentile_five(spark):
    assert spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,)], "v double").agg(F.percentile("v", F.lit(0.05))).first()[0] == pytest.approx(1.15)
