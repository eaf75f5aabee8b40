import pytest
from pyspark.sql import functions as F

from tallyframe.operators import corpus, models, runs, splits, tfidf, vectors
from tallyframe.operators.ranking import class_rank


def test_latest_and_best(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "a", 2.0), (3, None, 1.0), (4, None, float("nan"))], "i int, k string, s double")
    assert {(r["k"], r["i"]) for r in runs.latest(df, ["k"], "i").collect()} == {("a", 2), (None, 4)}
    assert {(r["k"], r["i"]) for r in runs.best(df, ["k"], "s", "i").collect()} == {("a", 2), (None, 3)}


def test_strict_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 2.0)], "i int, c string, v double")
    with pytest.raises(ValueError):
        runs.strict_pivot(df, ["i"], "c", ["x"], "v")


def test_early_stop_with_tolerance(spark):
    losses = [5.0, 4.0, 3.99995, 3.9, 3.95, 3.96, 3.97, 1.0]
    r = runs.early_stop(spark.createDataFrame([("k", e + 1, x) for e, x in enumerate(losses)], "k string, e int, l double"), ["k"], "e", "l").first()
    assert (r["best_epoch"], r["stop_epoch"]) == (4, 7)


def test_rank_split_is_deterministic_and_sized(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("s"))
    a = splits.rank_split(df, "id", "s")
    assert {(r["s"], r["split"]): r["count"] for r in a.groupBy("s", "split").count().collect()} == {(0, "test"): 15, (0, "train"): 35, (1, "test"): 15, (1, "train"): 35}
    assert a.exceptAll(splits.rank_split(df.repartition(3), "id", "s")).count() == 0


def test_rare_strata_collapse(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (20.0, 20.0)], "p double, g double")
    assert {r["stratum"] for r in splits.stratify_key(df, "p", "g").collect()} == {0}


def test_groups_stay_together(spark):
    df = spark.range(200).select((F.col("id") % 17).alias("g"))
    folds = splits.group_folds(df, "g", None, 5)
    assert folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r["overlap"] for r in splits.fold_audit(folds, "g", 5).collect()} == {0}


def test_leakage_guard(spark):
    train, test = spark.createDataFrame([("a",), ("b",)], "p string"), spark.createDataFrame([("b",)], "q string")
    with pytest.raises(splits.LeakageError):
        splits.assert_disjoint(train, test, F.col("p") == F.col("q"))
    splits.assert_disjoint(train.where("p = 'a'"), test, F.col("p") == F.col("q"))


@pytest.mark.parametrize("bits", [1, 4])
def test_class_rank_is_dense_whatever_the_buckets(spark, bits):
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").when(F.col("id") < 450, "x").alias("c"), "id")
    got = class_rank(df, ["c"], ["id"], bits=bits)
    assert got.groupBy("c").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("n"), F.count(F.lit(1)).alias("m")).where("a <> 0 or b <> n - 1 or n <> m").count() == 0
    assert got.exceptAll(class_rank(df, ["c"], ["id"], bits=3)).count() == 0


def test_pack_units(spark):
    got = spark.range(1).select(corpus.pack_units(F.array(*[F.lit(x) for x in ("aa", "bb", "cccccccc", "d", "e")]), 5).alias("p")).first()["p"]
    assert got == ["aa bb", "cccccccc", "d e"]


def test_delete_words_keeps_one(spark):
    df = spark.range(50).select("id", F.array(F.lit("a"), F.lit("b")).alias("w"))
    got = df.select(F.size(corpus.delete_words(F.col("w"), 0.99, "s", F.col("id"))).alias("n"))
    assert {r["n"] for r in got.collect()} == {1}


def test_word_probability_keeps_the_mean(spark):
    p = spark.range(1).select(corpus.word_probability(0.15, 0.5, F.lit(100.0), F.lit(10.0)).alias("p")).first()["p"]
    assert 0.5 * 10 + p * 90 == pytest.approx(15.0)


def test_idf_of_a_term_in_every_document(spark):
    df = spark.createDataFrame([(i, "gato azul" if i else "gato rojo") for i in range(4)], "i int, t string")
    counts = tfidf.term_counts(df, "i", "t", 1)
    v = tfidf.vocabulary(counts, df.agg(F.count(F.lit(1)).alias("n_docs")), [], least=1, share=1.0)
    assert {r["term"]: r["idf"] for r in v.collect()}["gato"] == pytest.approx(1.0)


def test_moments_and_silhouette_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, lab = rng.normal(size=(30, 5)), rng.integers(0, 3, 30)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(lab[i])) for i in range(30)], "i int, v array<double>, l int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = (u @ u.T)[~np.eye(30, dtype=bool)]
    r = vectors.cosine_moments(df, "v").first()
    assert (r["mean"], r["sd"]) == pytest.approx((c.mean(), c.std()))
    d, sil = 1 - u @ u.T, []
    for i in range(30):
        own = [j for j in range(30) if lab[j] == lab[i] and j != i]
        a, b = d[i, own].mean(), min(d[i, lab == k].mean() for k in set(lab.tolist()) - {lab[i]})
        sil.append((b - a) / max(a, b))
    assert vectors.silhouette(df, "i", "v", "l").first()["silhouette"] == pytest.approx(np.mean(sil))


def test_models(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1.0), (1, [0.9, 0.1], 3.0), (2, [0.0, 1.0], 9.0)], "i int, v array<double>, y double")
    assert models.knn(df, df.where("i = 0"), "i", "v", "y", 1).first()["y_pred"] == 3.0
    assert models.dummy(df, df.where("i = 0"), "y").first()["y_pred"] == pytest.approx(13 / 3)
    assert models.candidates(["ridge"]) == ["dummy", "ridge"]
    for bad, error in (("lightgbm", ValueError), ("nonsense", KeyError)):
        with pytest.raises(error):
            models.regressor(bad, "f", "y")


def test_ridge_cross_validation(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(40).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("f"), (F.col("id") * 2.0).alias("y"), (F.col("id") % 4).alias("k"))
    got = models.cross_validate(df, "ridge", "f", "y", "k", [{"regParam": 0.0}, {"regParam": 100.0}]).collect()
    assert got[0]["cv_rmse"] < 1e-6 < got[1]["cv_rmse"]


def test_written_steps_read_back_and_clear(spark):
    from tallyframe.session import clear_scratch, materialise

    df = materialise(spark.range(3))
    assert df.count() == 3 and all("Parquet" in p or "parquet" in p for p in [df._jdf.queryExecution().toString()])
    clear_scratch(spark)
