import pytest
from pyspark.sql import functions as F

from tallyframe.functions.scores import band
from tallyframe.operators import metrics as m
from tallyframe.operators import stats as s

TRUE, PRED = (2.0, 7.0, 12.0, 20.0, 9.6, 4.5), (4.0, 9.0, 11.0, 14.5, 10.2, 5.5)


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(list(zip(["k"] * 6, TRUE, PRED)), "k string, y double, p double").withColumns({"bt": band(F.col("y")), "bp": band(F.col("p"))})


def test_regression(scored):
    r = m.regression(scored, ["k"], "y", "p").first()
    assert (r["rmse"], r["mae"], r["r2"]) == pytest.approx((2.601602, 2.016667, 0.800352), abs=1e-6)


def test_confusion_has_fixed_labels(scored):
    cells = {(r["bt"], r["bp"]): r["n"] for r in m.confusion(scored, ["k"], "bt", "bp", [0, 1, 2, 3]).collect()}
    assert [[cells[a, b] for b in range(4)] for a in range(4)] == [[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 2, 0], [0, 0, 1, 0]]


def test_f1_and_kappa(scored):
    assert m.f1_macro(scored, ["k"], "bt", "bp").first()["f1_macro"] == pytest.approx(0.533333, abs=1e-6)
    assert m.qwk(scored, ["k"], "bt", "bp").first()["qwk"] == pytest.approx(0.8125)


def test_kappa_weights_use_positions(spark):
    counts = {(0, 0): 2, (0, 1): 1, (1, 1): 1, (1, 3): 1, (3, 0): 1, (3, 3): 2}
    rows = [("k", a, b) for (a, b), n in counts.items() for _ in range(n)]
    assert m.qwk(spark.createDataFrame(rows, "k string, t int, p int"), ["k"], "t", "p").first()["qwk"] == pytest.approx(0.5)


def test_kappa_is_null_with_one_label(spark):
    assert m.qwk(spark.createDataFrame([("k", 1, 1)] * 3, "k string, t int, p int"), ["k"], "t", "p").first()["qwk"] is None


def test_auc(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0), ("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 1.0), ("b", 1, 2.0)], "k string, y int, s double")
    assert {r["k"]: r["auc"] for r in m.auc(df, ["k"], "y", "s").collect()} == {"a": 0.875, "b": None}


def test_average_rank_gives_ties_their_mean(spark):
    got = m.average_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double"), [], "v").collect()
    assert {r["v"]: float(r["avg_rank"]) for r in got} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_running_sums_over_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, "hot").otherwise("x").alias("k"), (((F.col("id") * 7919) % 5003).cast("double") / 100 - 20).alias("v"), F.lit(2).alias("n"))
    got = m.running_sums(df, ["k"], "v", ["n"]).collect()
    for key in ("hot", "x"):
        rows = sorted((r["v"], r["n_below"]) for r in got if r["k"] == key)
        assert [b for _, b in rows] == [2 * i for i in range(len(rows))]


def test_holm_stops_at_first_failure(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.03), ("f", "c", 0.02), ("f", "d", 0.04)], "f string, i string, p double")
    got = {r["i"]: (round(r["threshold"], 6), r["significant"]) for r in s.holm(df, ["f"], "p", "i").collect()}
    assert got == {"a": (0.0125, True), "c": (0.016667, False), "b": (0.025, False), "d": (0.05, False)}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in zip("abcd", (0.01, 0.04, 0.03, 0.5))], "f string, i string, p double")
    got = {r["i"]: r["q"] for r in s.benjamini_hochberg(df, ["f"], "p", "i").collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.0533333, "c": 0.0533333, "d": 0.5}, abs=1e-6)


def test_wilcoxon_equal_errors(spark):
    r = s.wilcoxon(spark.createDataFrame([("k", 1.0, 1.0)] * 4, "k string, a double, b double"), ["k"], "a", "b").first()
    assert (r["pairs"], r["w"], r["p"]) == (0, 0.0, 1.0)


def test_wilcoxon_exact_counts_sign_patterns(spark):
    df = spark.createDataFrame([("k", float(i), 0.0) for i in range(1, 6)], "k string, a double, b double")
    tested = s.wilcoxon(df, ["k"], "a", "b").select("k", "pairs", F.col("w").cast("double").alias("w"), "p")
    assert s.wilcoxon_exact(tested).first()["p"] == pytest.approx(2 / 32)
    assert s.exact_signed_rank_p(3, 4) == pytest.approx(2 * 5 / 16)


def test_spearman_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, 9.0, 1.0)], "a double, b double, c double")
    assert s.spearman(df, [], "a", "b").first()["rho"] == pytest.approx(1.0)
    assert s.spearman(df, [], "a", "c").first()["rho"] == 0.0


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([("k", str(i), float(i % 7)) for i in range(200)], "k string, i string, v double")
    r = s.bootstrap_interval(df, ["k"], "i", "v", 100).first()
    assert r["low"] < 2.98 < r["high"] and r["high"] - r["low"] < 1.0


def test_empty_frames(spark):
    e = spark.createDataFrame([], "k string, y double, p double, bt int, bp int")
    assert m.regression(e, ["k"], "y", "p").count() == 0
    assert m.qwk(e, ["k"], "bt", "bp").count() == 0
    assert s.spearman(e, ["k"], "y", "p").count() == 0
