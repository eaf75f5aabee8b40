"""Queries that must do the whole job: results recomputed here from the tables, or by hand, without the queries' SQL."""

import os

import numpy as np
import pytest

from tallyframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_similar_pairs_are_not_cut_at_a_number_of_neighbours(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, v = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v[ids % 100 == 0] @ v.T, 6)
    want = {(q, b): x for q, row in zip(ids[ids % 100 == 0], s) for b, x in zip(ids, row) if x >= 0.2 and b != q}
    got = {(r["vec_id"], r["neighbour"]): r["similarity"] for r in QUERIES["j11_similar"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert max(np.unique([q for q, _ in got], return_counts=True)[1]) > 20


def test_weights_follow_poisson_beyond_six():
    from math import exp, factorial

    from tallyframe.operators.stats import _STEPS, poisson_weights

    assert len(_STEPS) > 12 and np.allclose(_STEPS[:3] / 2.0**64, [exp(-1), 2 * exp(-1), 2.5 * exp(-1)])
    w = np.stack([poisson_weights("42", f"s{i}", 2000) for i in range(500)])
    n = np.bincount(w.ravel(), minlength=9)
    want = [1e6 * exp(-1) / factorial(k) for k in range(9)]
    assert all(abs(a - b) < 5 * b**0.5 + 3 for a, b in zip(n, want)) and n[7:].sum() > 0
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.1 and len({x.tobytes() for x in w}) == 500


def test_intervals_are_near_those_of_index_draws_for_each_group(spark):
    from tallyframe.operators.stats import bootstrap_intervals

    rng = np.random.default_rng(7)
    d = {k: rng.normal(m, 2, 300).round(6) for k, m in (("a", 1.0), ("b", -1.0), (None, 0.0))}
    rows = [(k, f"s{i}", float(x), -float(x) * 2) for k, v in d.items() for i, x in enumerate(v)] + [("a", "none", None, 1.0), ("one", "s1", 3.0, 4.0)]
    got = {r["k"]: r for r in bootstrap_intervals(spark.createDataFrame(rows, "k string, i string, v double, w double"), ["k"], "i", ["v", "w"]).collect()}
    assert got.keys() == {"a", "b", None, "one"} and got["one"]["v_low"] == got["one"]["v_high"] == 3.0
    for k, v in d.items():
        means = v[rng.integers(0, 300, (2000, 300))].mean(axis=1)
        low, high = np.quantile(means, [0.025, 0.975])
        assert abs(got[k]["v_low"] - low) < 0.05 and abs(got[k]["v_high"] - high) < 0.05
        assert abs(got[k]["w_low"] + 2 * got[k]["v_high"]) < 1e-9 and abs(got[k]["w_high"] + 2 * got[k]["v_low"]) < 1e-9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_every_arm_and_target_has_an_interval_that_holds_its_mean(spark):
    means = {(r["encoder"], r["target"]): r for r in QUERIES["j3_paired"](spark, DATA).collect()}
    got = {(r["encoder"], r["target"]): r for r in QUERIES["x7_bootstrap"](spark, DATA).collect()}
    assert got.keys() == means.keys() and len({e[:1] for e, _ in got}) > 1
    assert all(got[k]["low"] - 1e-6 <= r["d_absolute"] <= got[k]["high"] + 1e-6 for k, r in means.items())


def test_each_contrast_of_the_sheet_is_there(spark, tmp_path):
    """By hand: two runs a side are averaged, a side that is missing gives no row, ties go to b."""
    made = []

    def run(encoder, family, granularity, augmentation, rmse, split="test", target="PHQ9_Total"):
        made.append((len(made), encoder, target, family, granularity, augmentation, split, rmse))

    run("E1_beto_v1", "frozen", "participant", "no_augmentation", 4.0)
    run("e1_BETO_v2", "frozen", "participant", "no_augmentation", 6.0)
    run("E1_beto_v1", "frozen", "question", "no_augmentation", 5.0)
    run("E1_beto_v1", "frozen", "question", "no_augmentation", 9.0, "cv")
    run("E1_beto_v1", "frozen", "question", "augmented", 7.0)
    run("E5_beto-ft_v1", "fine-tuning", "participant", "no_augmentation", 5.0)
    run("E6_beto-cv_v1", "fine-tuning-cv", "question", "augmented", 6.0)
    run("E6_beto-cv_v1", "fine-tuning-cv", "question", "no_augmentation", 1.0)
    run("E2_e5-small_v1", "frozen", "participant", "no_augmentation", 5.5)
    run("E3_e5-tsdae_v1", "frozen", "participant", "no_augmentation", 5.0)
    run("E3_e5-tsdae_v2", "frozen", "participant", "no_augmentation", 6.0)
    run("E3_e5-tsdae_v3", "frozen", "question", "no_augmentation", 6.0)
    spark.createDataFrame(made, "run_id bigint, encoder string, target string, family string, granularity string, augmentation string, split string, rmse double").write.parquet(str(tmp_path / "experiment_log.parquet"))
    got = {(r["contrast"], r["arm"]): (r["a"], r["b"], r["difference"], r["winner"]) for r in QUERIES["x16_checkpoint_contrasts"](spark, str(tmp_path)).collect()}
    assert got.pop(("granularity", "e3_e5-tsdae"))[:2] == (5.5, 6.0)
    assert got == {
        ("granularity", "beto"): (5.0, 5.0, 0.0, "question"),
        ("stopping", "beto"): (5.0, 6.0, 1.0, "holdout"),
        ("fine_tuning", "beto"): (7.0, 6.0, -1.0, "fine-tuned"),
        ("tsdae", "e3_e5-tsdae_v1"): (5.5, 5.0, -0.5, "e5-small adapted"),
        ("tsdae", "e3_e5-tsdae_v2"): (5.5, 6.0, 0.5, "e5-small"),
    }


def test_contrast_table_keeps_searches_and_granularities_apart(spark, tmp_path):
    made = []
    for search, granularity, far in (("defaults", "participant", 0), ("defaults", "question", 1), ("random15", "question", 2)):
        for i in range(1, 25):
            for encoder, family, off in (("L1_lexical_v1", "lexical", 1 + far), ("L2_lexical__affect_v1", "lexical", 2), ("E1_beto_v1", "frozen", 3)):
                made.append((f"UTB_{i}", 10.0, 10.0 + off + i / 100, encoder, "PHQ9_Total", 1, search, family, "no_augmentation", granularity))
    spark.createDataFrame(made, "participant string, y_true double, y_pred double, encoder string, target string, seed int, search string, family string, augmentation string, granularity string").write.parquet(str(tmp_path / "predictions.parquet"))
    got, between = ({(r["contrast"], r["search"], r["granularity"]): r for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("x15_contrast_table", "x15_contrast_intervals"))
    assert got.keys() == between.keys() == {(c, *k) for c in ("affect_on_lexical", "named_vs_frozen") for k in (("defaults", "participant"), ("defaults", "question"), ("random15", "question"))}
    for (c, s, g), r in got.items():
        far = {("defaults", "participant"): 0, ("defaults", "question"): 1, ("random15", "question"): 2}[s, g]
        a, b = (1 + far, 2) if c == "affect_on_lexical" else (1.5 + far / 2, 3)
        d = np.mean([round((a + i / 100) ** 2, 6) - round((b + i / 100) ** 2, 6) for i in range(1, 25)])
        i = between[c, s, g]
        assert r["n"] == 24 and abs(r["d_squared"] - d) < 2e-6 and i["squared_low"] - 1e-6 <= d <= i["squared_high"] + 1e-6
        assert i["absolute_low"] - 1e-6 <= r["d_absolute"] <= i["absolute_high"] + 1e-6
        assert r["significant"] == (abs(a - b) > 0) and r["pairs"] == (24 if a != b else 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_paired_comparison_has_both_errors_with_intervals(spark):
    rows = {n: {(r["encoder"], r["target"]): r for r in QUERIES[n](spark, DATA).collect()} for n in ("x8_intervals", "x8_paired_comparison", "j3_paired", "x9_wilcoxon", "x7_bootstrap")}
    got = rows.pop("x8_paired_comparison")
    assert got and all(got.keys() == r.keys() for r in rows.values())
    for k, r in got.items():
        between, mean, test, interval = (rows[n][k] for n in ("x8_intervals", "j3_paired", "x9_wilcoxon", "x7_bootstrap"))
        assert (r["d_squared"], r["d_absolute"], r["p_absolute"]) == (mean["d_squared"], mean["d_absolute"], test["p"])
        assert (between["absolute_low"], between["absolute_high"]) == (interval["low"], interval["high"]) and between["squared_low"] - 1e-6 <= r["d_squared"] <= between["squared_high"] + 1e-6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_metrics_are_of_participants_not_of_rows(spark):
    """Means of a participant first, then clipped, then scored: recomputed in pandas."""
    import pandas as pd

    from tallyframe.plans.queries import scored

    p = scored(spark, DATA).select("encoder", "target", "session", "y_true", "y_pred").toPandas()
    m = p.groupby(["encoder", "target", "session"], as_index=False).mean()
    m["y_pred"] = np.clip(m["y_pred"], 0, m["target"].map({"phq9_total": 27.0, "gad7_total": 21.0}))
    rmse = {k: np.sqrt(((g["y_pred"] - g["y_true"]) ** 2).mean()) for k, g in m.dropna().groupby(["encoder", "target"])}
    got = {(r["encoder"], r["target"]): r["rmse"] for r in QUERIES["x1_regression"](spark, DATA).collect()}
    assert got.keys() == rmse.keys() and all(abs(got[k] - rmse[k]) < 2e-6 for k in got) and isinstance(m, pd.DataFrame)


def test_blocks_of_queries_give_the_same_neighbours(spark, monkeypatch):
    """A query set of several blocks, a zero vector, a NULL vector and ties."""
    from tallyframe.operators import vectors

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(60)] + [(60, [0.0] * 4, 1), (61, None, 2), (62, [1.0, 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "i long, v array<double>, l int").repartition(3)
    one = {tuple(r) for r in vectors.neighbours(df, df, "i", "v", 4).collect()}
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert {tuple(r) for r in vectors.neighbours(df, df, "i", "v", 4).collect()} == one and len(one) == 62 * 4
    x = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v, _ in rows if v is not None}
    for q in (0, 17, 60):
        best = sorted((-round(float(x[q] @ x[b]), 6) + 0.0, b) for b in x if b != q)[:4]
        assert [(b, -s) for s, b in best] == [(r[1], r[2]) for r in sorted((r for r in one if r[0] == q), key=lambda r: r[3])]
    got = vectors.silhouette(df, "i", "v", "l").first()
    assert got["n"] == 61 and -1 <= got["silhouette"] <= 1
    assert vectors.silhouette(df.where("false"), "i", "v", "l").first()["n"] == 0 and vectors.neighbours(df.where("false"), df, "i", "v", 4).count() == 0
    assert vectors.cosine_moments(df.where("false"), "v").count() == 0
