"""Operators behind the further queries: hand-computed cases, numpy and pandas beside them, edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import tokenizer
from tallyframe.operators import arms, corpus, features, linear, models, splits, stats, tfidf, vectors
from tallyframe.sources import readers, sinks, workbook


def test_workbook_round_trip(spark, tmp_path):
    one = spark.createDataFrame([("UTB_1", 4.0, None), ("ñ <&> \"x\"", -2.5, 1.0), (None, None, 3.0)], "participant string, PHQ9 double, GAD7 double")
    path = "file://" + str(tmp_path / "a.xlsx")
    workbook.write_workbook(spark, {"scores": one, "empty": one.where("false")}, path)
    (tmp_path / "bad.xlsx").write_bytes(b"not a workbook")
    schema = T.StructType([T.StructField("participant", T.StringType()), T.StructField("GAD7", T.DoubleType()), T.StructField("PHQ9", T.DoubleType()), T.StructField("none", T.StringType())])
    got = workbook.read_workbooks(spark, "file://" + str(tmp_path) + "/*.xlsx", schema).drop("path")
    assert {tuple(r) for r in got.collect()} == {("UTB_1", None, 4.0, None), ("ñ <&> \"x\"", 1.0, -2.5, None), (None, 3.0, None, None)}
    assert workbook.read_workbooks(spark, path, schema, first_row_only=True).count() == 1
    sheet = workbook.workbook_bytes({"s": (["a" * 80], [("x",)])})
    import io
    import zipfile

    xml = zipfile.ZipFile(io.BytesIO(sheet)).read("xl/worksheets/sheet1.xml").decode()
    assert 'width="44"' in xml and 'state="frozen"' in xml
    with pytest.raises(FileNotFoundError):
        workbook.read_workbooks(spark, "file://" + str(tmp_path / "none.xlsx"), schema)


def test_a_table_over_the_limit_of_rows_goes_on_in_further_sheets(spark, tmp_path):
    import io
    import zipfile

    path = "file://" + str(tmp_path / "long.xlsx")
    long = spark.range(23, numPartitions=3).select(F.concat(F.lit("ñ & "), "id").alias("name"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("x"), (F.col("id") % 2 == 0).alias("even"))
    short = spark.createDataFrame([("a", 1.0)], "name string, x double")
    workbook.write_workbook(spark, {"it's long": long.orderBy(F.col("id").desc()), "short": short, "long (2)": short.where("false")}, path, most_rows=6)
    book = zipfile.ZipFile(io.BytesIO((tmp_path / "long.xlsx").read_bytes()))
    assert book.testzip() is None and len([n for n in book.namelist() if "/sheet" in n]) == 7
    xml = book.read("xl/worksheets/sheet4.xml").decode()
    assert xml.count("<row ") == 6 and '<c r="A2" t="inlineStr"><is><t xml:space="preserve">ñ &amp; 17</t>' in xml and '<row r="6">' in xml and 'width="8"' in xml
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("even", T.StringType())])
    read = lambda **k: [tuple(r)[1:] for r in workbook.read_workbooks(spark, path, schema, **k).collect()]
    assert sorted(read()) == sorted(tuple(r) for r in long.withColumn("even", F.initcap(F.col("even").cast("string"))).collect())
    assert read(first_row_only=True) == [("ñ & 22", 33.0, "True")] and read(sheet=1) == [("a", 1.0, None)] and read(sheet=2) == []
    same = workbook.workbook_bytes({"s": (["a"], [(1,), (2,), (3,)])}, 3)
    assert [list(workbook.part_rows(*p)) for p in workbook.sheet_parts(same)] == [[["a"], [1.0], [2.0]], [["a"], [3.0]]]



def test_summary_sheet_over_the_limit_of_rows(spark, monkeypatch):
    from functools import partial

    from tallyframe.plans.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    wanted = sorted(map(repr, QUERIES["a2_summary"](spark, folder).collect()))
    monkeypatch.setattr(workbook, "write_workbook", partial(workbook.write_workbook, most_rows=100))
    assert len(wanted) > 200 and sorted(map(repr, QUERIES["s14_summary_sheet"](spark, folder).collect())) == wanted


@pytest.mark.parametrize("tail", ['<row r="5"/><row r="6"><c r="B6" s="3"><v>7</v></c></row>', '<row><c><v>3</v></c><c/></row>', '<!-- <row> --><row r="1"><c r="A1" t="str"><v>&quot;&#65;</v></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>'])
def test_plain_rows_and_others_as_the_parser_reads_them(tail):
    import zlib

    plain = workbook._body(1, [(f"{i} & <{i * i % 977}>", i / 7, None, i % 2 == 0) for i in range(50000)])
    for body in (plain, tail + plain, plain + tail + plain):
        data = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{workbook._MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'.encode()
        deflate = zlib.compressobj(wbits=-15)
        packed = deflate.compress(data) + deflate.flush()
        got = list(workbook.part_rows(8, zlib.crc32(data), packed, b""))
        assert len(got) >= 50000 and got == list(workbook._parsed_rows([data], b""))
        with pytest.raises(workbook._DAMAGED):
            list(workbook.part_rows(8, zlib.crc32(data) ^ 1, packed, b""))



def test_ridge_against_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4)) * [1, 5, 0.1, 0] + [0, 2, 1, 3]
    y = x @ [1.0, -0.3, 4.0, 0.0] + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, y double").repartition(3)
    got = linear.ridge_cv(df, ["a", "b", "c", "d"], "y", (0.01, 1.0, 100.0))
    s = x.std(0)
    s[s < 1e-12] = 1
    z = (x - x.mean(0)) / s
    errors = []
    for a in (0.01, 1.0, 100.0):
        out = []
        for i in range(80):
            k = np.arange(80) != i
            zc, mid = z[k] - z[k].mean(0), z[k].mean(0)
            # Leave-one-out with the intercept refitted.
            w = np.linalg.solve(zc.T @ zc + a * np.eye(4), zc.T @ (y[k] - y[k].mean()))
            out.append((y[i] - y[k].mean() - (z[i] - mid) @ w) ** 2)
        errors.append(sum(out))
    assert got.alpha == (0.01, 1.0, 100.0)[int(np.argmin(errors))]
    w = np.linalg.solve(z.T @ z + got.alpha * np.eye(4), z.T @ (y - y.mean()))
    assert np.allclose(got.coefficients, w) and got.coefficients[3] == 0
    p = [r["y_pred"] for r in got.predict(df.dropna()).select("a", "y_pred").orderBy("a").collect()]
    assert np.allclose(p, (z @ w + y.mean())[np.argsort(x[:, 0])])
    assert [r["place"] for r in got.table(spark).orderBy("coefficient").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        linear.ridge_cv(df.where("false"), ["a"], "y")


@pytest.mark.parametrize("t,freedom,want", [(2.0, 10, 0.073388), (0.5, 3, 0.651448), (1.0, 1, 0.5), (3.2, 200, 0.001599), (12.0, 1000, 0.0), (0.0, 7, 1.0)])
def test_student_p(spark, t, freedom, want):
    got = spark.range(1).select(stats.student_p(F.lit(t), F.lit(float(freedom)))).first()[0]
    assert abs(got - want) < 2e-6


def test_rank_p_of_edges(spark):
    df = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.0, 9), (0.9, 2)], "rho double, n bigint")
    assert [r[0] for r in df.select(stats.spearman_p(F.col("rho"), F.col("n"))).collect()] == [0.0, 0.0, 1.0, 1.0]


def test_cache_keeps_ids_order_and_signature(spark, tmp_path):
    path = "file://" + str(tmp_path / "cache")
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "id string, pos int")
    made = lambda: ids.withColumn("x", F.col("pos") * 2)
    assert sinks.load_or_compute(spark, path, ids, None, made).count() == 2
    assert sinks.load_or_compute(spark, path, ids, "one", lambda: 1 / 0).count() == 2
    with pytest.raises(sinks.StaleCache):
        sinks.load_or_compute(spark, path, ids, "two", made)
    with pytest.raises(sinks.StaleCache):
        sinks.load_or_compute(spark, path, ids.withColumn("pos", 1 - F.col("pos")), "one", made)
    with pytest.raises(sinks.StaleCache):
        sinks.load_or_compute(spark, path, ids.where("id = 'a'"), "one", made)
    sinks.export_diagnostics("file://" + str(tmp_path / "d"), {"summary": made().withColumn("y", F.lit(1.23456))}, {"n": 2})
    assert spark.read.csv("file://" + str(tmp_path / "d/summary"), header=True).first()["y"] == "1.2346"
    assert json.loads(spark.read.text("file://" + str(tmp_path / "d/facts")).first()[0]) == {"n": 2}


def test_session_lines_equal_the_store(spark, tmp_path):
    store = {"b": {"rounds": [{"round": 2, "patient_input": "x  y"}, {"round": 1, "patient_input": "z"}]}, "a": {"rounds": [{"round": 1, "patient_input": "x y"}, {"round": 2, "patient_input": " "}]}}
    (tmp_path / "s.json").write_text(json.dumps(store))
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"session": k, **v}) for k, v in store.items()))
    one, two = readers.read_sessions(spark, str(tmp_path / "s.json")), readers.read_session_lines(spark, str(tmp_path / "s.jsonl"))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()} == {("a", 1, "x y"), ("b", 1, "z")}


def test_arms_and_their_matrices():
    assert arms.arm("l1_lexical").scaled and not arms.arm("e0_tfidf_base").scaled
    assert "l3_lexical__tfidf" in arms.applicable("lexical", "participant") and "l3_lexical__tfidf" not in arms.applicable("lexical", "question")
    with pytest.raises(KeyError):
        arms.arm("none")


def test_corpora_are_named_and_never_empty(spark):
    full, empty = spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([], "text string")
    known = {"a": lambda: full, "b": lambda: empty}
    assert corpus.build_corpora(known, ["a"]).first()["corpus"] == "a"
    with pytest.raises(KeyError):
        corpus.build_corpora(known, ["c"])
    with pytest.raises(corpus.EmptyCorpus):
        corpus.build_corpora(known, ["a", "b"])


def test_split_to_fit(spark):
    df = spark.createDataFrame([("Uno dos. Tres cuatro cinco. Seis.",), ("a b c d e f g.",), ("",), ("corto",)], "t string")
    assert [r[0] for r in df.select(corpus.split_to_fit(F.col("t"), 5)).collect()] == [["Uno dos. Tres cuatro cinco.", "Seis."], ["a b c d e", "f g."], [], ["corto"]]


def test_weighted_mask_always_takes_a_word(spark):
    df = spark.createDataFrame([(i, ["no", "sol", "mar"] * 4) for i in range(60)] + [(60, ["sol"]), (61, [])], "i long, w array<string>")
    got = {r["i"]: r["m"] for r in df.select("i", corpus.weighted_mask_plan(F.col("w"), ("no",), 0.3, 0.8, "s", F.col("i")).alias("m")).collect()}
    assert got[61] == [] and got[60] != [0] and all(sum(x > 0 for x in m) >= 1 for i, m in got.items() if i < 61)
    hit = np.array([[x > 0 for x in got[i]] for i in range(60)])
    assert hit[:, ::3].mean() > 0.6 > 0.2 > np.delete(hit, np.s_[::3], axis=1).mean()


def test_weighted_mask_takes_time_in_proportion_to_the_text(spark):
    import time

    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(16000)), lambda i: F.when(i % 10 == 0, "no").otherwise("sol")).alias("w")).cache()
    df.count()
    plan = df.select(corpus.weighted_mask_plan(F.col("w"), ("no",), 0.15, 0.5, "7", F.col("id")).alias("m"))
    began = time.perf_counter()
    hit = np.array(plan.first()["m"]) > 0
    assert time.perf_counter() - began < 20
    assert abs(hit.mean() - 0.15) < 0.02 and abs(hit[9::10].mean() - 0.5) < 0.05
    df.unpersist()



def test_word_spans_skip_placeholders(spark):
    got = spark.createDataFrame([("Vi a [NOMBRE] ayer, sí.",)], "t string").select(corpus.word_spans(F.col("t")).alias("w")).first()["w"]
    assert [(x["s"], x["e"], x["form"]) for x in got] == [(0, 2, "Vi"), (3, 4, "a"), (14, 18, "ayer"), (20, 22, "sí")]


def test_fertility_in_context(spark):
    pieces = {"Casa [LUGAR] añil.": [(0, 2), (2, 4), (4, 5), (5, 12), (13, 14), (14, 15), (15, 15), (15, 17), (17, 18)]}
    df = spark.createDataFrame([(1, "Casa [LUGAR] añil."), (2, None)], "i long, text string")
    got = corpus.fertility(df, "i", "text", lambda t: pieces[t], ["i"]).collect()
    assert [(r["form"], r["pieces"]) for r in got] == [("Casa", 2), ("añil", 3)]


def test_offsets_cover_the_text():
    pytest.importorskip("tiktoken")
    of = tokenizer.offsets("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    for text in ("hola mundo", "niño 你好 🙂 fin", ""):
        got = of(text)
        assert not text or (got[0][0] == 0 and got[-1][1] == len(text) and all(b[0] <= a[1] <= b[1] for a, b in zip(got, got[1:])))


def test_clinical_words_ignore_inflections(spark):
    df = spark.createDataFrame([("tristeza", None), ("cansada", "cansado"), ("cansada", None), ("sol", "sol")], "f string, l string")
    assert [r[0] for r in df.select(features.is_clinical(F.col("f"), F.col("l"))).collect()] == [True, True, False, False]


def test_side_by_side_scales_by_the_training_rows(spark):
    weights = spark.createDataFrame([(1, "sol", 1.0)], "i long, term string, weight double")
    named = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "i long, a double, b double")
    got = {(r["i"], r["feature"]): r["value"] for r in tfidf.side_by_side(weights, named, "i", ["a", "b"]).collect()}
    assert got == {(1, "text:sol"): 1.0, (1, "named:a"): -1.0, (2, "named:a"): 1.0, (1, "named:b"): 0.0, (2, "named:b"): 0.0}
    train = {(r["i"], r["feature"]): r["value"] for r in tfidf.side_by_side(weights, named, "i", ["a"], named.where("i = 1")).collect()}
    assert train[2, "named:a"] == 2.0


def test_pool_levels_weigh_levels_alike(spark):
    df = spark.createDataFrame([("p", "q1", [1.0, 0.0]), ("p", "q1", [3.0, 0.0]), ("p", "q2", [0.0, 4.0])], "p string, q string, v array<double>")
    assert vectors.pool_levels(df, [["p", "q"], ["p"]], "v").first()["v"] == [1.0, 2.0]
    assert np.allclose(vectors.pool_levels(df, [["p", "q"], ["p"]], "v", (False, True)).first()["v"], np.array([1, 2]) / 5**0.5)


def test_train_frame_refuses_leaks(spark):
    plain, more, held = (spark.createDataFrame([(x,) for x in xs], "s string") for xs in (["a", "b"], ["a", "t"], ["t"]))
    on = F.col("s") == F.col("h")
    held = held.withColumnRenamed("s", "h")
    assert splits.train_frame(plain, None, held, on).count() == 2
    with pytest.raises(splits.LeakageError):
        splits.train_frame(plain, more, held, on)


def test_draws_are_the_same_for_a_seed():
    assert models.draws("ridge", 3, 1) == models.draws("ridge", 3, 1) != models.draws("ridge", 3, 2)
    assert all(1e-2 <= d["regParam"] <= 1e4 for d in models.draws("ridge", 50, 7))
    with pytest.raises(KeyError):
        models.draws("svr_rbf", 1, 1)


def test_search_scores_the_baseline_by_folds(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 7.0)], "fold int, y double")
    got = models.search(df, [], "", "y", "fold").first()
    assert got["model"] == "dummy" and got["cv_rmse"] == pytest.approx((17**0.5 + 17**0.5) / 2)


def test_neutral_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in stats.neutral_stats(df, ["k"], "v", 5.0).collect()}
    assert got == {"a": (2.0, 1.0, 1.0, 3.0, 1.1), "b": (5.0, 0.0, 5.0, 5.0, 5.0)}


def test_collinear_ranks(spark):
    df = spark.createDataFrame([(1.0, 10.0, 3.0), (2.0, 100.0, 1.0), (3.0, 1000.0, 2.0), (4.0, 10000.0, 5.0), (None, 1.0, 1.0)], "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["abs_spearman"] for r in stats.collinear(df, ["a", "b", "c"], 0.9).collect()}
    assert got.keys() == {("a", "b")} and got["a", "b"] == pytest.approx(1)
