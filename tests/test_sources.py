import json

import pytest
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.sources import readers, sinks
from tallyframe.streaming import latest as st


def test_transcripts(spark, tmp_path):
    for who, files in {"UTB_1": {"Q01": " Hola \n", "Q02": "omitida"}, "UTB_2": {"Q01": "  "}, "other": {"Q01": "x"}}.items():
        (tmp_path / who).mkdir()
        for q, t in files.items():
            (tmp_path / who / f"{q}.txt").write_text(t)
    got = readers.read_transcripts(spark, str(tmp_path))
    assert {(r["participant"], r["question"], r["text"]) for r in got.collect()} == {("UTB_1", "Q01", "Hola"), ("UTB_1", "Q02", None), ("UTB_2", "Q01", None)}
    assert {r["participant"] for r in readers.drop_silent(got).collect()} == {"UTB_1"}


def test_missing_path_says_so(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_transcripts(spark, str(tmp_path / "none"))


def test_sessions_keep_the_first_occurrence(spark, tmp_path):
    data = {"b": {"rounds": [{"round": 1, "patient_input": "uno  dos"}]}, "a": {"rounds": [{"round": 2, "patient_input": "uno dos"}, {"round": 1, "patient_input": " "}]}}
    (tmp_path / "s.json").write_text(json.dumps(data))
    assert [tuple(r) for r in readers.read_sessions(spark, str(tmp_path / "s.json")).collect()] == [("a", 2, "uno dos")]


def test_norms(spark, tmp_path):
    (tmp_path / "va.csv").write_bytes(" Word ,ValenceMean,ArousalMean\nestá,4,2\nesta,6,4\nsol,8,5\n".encode("latin-1"))
    (tmp_path / "emo.csv").write_bytes("Word,Few_Raters,Dominant_POS,Happiness_Mean,Disgust_Mean,Anger_Mean,Fear_Mean,Sadness_Mean\nsol,,NOUN,4,1,1,1,1\nniño,*,NOUN,3,1,1,1,1\n".encode("latin-1"))
    got = {r["key"]: r for r in readers.read_norms(spark, str(tmp_path / "va.csv"), str(tmp_path / "emo.csv")).collect()}
    assert got["esta"]["valence"] == 5.0 and got["sol"]["dominant_pos"] == "NOUN" and "nino" not in got
    (tmp_path / "va.csv").write_text("Word,ValenceMean,ArousalMean\nsol,11,5\n")
    with pytest.raises(readers.WrongEdition):
        readers.read_norms(spark, str(tmp_path / "va.csv"), str(tmp_path / "emo.csv"))


def test_prediction_files(spark, tmp_path):
    assert readers.read_prediction_files(spark, str(tmp_path)).count() == 0
    d = tmp_path / "frozen" / "augmented" / "question" / "predictions"
    d.mkdir(parents=True)
    (d / "L2__affect__PHQ9__42__random15.csv").write_text("participant,y_true,y_pred\nUTB_1,1,2\n")
    assert tuple(readers.read_prediction_files(spark, str(tmp_path)).first()) == ("UTB_1", 1.0, 2.0, "L2__affect", "PHQ9", 42, "random15", "frozen", "augmented", "question")


def test_log_append_evolves_and_snapshots_replace(spark, tmp_path):
    root = str(tmp_path / "log")
    old = spark.createDataFrame([(1, "f", "a", "q", 2.0)], "run_id long, family string, augmentation string, granularity string, rmse double")
    sinks.append_rows(old, root)
    sinks.append_rows(old.withColumns({"run_id": F.lit(2).cast("long"), "mae": F.lit(1.0)}), root)
    assert {(r["run_id"], r["mae"]) for r in readers.read_run_logs(spark, root).collect()} == {(1, None), (2, 1.0)}
    with pytest.raises(ValueError):
        sinks.append_rows(old.drop("run_id"), root)
    snap = str(tmp_path / "snap")
    sinks.overwrite_snapshot(spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), snap, ["k"])
    sinks.overwrite_snapshot(spark.createDataFrame([("x", 9)], "k string, v int"), snap, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(snap).collect()} == {("x", 9), ("y", 2)}


def test_cache_guards(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    make = lambda: ids.withColumn("v", F.lit(1.0))
    path = str(tmp_path / "m")
    assert sinks.load_or_compute(spark, path, ids, "s1", make).count() == 2
    assert sinks.load_or_compute(spark, path, ids, "s1", None).count() == 2
    with pytest.raises(sinks.StaleCache):
        sinks.load_or_compute(spark, path, ids, "s2", None)
    with pytest.raises(sinks.StaleCache):
        sinks.load_or_compute(spark, path, ids.where("id = 'a'"), "s1", None)


def test_migrate_and_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "i int, k string")
    assert {(r["k"], r["rows"]) for r in sinks.migrate(df, str(tmp_path / "new"), ["k"]).collect()} == {("x", 1), ("y", 2)}
    assert not (tmp_path / "new").exists()
    sinks.migrate(df, str(tmp_path / "new"), ["k"], dry_run=False)
    assert spark.read.parquet(str(tmp_path / "new")).count() == 3
    sinks.export_sheets({"a": df}, str(tmp_path / "book"))
    assert readers.read_csv(spark, str(tmp_path / "book" / "a" / "*.csv"), df.schema).count() == 3


def test_streaming_latest(spark, tmp_path):
    src = str(tmp_path / "src")
    row = lambda i, rmse: (i, "e", "n", "t", 1, "s", rmse)
    schema = "run_id long, encoder string, augmentation string, target string, seed int, search string, rmse double"
    spark.createDataFrame([row(1, 2.0), row(2, 3.0)], schema).withColumn("logged_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = st.latest_state(stream.drop("logged_at")).writeStream.format("memory").queryName("latest_state").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [r["run_id"] for r in spark.table("latest_state").collect()] == [2]
    w = st.score_windows(st.distinct_runs(stream), late=None).writeStream.format("noop").outputMode("append").start()
    w.processAllAvailable()
    w.stop()


def test_schemas_are_explicit():
    assert dict(zip(schemas.RUN_LOG.names, [f.dataType.simpleString() for f in schemas.RUN_LOG]))["notebook"] == "string"
