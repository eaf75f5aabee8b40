"""Readers for study files; every schema is given, and missing inputs fail before a plan is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schemas
from tallyframe.functions.text import fold


def require(spark: SparkSession, path: str, hint: str = "") -> str:
    """The path, or FileNotFoundError with a hint what to do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        raise FileNotFoundError(f"{path} does not exist. {hint}".strip())
    return path


def exists(spark: SparkSession, path: str) -> bool:
    try:
        require(spark, path)
    except FileNotFoundError:
        return False
    return True


def answer(text: Column) -> Column:
    """Stripped text; blank and omitted answers are NULL."""
    flat = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when((flat != "") & (F.upper(flat) != "OMITIDA"), flat)


def read_transcripts(spark: SparkSession, path: str, prefix: str = "UTB_") -> DataFrame:
    """A folder for each participant, a text file for each question: (participant, question, text). Undecodable bytes become U+FFFD.

    The files stay in long form; nobody is dropped here. ``drop_silent`` leaves out participants without any answer.
    """
    files = spark.read.text(require(spark, path).rstrip("/") + "/*/*.txt", wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
    named = files.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("participant"), F.regexp_extract("p", r"([^/]+)\.txt$", 1).alias("question"), answer(F.col("value")).alias("text"))
    return named.where(F.col("participant").startswith(prefix))


def drop_silent(long: DataFrame) -> DataFrame:
    heard = long.where("text is not null").select("participant").distinct()
    return long.join(heard, "participant", "left_semi")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", skip_bad: bool = False) -> DataFrame:
    """CSV with a header under an explicit schema; bad rows fail the read, or are left out with ``skip_bad``."""
    return spark.read.csv(require(spark, path), schema=schema, header=True, encoding=encoding, mode="DROPMALFORMED" if skip_bad else "FAILFAST", enforceSchema=False)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {session: {rounds: [{round, patient_input}]}} as distinct texts: the first occurrence by session name, then round."""
    raw = spark.read.text(require(spark, path), wholetext=True).select(F.from_json("value", schemas.SESSIONS).alias("m"))
    rounds = raw.select(F.explode("m").alias("session", "s")).select("session", F.explode("s.rounds").alias("r"))
    flat = rounds.select("session", F.col("r.round").alias("round"), F.trim(F.regexp_replace("r.patient_input", r"(?U)\s+", " ")).alias("text")).where("text <> ''")
    return flat.groupBy("text").agg(F.min(F.struct("session", "round")).alias("f")).select("f.session", "f.round", "text")


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same store as JSON lines {"session": .., "rounds": [..]}, which is read in parallel; same result as ``read_sessions``."""
    schema = T.StructType([T.StructField("session", T.StringType()), *schemas.SESSIONS.valueType.fields])
    rounds = spark.read.json(require(spark, path), schema=schema).select("session", F.explode("rounds").alias("r"))
    flat = rounds.select("session", F.col("r.round").alias("round"), F.trim(F.regexp_replace("r.patient_input", r"(?U)\s+", " ")).alias("text")).where("text <> ''")
    return flat.groupBy("text").agg(F.min(F.struct("session", "round")).alias("f")).select("f.session", "f.round", "text")


def session_texts(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy("session", "round").select("text")


class WrongEdition(ValueError):
    """A norm file lacks columns or leaves the published scale."""


def _in_range(df: DataFrame, columns: list[str], low: float, high: float) -> None:
    outside = F.lit(False)
    for c in columns:
        outside = outside | (F.col(c) < low) | (F.col(c) > high)
    if df.where(outside).limit(1).count():
        raise WrongEdition(f"ratings outside {low} to {high}")


def read_norms(spark: SparkSession, valence_path: str, emotion_path: str) -> DataFrame:
    """Affective norms by folded word: means over the words that fold alike, the first part of speech that is given.

    Both files are Latin-1; header blanks are cut; words rated by few people are left out of the emotions.
    """

    def raw(path: str, schema: T.StructType) -> DataFrame:
        df = spark.read.csv(require(spark, path), header=True, encoding="ISO-8859-1")
        df = df.toDF(*[c.strip() for c in df.columns])
        missing = [f.name for f in schema if f.name not in df.columns]
        if missing:
            raise WrongEdition(f"{path} lacks {missing}")
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).withColumn("seq", F.monotonically_increasing_id())

    va = raw(valence_path, schemas.VALENCE_NORMS).dropna(subset=["Word", "ValenceMean", "ArousalMean"])
    _in_range(va, ["ValenceMean", "ArousalMean"], 1.0, 9.0)
    emotions = ["Happiness", "Disgust", "Anger", "Fear", "Sadness"]
    emo = raw(emotion_path, schemas.EMOTION_NORMS).where("Few_Raters is null").dropna(subset=["Word"])
    _in_range(emo, [f"{e}_Mean" for e in emotions], 1.0, 5.0)
    a = va.groupBy(fold(F.col("Word")).alias("key")).agg(F.avg("ValenceMean").alias("valence"), F.avg("ArousalMean").alias("arousal"))
    pos = F.min_by("Dominant_POS", F.when(F.col("Dominant_POS").isNotNull(), F.col("seq"))).alias("dominant_pos")
    b = emo.groupBy(fold(F.col("Word")).alias("key")).agg(pos, *[F.avg(f"{e}_Mean").alias(e.lower()) for e in emotions])
    return a.join(b, "key", "full")


STEM = r"^(.*)__((?:(?!__).)*)__((?:(?!__).)*)__((?:(?!__).)*)$"


def read_prediction_files(spark: SparkSession, root: str) -> DataFrame:
    """Prediction CSVs under family/augmentation/granularity/predictions; the stem is encoder__target__seed__search, split from the right. No file: an empty frame."""
    if not exists(spark, root.rstrip("/") + "/*/*/*/predictions/*.csv"):
        return spark.createDataFrame([], schemas.PREDICTIONS)
    files = spark.read.csv(root.rstrip("/") + "/*/*/*/predictions/*.csv", schema="participant string, y_true double, y_pred double", header=True).withColumn("__p", F.col("_metadata.file_path"))
    part = F.split(F.col("__p"), "/")
    back = lambda n: F.element_at(part, -n)
    stem = F.regexp_replace(back(1), r"\.csv$", "")
    pick = lambda n: F.regexp_extract(stem, STEM, n)
    return files.select("participant", "y_true", "y_pred", pick(1).alias("encoder"), pick(2).alias("target"), pick(3).cast("int").alias("seed"), pick(4).alias("search"), back(5).alias("family"), back(4).alias("augmentation"), back(3).alias("granularity"))


def read_run_logs(spark: SparkSession, root: str) -> DataFrame:
    """All logs written by ``append_rows``; older ones with fewer columns get NULLs."""
    return spark.read.option("mergeSchema", "true").parquet(require(spark, root))


def read_placed_logs(spark: SparkSession, root: str, place: tuple[str, ...] = ("family", "augmentation", "granularity")) -> DataFrame:
    """All logs under ``root``, at any depth: what a row leaves blank of ``place`` comes from the last folders of its path."""
    files = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(require(spark, root)).withColumn("__p", F.split(F.col("_metadata.file_path"), "/"))
    made = {}
    for k, name in enumerate(reversed(place)):
        folder = F.element_at("__p", -(k + 2))
        made[name] = F.coalesce(F.nullif(F.col(name), F.lit("")), folder) if name in files.columns else folder
    return files.withColumns(made).drop("__p")


def union_logs(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
