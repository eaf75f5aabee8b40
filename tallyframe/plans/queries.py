"""The library's operators as queries over the project's tables; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import lexicons as lex
from tallyframe.functions import text as tx
from tallyframe.functions.scores import band, clip_target, finite, screen
from tallyframe.functions.vectors import cosine, norm, unit
from tallyframe.operators import corpus, features, metrics, models, runs, splits, stats, tfidf, vectors
from tallyframe.plans import blocks
from tallyframe.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rnd(c: Column | str, digits: int) -> Column:
    """Rounded so that values on a half go up whatever the order of summing was."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), digits)


def r6(c: Column | str) -> Column:
    return rnd(c, 6)


def log(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Run log with one line a run: encoder and target in one spelling, scores NULL where they are no usable number."""
    df = table(spark, sf, "experiment_log").select("run_id", *cols)
    kinds = dict(df.dtypes)
    made = {c: tx.label(F.col(c)) for c in ("encoder", "target") if c in cols} | {c: finite(F.col(c)) for c in cols if kinds[c] == "double"}
    return df.withColumns(made).distinct()


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with session and clean labels; rows without truth, prediction or session do not take part."""
    df = table(spark, sf, "predictions")
    named = df.withColumns({"session": tx.session_key(F.col("participant")), "encoder": tx.label(F.col("encoder")), "target": tx.label(F.col("target")), "y_true": finite(F.col("y_true")), "y_pred": finite(F.col("y_pred"))})
    return named.dropna(subset=["session", "y_true", "y_pred"])


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Scores, one row a participant, both totals present."""
    return table(spark, sf, "scores").dropna(subset=["participant", "phq9_total", "gad7_total"]).groupBy("participant").agg(F.min("phq9_total").alias("phq9_total"), F.min("gad7_total").alias("gad7_total"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that are there: no NULL, blank or omitted text."""
    df = table(spark, sf, "transcription")
    flat = F.trim(F.regexp_replace("text", r"[\s ]+", " "))
    return df.withColumn("text", flat).where(F.col("text").isNotNull() & (F.col("text") != "") & (F.upper("text") != "OMITIDA"))


# Run log -----------------------------------------------------------------------------------------------------


@query
def w1_latest_run(spark, sf):
    return runs.latest(log(spark, sf, *runs.RUN_KEY, "rmse"), runs.RUN_KEY, "run_id").withColumn("rmse", r6("rmse"))


@query
def w1_latest_trial(spark, sf):
    return runs.last_in_order(log(spark, sf, *runs.TRIAL_KEY, "mae"), runs.TRIAL_KEY, ["run_id"]).withColumn("mae", r6("mae"))


@query
def a2_summary(spark, sf):
    keys = ["family", "granularity", "encoder", "search", "target"]
    return runs.summarize(log(spark, sf, *keys, "rmse"), keys, "rmse", 12).withColumns({c: rnd(c, 3) for c in ("mean", "sd")})


@query
def a3_best_per_seed(spark, sf):
    return runs.best(log(spark, sf, "encoder", "target", "seed", "rmse"), ["encoder", "target", "seed"], "rmse", "run_id").withColumn("rmse", r6("rmse"))


@query
def a4_best_arm(spark, sf):
    df = log(spark, sf, "family", "granularity", "target", "encoder", "rmse", "mae", "r2")
    return runs.best(df, ["family", "granularity", "target"], "rmse", "run_id").withColumns({c: r6(c) for c in ("rmse", "mae", "r2")})


@query
def a5_coverage(spark, sf):
    return log(spark, sf, "family", "target", "encoder", "seed").groupBy("family", "target").agg(F.countDistinct("encoder").alias("encoders"), F.countDistinct("seed").alias("seeds"), F.count(F.lit(1)).alias("runs"))


@query
def a6_same_people(spark, sf):
    sets = scored(spark, sf).groupBy("family", "target", "seed").agg(F.array_join(F.sort_array(F.collect_set("granularity")), ",").alias("members"))
    return sets.groupBy("family", "target").agg(F.countDistinct("members").alias("different_sets"), F.max("members").alias("last_set"))


@query
def a7_value_counts(spark, sf):
    return table(spark, sf, "experiment_log").groupBy("split", "fold").agg(F.count(F.lit(1)).alias("n")).orderBy("split", "fold")


@query
def a8_size_any(spark, sf):
    df = log(spark, sf, "encoder", "family", "granularity", "target", "r2")
    return df.groupBy("encoder", "family", "granularity", "target").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("r2") < 0, F.lit(False))).alias("any_negative")).orderBy(F.col("n").desc(), "encoder", "family")


@query
def a9_conditional_means(spark, sf):
    df = log(spark, sf, "family", "rmse", "split")
    share = lambda c: 100 * F.avg(F.when(c.isNotNull(), (c > 5).cast("double")))
    test = F.when(F.col("split") == "test", F.col("rmse"))
    return df.groupBy("family").agg(r6(F.avg("rmse")).alias("all_mean"), r6(share(F.col("rmse"))).alias("all_pct"), r6(F.avg(test)).alias("test_mean"), r6(share(test)).alias("test_pct"))


@query
def a10_column_summary(spark, sf):
    cols = ["rmse", "mae", "r2", "band_f1_macro", "band_qwk", "screening_f1", "screening_auc"]
    long = log(spark, sf, *cols).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in cols])).alias("s")).select("s.*")
    return long.groupBy("feature").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("sd"), r6(F.min("v")).alias("min"), r6(F.max("v")).alias("max"), r6(100 * F.avg((F.col("v") != 0).cast("double"))).alias("pct_nonzero"))


@query
def a12_first_not_null(spark, sf):
    return runs.first_not_null(log(spark, sf, "encoder", "encoder_model", "family"), ["encoder"], "encoder_model", "run_id")


@query
def a16_upper_median(spark, sf):
    df = table(spark, sf, "documents").withColumn("n", F.char_length("text")).where(F.col("n").isNotNull())
    counts = df.groupBy("source", "n").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("k").over(Window.partitionBy("source"))
    ranked = counts.withColumns({"upto": F.sum("k").over(w), "total": total})
    return ranked.groupBy("source").agg(F.min("n").alias("shortest"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("upper_median"), F.max("n").alias("longest"))


@query
def a17_epoch_budget(spark, sf):
    df = log(spark, sf, "encoder", "target", "fold").where("fold is not null")
    return df.groupBy("encoder", "target").agg(F.greatest(F.lit(1), F.floor(F.percentile("fold", F.lit(0.5))).cast("int")).alias("epochs"))


@query
def a20_cv_score(spark, sf):
    df = log(spark, sf, "encoder", "target", "search", "split", "fold", "rmse").where("split = 'cv' and rmse is not null")
    by_fold = df.groupBy("encoder", "target", "search", "fold").agg(F.avg("rmse").alias("rmse"))
    return by_fold.groupBy("encoder", "target", "search").agg(r6(F.avg("rmse")).alias("cv_rmse"), F.count(F.lit(1)).alias("folds"))


@query
def a22_metric_means(spark, sf):
    df = log(spark, sf, "family", "target", "screening_f1", "screening_auc", "band_qwk")
    return df.groupBy("family", "target").agg(*[r6(F.avg(c)).alias(c) for c in ("screening_f1", "screening_auc", "band_qwk")])


@query
def v2_strict_pivot(spark, sf):
    best = runs.best(log(spark, sf, "encoder", "seed", "target", "rmse"), ["encoder", "seed", "target"], "rmse", "run_id").dropna(subset=["encoder", "seed"])
    return runs.strict_pivot(best.withColumn("rmse", r6("rmse")), ["encoder", "seed"], "target", ["phq9_total", "gad7_total"], "rmse")


@query
def v3_pivot_mean(spark, sf):
    df = log(spark, sf, "encoder", "family", "split", "rmse").where(F.col("split").isin("cv", "test"))
    wide = df.groupBy("encoder", "family").pivot("split", ["cv", "test"]).agg(F.avg("rmse"))
    return wide.select("encoder", "family", r6("cv").alias("cv"), r6("test").alias("test"), r6(F.col("cv") - F.col("test")).alias("cv_minus_holdout"))


@query
def proj2_filter_isin(spark, sf):
    df = table(spark, sf, "experiment_log")
    return df.where(F.col("family").isin("frozen", "lexical") & F.col("encoder_model").startswith("checkpoint/") & ~F.col("encoder_model").endswith("base")).groupBy("family", "search").agg(F.count(F.lit(1)).alias("n"))


@query
def proj7_label_map(spark, sf):
    names = {"frozen": "Frozen", "fine-tuning": "Fine-tuned", "fine-tuning-cv": "Fine-tuned (CV)", "lexical": "Named features"}
    mapped = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("family")], F.col("family"))
    return table(spark, sf, "experiment_log").groupBy(mapped.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def proj8_readable_arm(spark, sf):
    e = tx.label(F.col("encoder"))
    kind = F.when(e.startswith("e0"), "baseline").when(e.startswith("l"), "named").when(e.contains("-ft"), "fine-tuned").otherwise("frozen")
    return table(spark, sf, "experiment_log").where(e.isNotNull()).groupBy(kind.alias("kind"), F.substring_index(e, "_v", 1).alias("arm")).agg(F.count(F.lit(1)).alias("n"))


@query
def proj10_numbers(spark, sf):
    df = table(spark, sf, "experiment_log").select("run_id", F.get_json_object("config_json", "$.n_iter").try_cast("double").alias("n_iter"), rnd(finite(F.col("rmse")), 3).alias("rmse")).distinct()
    return df.where("run_id is not null")


@query
def proj12_labels(spark, sf):
    df = log(spark, sf, "encoder", "search", "granularity")
    tag = F.upper(F.regexp_replace(F.concat_ws("-", "encoder", "granularity"), "[^A-Za-z0-9]+", "_"))
    return df.where("encoder is not null").select(tag.alias("tag"), F.when(F.col("search") == "defaults", "D").otherwise("S").alias("kind")).groupBy("tag", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def f19_json(spark, sf):
    df = log(spark, sf, "screening_confusion_matrix", "selected_params")
    m = F.from_json("screening_confusion_matrix", "array<array<bigint>>")
    cell = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    return df.where("screening_confusion_matrix is not null").select("run_id", cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"), r6(F.get_json_object("selected_params", "$.alpha").try_cast("double")).alias("alpha"))


@query
def f20_file_stem(spark, sf):
    df = log(spark, sf, "encoder", "target", "search").where("encoder is not null and target is not null and search is not null")
    return df.select(tx.file_stem(F.concat_ws("__", "encoder", "target", "search")).alias("stem")).distinct()


@query
def o2_top_scores(spark, sf):
    return log(spark, sf, "encoder", "r2").where("r2 is not null").orderBy(F.col("r2").desc(), "run_id").limit(20).withColumn("r2", r6("r2"))


@query
def o3_best_candidate(spark, sf):
    scores = log(spark, sf, "selected_model", "rmse").where("selected_model is not null").groupBy("selected_model").agg(r6(F.avg("rmse")).alias("cv_rmse"))
    return models.best_candidate(scores, "selected_model", "cv_rmse", "Dummy")


@query
def o4_union(spark, sf):
    a = log(spark, sf, "family", "search").select("family", F.col("search").alias("kind"))
    b = table(spark, sf, "predictions").select("family", "augmentation")
    return a.unionByName(b.withColumn("kind", F.lit(None).cast("string")), allowMissingColumns=True).groupBy("family", "kind", "augmentation").agg(F.count(F.lit(1)).alias("n"))


@query
def o5_intersect(spark, sf):
    a = table(spark, sf, "experiment_log").select(tx.label(F.col("encoder")).alias("encoder"))
    return a.intersect(table(spark, sf, "predictions").select(tx.label(F.col("encoder")).alias("encoder")))


@query
def o6_except(spark, sf):
    a = table(spark, sf, "experiment_log").select(tx.label(F.col("encoder")).alias("encoder"))
    return a.subtract(table(spark, sf, "predictions").select(tx.label(F.col("encoder")).alias("encoder")))


@query
def o7_ordered_dedupe(spark, sf):
    df = log(spark, sf, "encoder").where("encoder is not null").groupBy("encoder").agg(F.min("run_id").alias("first_run"))
    return df.orderBy("first_run")


@query
def w9_early_stopping(spark, sf):
    df = log(spark, sf, "encoder", "target", "rmse").where("encoder is not null and target is not null and rmse is not null")
    epoch = F.row_number().over(Window.partitionBy("encoder", "target").orderBy("run_id"))
    return runs.early_stop(df.withColumn("epoch", epoch), ["encoder", "target"], "epoch", "rmse", patience=3, tolerance=0.0001)


@query
def w11_curve(spark, sf):
    df = log(spark, sf, "encoder", "fold", "rmse").where("encoder is not null")
    at = F.coalesce(F.col("fold"), F.lit(0))
    return df.groupBy("encoder", at.alias("epoch")).agg(r6(F.avg("rmse")).alias("rmse")).orderBy("encoder", "epoch")


@query
def x16_contrasts(spark, sf):
    df = log(spark, sf, "encoder", "target", "granularity", "augmentation", "rmse").where("encoder is not null and target is not null and rmse is not null")
    mean = df.groupBy("encoder", "target", "granularity").pivot("augmentation", ["augmented", "no_augmentation"]).agg(F.avg("rmse")).dropna(subset=["augmented", "no_augmentation"])
    d = rnd(F.col("augmented") - F.col("no_augmentation"), 6)
    return mean.select("encoder", "target", "granularity", d.alias("difference"), F.when(d < 0, "A").otherwise("B").alias("winner"))


#: Arms by the checkpoint they use; an arm that isn't here is its own.
CHECKPOINTS = {"e0_tfidf_base": "tf-idf", "e1_beto": "beto", "e5_beto-ft": "beto", "e6_beto-cv": "beto", "e2_e5-small": "e5-small", "e2_e5-base": "e5-base", "e2_e5-large": "e5-large", "e5_roberta-ft": "roberta"}


@query
def x16_checkpoint_contrasts(spark, sf):
    """The contrasts of X16 beside ``x16_contrasts``, over test runs: difference is b - a of the mean rmse, ties go to b."""
    df = log(spark, sf, "encoder", "target", "family", "granularity", "augmentation", "split", "rmse").where("split = 'test' and encoder is not null and target is not null and rmse is not null")
    arm = F.substring_index("encoder", "_v", 1)
    checkpoint = F.coalesce(F.create_map(*[F.lit(x) for p in CHECKPOINTS.items() for x in p])[arm], arm)
    is_ = lambda **want: F.expr(" and ".join(f"{k} = '{v}'" for k, v in want.items()))
    tuned_cv = is_(family="fine-tuning-cv", augmentation="augmented")
    contrasts = {
        "granularity": ("participant", is_(family="frozen", augmentation="no_augmentation", granularity="participant"), "question", is_(family="frozen", augmentation="no_augmentation", granularity="question")),
        "stopping": ("holdout", is_(family="fine-tuning"), "cross-validation", tuned_cv),
        "fine_tuning": ("frozen", is_(family="frozen", augmentation="augmented", granularity="question"), "fine-tuned", tuned_cv),
    }
    marks = [F.when(when, F.struct(F.lit(c).alias("contrast"), F.lit(x[0]).alias("name_a"), F.lit(x[2]).alias("name_b"), F.lit(side).alias("side"))) for c, x in contrasts.items() for side, when in (("a", x[1]), ("b", x[3]))]
    marked = df.select("target", "rmse", checkpoint.alias("arm"), F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).select("m.*", "arm", "target", "rmse")
    keys = ["contrast", "name_a", "name_b", "arm", "target"]
    paired = marked.groupBy(*keys, F.lit(None).cast("string").alias("granularity")).pivot("side", ["a", "b"]).agg(F.avg("rmse")).dropna(subset=["a", "b"])
    plain = df.where("augmentation = 'no_augmentation'").withColumn("kind", arm)
    base = plain.where("kind = 'e2_e5-small'").groupBy("target", "granularity").agg(F.avg("rmse").alias("a"))
    adapted = plain.where("kind = 'e3_e5-tsdae'").groupBy("encoder", "target", "granularity").agg(F.avg("rmse").alias("b"))
    tsdae = adapted.join(base, ["target", "granularity"]).withColumns({"contrast": F.lit("tsdae"), "name_a": F.lit("e5-small"), "name_b": F.lit("e5-small adapted"), "arm": F.col("encoder")}).drop("encoder")
    both = paired.unionByName(tsdae).withColumns({"a": r6("a"), "b": r6("b")})
    return both.select("contrast", "arm", "target", "granularity", "a", "b", r6(F.col("b") - F.col("a")).alias("difference"), F.when(F.col("a") < F.col("b"), F.col("name_a")).otherwise(F.col("name_b")).alias("winner"))


@query
def x17_family_difference(spark, sf):
    df = log(spark, sf, "family", "target", "seed", "rmse").where("rmse is not null")
    side = lambda f: df.where(F.col("family") == f).groupBy("target", "seed").agg(F.avg("rmse").alias(f.replace("-", "_")))
    both = side("fine-tuning-multitask").join(side("fine-tuning"), ["target", "seed"])
    return both.select("target", "seed", r6(F.col("fine_tuning_multitask") - F.col("fine_tuning")).alias("difference"))


@query
def x18_cv_vs_test(spark, sf):
    df = log(spark, sf, "encoder", "target", "split", "rmse").where("encoder is not null and rmse is not null")
    wide = df.groupBy("target", "encoder").pivot("split", ["cv", "test"]).agg(F.round(F.avg("rmse"), 9)).dropna(subset=["cv", "test"])
    return stats.spearman(wide, ["target"], "cv", "test").where("n > 2").select("target", "n", rnd("rho", 5).alias("rho"))


# Predictions, metrics, statistics ----------------------------------------------------------------------------


@query
def a1_mean_per_person(spark, sf):
    return metrics.aggregate_predictions(scored(spark, sf), ["encoder", "target"], "session").select("encoder", "target", "session", r6("y_true").alias("y_true"), r6("y_pred").alias("y_pred"))


@query
def a13_error_by_granularity(spark, sf):
    return metrics.regression(scored(spark, sf), ["granularity", "target"], "y_true", "y_pred").select("granularity", "target", "n", r6("rmse").alias("rmse"))


@query
def a18_mean_baseline(spark, sf):
    marked = splits.rank_split(splits.stratify_key(people(spark, sf), "phq9_total", "gad7_total"), "participant", "stratum")
    both = models.dummy(marked.where("split = 'train'"), marked.where("split = 'test'"), "phq9_total")
    return metrics.regression(both, [], "phq9_total", "y_pred").select("n", r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("r2").alias("r2"))


def _clipped(spark, sf, *by: str):
    """Truth and prediction of each participant: the mean over the rows of one ``by`` and target, then clipped to the scale."""
    by = by or ("encoder",)
    mean = metrics.aggregate_predictions(scored(spark, sf), [*by, "target"], "session")
    known = mean.withColumn("y_pred", F.round(clip_target(F.col("y_pred"), F.col("target")), 9)).withColumn("y_true", F.round("y_true", 9))
    return known.where(" and ".join(f"{c} is not null" for c in (*by, "target", "y_pred")))


@query
def a21_out_of_fold(spark, sf):
    return metrics.regression(_clipped(spark, sf), ["encoder", "target"], "y_true", "y_pred").select("encoder", "target", "n", r6("rmse").alias("rmse"))


@query
def x1_regression(spark, sf):
    return metrics.regression(_clipped(spark, sf), ["encoder", "target"], "y_true", "y_pred").select("encoder", "target", "n", r6("rmse").alias("rmse"), r6("mae").alias("mae"), rnd("r2", 5).alias("r2"))


def _banded(spark, sf, *by: str):
    return _clipped(spark, sf, *by).withColumns({"bt": band(F.col("y_true")), "bp": band(F.col("y_pred")), "st": screen(F.col("y_true")), "sp": screen(F.col("y_pred"))})


@query
def f13_bands(spark, sf):
    df = table(spark, sf, "scores")
    return df.select("participant", band(F.col("phq9_total")).alias("phq_band"), band(F.col("gad7_total")).alias("gad_band"), screen(F.col("phq9_total")).alias("phq_screen"), screen(F.col("gad7_total")).alias("gad_screen"))


@query
def f15_clip(spark, sf):
    """Clipping comes after the mean of a participant, never before."""
    mean = metrics.aggregate_predictions(scored(spark, sf), ["encoder", "target"], "session").withColumn("raw", F.round("y_pred", 9))
    clipped = mean.withColumn("kept", F.round(clip_target(F.col("raw"), F.col("target")), 9)).where("kept is not null")
    return clipped.groupBy("target").agg(rnd(F.min("kept"), 6).alias("low"), rnd(F.max("kept"), 6).alias("high"), F.sum((F.col("raw") != F.col("kept")).cast("bigint")).alias("moved"))


@query
def f28_standardise(spark, sf):
    df = people(spark, sf)
    s = df.agg(F.avg("phq9_total").alias("m"), F.coalesce(F.nullif(F.stddev_pop("phq9_total"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return df.crossJoin(F.broadcast(s)).select("participant", r6((F.col("phq9_total") - F.col("m")) / F.col("s")).alias("z"))


@query
def x2_confusion(spark, sf):
    return metrics.confusion(_banded(spark, sf, "family"), ["target", "family"], "bt", "bp", [0, 1, 2, 3])


@query
def x3_f1_macro(spark, sf):
    return metrics.f1_macro(_banded(spark, sf), ["encoder", "target"], "bt", "bp").select("encoder", "target", r6("f1_macro").alias("f1_macro"))


@query
def x4_qwk(spark, sf):
    return metrics.qwk(_banded(spark, sf), ["encoder", "target"], "bt", "bp").select("encoder", "target", r6("qwk").alias("qwk"))


@query
def x5_f1_screening(spark, sf):
    found = metrics.f1(_banded(spark, sf), ["encoder", "target"], "st", "sp")
    return found.where("label = 1").select("encoder", "target", r6("f1").alias("f1"))


@query
def x6_auc(spark, sf):
    return metrics.auc(_banded(spark, sf), ["encoder", "target"], "st", "y_pred").select("encoder", "target", r6("auc").alias("auc"))


BASE_ARM = "e0_tfidf_base"


def _pairs(spark, sf):
    mean = _clipped(spark, sf)
    base = mean.where(F.col("encoder") == BASE_ARM).select("session", "target", F.col("y_pred").alias("pb"))
    other = mean.where(F.col("encoder") != BASE_ARM).select("encoder", "session", "target", F.col("y_true").alias("y"), F.col("y_pred").alias("pa"))
    both = other.join(base, ["session", "target"])
    ea, eb = F.abs(F.col("pa") - F.col("y")), F.abs(F.col("pb") - F.col("y"))
    return both.withColumns({"ea": rnd(ea, 6), "eb": rnd(eb, 6)})


@query
def j3_paired(spark, sf):
    return _pairs(spark, sf).groupBy("encoder", "target").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("ea") ** 2 - F.col("eb") ** 2)).alias("d_squared"), r6(F.avg(F.col("ea") - F.col("eb"))).alias("d_absolute"))


@query
def j4_paired_conditions(spark, sf):
    df = metrics.aggregate_predictions(scored(spark, sf).where("augmentation is not null and target is not null"), ["augmentation", "target"], "session")
    got = stats.paired(df, ["session"], "augmentation", "augmented", "no_augmentation", "y_true", "y_pred", ["target"])
    return got.groupBy("target").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("d_squared")).alias("d_squared"), r6(F.avg("d_absolute")).alias("d_absolute"))


@query
def j5_baseline_join(spark, sf):
    mean = log(spark, sf, "encoder", "target", "rmse").where("encoder is not null and target is not null").groupBy("encoder", "target").agg(F.avg("rmse").alias("rmse"))
    base = mean.where(F.col("encoder") == BASE_ARM).select("target", F.col("rmse").alias("base"))
    return mean.where(F.col("encoder") != BASE_ARM).join(base, "target").select("encoder", "target", r6("rmse").alias("rmse"), r6(F.col("rmse") - F.col("base")).alias("gain"))


@query
def x9_wilcoxon(spark, sf):
    tested = stats.wilcoxon(_pairs(spark, sf), ["encoder", "target"], "ea", "eb")
    return tested.select("encoder", "target", "pairs", rnd("w", 3).alias("w"), rnd("p", 5).alias("p"))


@query
def w3_holm(spark, sf):
    tested = stats.wilcoxon(_pairs(spark, sf), ["encoder", "target"], "ea", "eb").withColumn("p", rnd("p", 5))
    return stats.holm(tested, ["target"], "p", "encoder").select("encoder", "target", "p", F.round("threshold", 9).alias("threshold"), "significant")


@query
def w2_bh(spark, sf):
    tested = stats.wilcoxon(_pairs(spark, sf), ["encoder", "target"], "ea", "eb").withColumn("p", rnd("p", 5))
    return stats.benjamini_hochberg(tested, ["target"], "p", "encoder").select("encoder", "target", "p", r6("q").alias("q"))


@query
def w4_average_rank(spark, sf):
    return metrics.average_rank(people(spark, sf), [], "phq9_total").select("phq9_total", "n", F.col("avg_rank").cast("double").alias("avg_rank"))


@query
def x7_bootstrap(spark, sf):
    got = stats.bootstrap_interval(_pairs(spark, sf).withColumn("d", F.col("ea") - F.col("eb")), ["encoder", "target"], "session", "d")
    return got.select("encoder", "target", r6("low").alias("low"), r6("high").alias("high"))


@query
def x11_spearman(spark, sf):
    df = word_stats(spark, sf).groupBy("participant").agg(F.sum("n_words").alias("words"), rnd(F.avg("mean_word_len"), 6).alias("word_len"))
    both = df.join(people(spark, sf), "participant")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.lit(t).alias("target"), F.col(t).alias("y")) for f in ("words", "word_len") for t in ("phq9_total", "gad7_total")])).alias("s")).select("s.*")
    return stats.spearman(long, ["feature", "target"], "x", "y").select("feature", "target", "n", rnd("rho", 5).alias("rho"))


@query
def x12_pearson_pairs(spark, sf):
    cols = ["rmse", "mae", "r2", "band_f1_macro", "band_qwk", "screening_f1", "screening_auc"]
    df = log(spark, sf, *cols).dropna()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*[stats.correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.abs(F.col(f"{a}|{b}")).alias("r")) for a, b in pairs])).alias("s")).select("s.*")
    return long.where("r >= 0.8").select("feature_a", "feature_b", rnd("r", 5).alias("r"))


#: Contrasts between two sides; a side is a family or, for the named features, an arm over its versions.
CONTRASTS = [("tuned_vs_frozen", "fine-tuning", "frozen"), ("named_vs_frozen", "lexical", "frozen"), ("cv_vs_tuned", "fine-tuning-cv", "fine-tuning"), ("affect_on_lexical", "l1_lexical", "l2_lexical__affect")]
_CELL_KEYS = ["search", "granularity", "target"]


def _contrasted(spark, sf):
    """Squared and absolute errors of both sides of each contrast, a row a participant and (search, granularity, target)."""
    used = sorted({x for c in CONTRASTS for x in c[1:]})
    sides = F.filter(F.array("family", F.substring_index("encoder", "_v", 1)), lambda x: x.isin(used))
    rows = scored(spark, sf).where("target is not null").withColumn("side", F.explode(sides))
    df = metrics.aggregate_predictions(rows, [*_CELL_KEYS, "side"], "session").withColumns({"y_true": F.round("y_true", 9), "y_pred": F.round("y_pred", 9)})
    left = df.join(F.broadcast(spark.createDataFrame(CONTRASTS, "contrast string, a string, b string")), F.col("side") == F.col("a")).select(*_CELL_KEYS, "contrast", "session", "b", F.col("y_true").alias("y"), F.col("y_pred").alias("pa"))
    both = left.join(df.select(*_CELL_KEYS, F.col("side").alias("b"), "session", F.col("y_pred").alias("pb")), [*_CELL_KEYS, "b", "session"])
    ea, eb = F.col("pa") - F.col("y"), F.col("pb") - F.col("y")
    made = {"sa": rnd(ea**2, 6), "sb": rnd(eb**2, 6), "aa": rnd(F.abs(ea), 6), "ab": rnd(F.abs(eb), 6)}
    return both.select(*_CELL_KEYS, "contrast", "session", *[c.alias(n) for n, c in made.items()]).withColumns({"d": F.col("sa") - F.col("sb"), "e": F.col("aa") - F.col("ab")})


@query
def x15_contrast_table(spark, sf):
    """Holm within one search, granularity and target."""
    d = _contrasted(spark, sf)
    tested = stats.wilcoxon(d, [*_CELL_KEYS, "contrast"], "sa", "sb").withColumn("p", rnd("p", 5))
    means = d.groupBy(*_CELL_KEYS, "contrast").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("d")).alias("d_squared"), r6(F.avg("e")).alias("d_absolute"))
    whole = stats.holm(tested, _CELL_KEYS, "p", "contrast").join(means, [*_CELL_KEYS, "contrast"])
    return whole.select("contrast", *_CELL_KEYS, "n", "pairs", "d_squared", "d_absolute", "p", "significant")


@query
def x15_contrast_intervals(spark, sf):
    """Bootstrap intervals of the contrasts (2000 resamples; no SQL, as the draws are numpy's)."""
    got = stats.bootstrap_intervals(_contrasted(spark, sf), [*_CELL_KEYS, "contrast"], "session", ["d", "e"])
    return got.select("contrast", *_CELL_KEYS, r6("d_low").alias("squared_low"), r6("d_high").alias("squared_high"), r6("e_low").alias("absolute_low"), r6("e_high").alias("absolute_high"))


# Splits and guards -------------------------------------------------------------------------------------------


@query
def a19_strata(spark, sf):
    return splits.stratify_key(people(spark, sf), "phq9_total", "gad7_total").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query
def d1_split(spark, sf):
    return splits.rank_split(splits.stratify_key(people(spark, sf), "phq9_total", "gad7_total"), "participant", "stratum").select("participant", "stratum", "split")


@query
def d2_folds(spark, sf):
    return splits.group_folds(splits.stratify_key(people(spark, sf), "phq9_total", "gad7_total"), "participant", "stratum").select("participant", "fold")


@query
def d4_hold_out(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null and author is not null").select("source", "author", "doc_id")
    return splits.hold_out_groups(docs, "source", "author").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("validation").cast("bigint")).alias("held_docs"), F.countDistinct(F.when(F.col("validation"), F.col("author"))).alias("held_authors"))


@query
def a23_fold_audit(spark, sf):
    rows = scored(spark, sf).select("session")
    return splits.fold_audit(splits.group_folds(rows, "session", None), "session", 5)


@query
def j6_leakage_guard(spark, sf):
    marked = splits.rank_split(splits.stratify_key(people(spark, sf), "phq9_total", "gad7_total"), "participant", "stratum")
    protected = marked.where("split = 'test'").select(tx.session_key(F.col("participant")).alias("p"))
    train = scored(spark, sf).where("augmentation = 'augmented'")
    return splits.leaks(train, protected, F.col("session") == F.col("p")).groupBy("session").agg(F.count(F.lit(1)).alias("leaking_rows"))


@query
def j7_disjoint(spark, sf):
    marked = splits.rank_split(splits.stratify_key(people(spark, sf), "phq9_total", "gad7_total"), "participant", "stratum")
    a, b = (marked.where(F.col("split") == s).select("participant") for s in ("train", "test"))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared"))


# Texts -------------------------------------------------------------------------------------------------------


@query
def j1_inner(spark, sf):
    people_ = people(spark, sf)
    return answers(spark, sf).join(people_, "participant").groupBy("participant", "phq9_total", "gad7_total").agg(F.countDistinct("question").alias("questions"))


@query
def j2_left_align(spark, sf):
    n = answers(spark, sf).groupBy(F.col("participant").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "scores").select("participant").distinct().join(n, F.col("participant") == F.col("p"), "left").select("participant", "n")


@query
def s1_answers(spark, sf):
    return answers(spark, sf).groupBy("question").agg(F.count(F.lit(1)).alias("answers"), F.countDistinct("participant").alias("people"))


@query
def s4_first_occurrence(spark, sf):
    df = answers(spark, sf)
    return df.groupBy("text").agg(F.min_by(F.struct("participant", "question", "row_id"), F.struct("participant", "question", "row_id")).alias("f")).select("f.participant", "f.question", "f.row_id", F.md5("text").alias("text_md5"))


def _wide(spark, sf):
    first = answers(spark, sf).groupBy("participant", "question").agg(F.min_by("text", "row_id").alias("text"))
    return first.groupBy("participant").pivot("question", ["Q01", "Q02", "Q03", "Q04"]).agg(F.first("text"))


@query
def v1_expand_questions(spark, sf):
    long = _wide(spark, sf).join(people(spark, sf), "participant").unpivot(["participant", "phq9_total"], ["Q01", "Q02", "Q03", "Q04"], "question", "text")
    return long.where("text is not null and trim(text) <> ''").select(F.concat_ws("__", "participant", "question").alias("instance"), "phq9_total", F.md5("text").alias("text_md5"))


@query
def v5_concat_answers(spark, sf):
    return _wide(spark, sf).select("participant", F.md5(F.concat_ws(" ", "Q01", "Q02", "Q03", "Q04")).alias("text_md5"))


@query
def f1_fold(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query
def f2_numbers(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(tx.numbers(F.col("text"))).alias("numbered"))


@query
def f3_placeholders(spark, sf):
    df = table(spark, sf, "transcription").where("text is not null")
    return df.select("row_id", F.md5(tx.strip_placeholders(F.col("text"))).alias("stripped"), F.regexp_count("text", F.lit(tx.PLACEHOLDER)).cast("bigint").alias("n"))


@query
def f5_ellipsis(spark, sf):
    return table(spark, sf, "transcription").where("text is not null").select("row_id", tx.ellipses(F.col("text")).cast("bigint").alias("n"))


@query
def f6_phrases(spark, sf):
    df = table(spark, sf, "transcription").where("text is not null")
    return df.select("row_id", tx.phrase_count(F.col("text"), lex.MARKER_PHRASES).cast("bigint").alias("markers"), tx.phrase_count(F.col("text"), lex.MODAL_PHRASES).cast("bigint").alias("modals"))


@query
def f7_membership(spark, sf):
    df = table(spark, sf, "transcription").where("text is not null").withColumn("w", tx.words(F.col("text")))
    n = F.size("w")
    lists = {"absolutist": lex.ABSOLUTIST, "negation": lex.NEGATION, "marker": lex.MARKERS, "intensifier": lex.INTENSIFIERS}
    return df.select("row_id", n.cast("bigint").alias("words"), *[r6(tx.rate(tx.count_any(F.col("w"), terms), n)).alias(f"{k}_rate") for k, terms in lists.items()])


@query
def f10_syllables(spark, sf):
    df = table(spark, sf, "given_names").select("given_name")
    words = table(spark, sf, "transcription").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("given_name"))
    return df.union(words).distinct().select(F.col("given_name").alias("word"), tx.syllables(F.col("given_name")).cast("bigint").alias("syllables"))


def word_stats(spark, sf):
    df = answers(spark, sf).withColumn("w", tx.words(F.col("text")))
    n = F.size("w")
    chars = F.aggregate(F.transform("w", F.char_length), F.lit(0), lambda a, x: a + x)
    return df.select("row_id", "participant", "w", n.alias("n_words"), tx.ratio(chars, n).alias("mean_word_len"), tx.ratio(F.when(n > 0, tx.hapax(F.col("w"))).otherwise(0), n).alias("hapax_rate"))


@query
def f22_word_stats(spark, sf):
    return word_stats(spark, sf).select("row_id", F.col("n_words").cast("bigint").alias("n_words"), r6("mean_word_len").alias("mean_word_len"), r6("hapax_rate").alias("hapax_rate"))


@query
def w5_repetition(spark, sf):
    return word_stats(spark, sf).select("row_id", tx.adjacent_repeats(F.col("w")).cast("bigint").alias("repeats"))


@query
def w6_mattr(spark, sf):
    return word_stats(spark, sf).select("row_id", r6(tx.mattr(F.col("w"))).alias("mattr_50"))


@query
def f21_mtld(spark, sf):
    return word_stats(spark, sf).select("row_id", r6(tx.mtld(F.col("w"))).alias("mtld"))


@query
def a11_entity_features(spark, sf):
    df = word_stats(spark, sf).withColumn("n_words", F.col("n_words").cast("double"))
    got = features.per_entity(df, table(spark, sf, "scores").dropna(subset=["participant"]), "participant", ["mean_word_len", "hapax_rate"], ("hapax_rate",), "n_words")
    return got.select("participant", *[r6(c).alias(c) for c in got.columns if c != "participant"])


def _block(spark, sf, name: str):
    got = features.extract(blocks.annotated(answers(spark, sf)), (name,), ["row_id"])
    return got.select("row_id", *[r6(c).alias(c) for c in got.columns if c != "row_id"])


@query
def b1_person(spark, sf):
    return _block(spark, sf, "person")


@query
def b3_clinical(spark, sf):
    return _block(spark, sf, "clinical")


@query
def b4_morphosyntax(spark, sf):
    return _block(spark, sf, "morphosyntax")


@query
def b5_richness(spark, sf):
    return _block(spark, sf, "richness")


@query
def b7_affect(spark, sf):
    tagged = materialise(blocks.annotated(answers(spark, sf)), "tagged")
    got = features.affect(tagged.select("row_id", "tokens"), blocks.norms(tagged), ["row_id"])
    return got.select("row_id", *[r6(c).alias(c) for c in features.feature_names("affect")])


@query
def b9_answer_features(spark, sf):
    """All 72 features of an answer, in the order of the registry."""
    got = blocks.answer_features(answers(spark, sf))
    return got.select("row_id", *[r6(c).alias(c) for c in features.feature_names("lexical-affect")])


@query
def b10_participant_features(spark, sf):
    """The 85 columns of a participant."""
    got = blocks.participant_features(answers(spark, sf), table(spark, sf, "scores").dropna(subset=["participant"]))
    return got.select("participant", *[r6(c).alias(c) for c in got.columns if c != "participant"])


@query
def b2_b6_lists(spark, sf):
    df = features.annotate(answers(spark, sf), "text")
    got = features.extract(df, ("negation", "discourse"), ["row_id"])
    return got.select("row_id", *[r6(c).alias(c) for c in got.columns if c != "row_id"])


@query
def f11_sentences(spark, sf):
    df = answers(spark, sf).select("row_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return df.groupBy("row_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.char_length("s")).cast("bigint").alias("longest"))


@query
def w8_packing(spark, sf):
    df = answers(spark, sf).select("row_id", corpus.pack_units(tx.sentences(F.col("text"), 1, 60), 400).alias("p"))
    return df.select("row_id", F.size("p").cast("bigint").alias("packs"), F.array_max(F.transform("p", F.char_length)).cast("bigint").alias("longest"))


@query
def w10_chunks(spark, sf):
    df = table(spark, sf, "documents").where("text is not null").select("doc_id", F.char_length("text").alias("n"))
    return df.select("doc_id", F.explode(tx.chunk_starts(F.col("n"))).alias("start"))


@query
def a14_corpus(spark, sf):
    df = table(spark, sf, "documents")
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.countDistinct("author").alias("people"), F.sum(F.coalesce(F.size(tx.words(F.col("text"))), F.lit(0))).cast("bigint").alias("words"))


def _tokens(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", "source", tx.words(F.col("text")).alias("w"))


@query
def f25_delete_words(spark, sf):
    df = _tokens(spark, sf).select("doc_id", F.size("w").cast("bigint").alias("before"), corpus.delete_words(F.col("w"), 0.6, "7", F.col("doc_id")).alias("k"))
    return df.select("doc_id", "before", F.size("k").cast("bigint").alias("after"), F.md5(F.array_join("k", " ")).alias("kept_md5"))


@query
def f26_mask(spark, sf):
    df = _tokens(spark, sf).select("doc_id", corpus.mask_plan(F.col("w"), 0.15, "7", F.col("doc_id")).alias("m"))
    n = lambda v: F.size(F.filter("m", lambda x: x == v)).cast("bigint")
    return df.select("doc_id", n(1).alias("masked"), n(2).alias("replaced"), n(3).alias("kept"))


@query
def a15_mask_rates(spark, sf):
    df = _tokens(spark, sf).select("source", F.size("w").alias("n"), corpus.mask_plan(F.col("w"), 0.15, "7", F.col("doc_id")).alias("m"))
    hit = F.size(F.filter("m", lambda x: x > 0))
    return df.groupBy("source").agg(r6(F.try_divide(F.sum(hit).cast("double"), F.sum("n"))).alias("rate"))


@query
def f27_word_probability(spark, sf):
    df = _tokens(spark, sf).select("doc_id", F.size("w").cast("double").alias("n"), tx.count_any(F.col("w"), lex.NEGATION).cast("double").alias("k"))
    return df.select("doc_id", r6(corpus.word_probability(0.15, 0.5, F.col("n"), F.col("k"))).alias("p_other"))


@query
def j10_overlap(spark, sf):
    df = table(spark, sf, "transcription").where("text is not null")
    a = df.select("row_id", F.explode(corpus.spans(F.col("text"), tx.PLACEHOLDER)).alias("x")).select("row_id", "x.s", "x.e")
    b = df.select("row_id", F.explode(corpus.spans(F.col("text"), r"[^ ]+")).alias("x")).select("row_id", "x.s", "x.e")
    return corpus.overlaps(a, b, "row_id").groupBy("row_id").agg(F.count(F.lit(1)).alias("pairs"))


@query
def j8_lexicon_lookup(spark, sf):
    pairs = {tx.fold_word(t): n for n, terms in lex.SUBSCALES.items() for t in terms}
    lexicon = spark.createDataFrame(sorted(pairs.items()), "term string, subscale string")
    words = table(spark, sf, "transcription").select(F.explode(tx.words(F.col("text"))).alias("w"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(lexicon), F.col("w") == F.col("term")).groupBy("subscale").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("terms"))


@query
def t2_tfidf(spark, sf):
    counts = tfidf.term_counts(table(spark, sf, "documents"), "doc_id", "text")
    n = table(spark, sf, "documents").where("text is not null").agg(F.count(F.lit(1)).alias("n_docs"))
    got = tfidf.tfidf(counts, tfidf.vocabulary(counts, n, []), "doc_id")
    return got.select("doc_id", "term", r6("weight").alias("weight"))


@query
def t3_fold_vocabulary(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").withColumn("fold", (tx.draw(F.col("doc_id"), F.lit("42")) % 3).cast("int"))
    counts = tfidf.term_counts(docs, "doc_id", "text", 1, ["fold"])
    n = docs.groupBy("fold").agg(F.count(F.lit(1)).alias("n_docs"))
    return tfidf.vocabulary(counts, n, ["fold"], cap=200).select("fold", "term", "df", r6("idf").alias("idf"))


# Vectors -----------------------------------------------------------------------------------------------------


@query
def f17_unit(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r6(norm(F.col("embedding"))).alias("length"), r6(F.get(unit(F.col("embedding")), F.lit(0))).alias("first"))


@query
def t6_mean_pool(spark, sf):
    got = vectors.mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding")
    return got.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", rnd("x", 5).alias("x"))


@query
def w7_knn(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.neighbours(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


@query
def j11_similar(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.similar(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 0.2)


@query
def t8_cosine_spread(spark, sf):
    return vectors.cosine_moments(table(spark, sf, "embeddings"), "embedding").select("n", rnd("mean", 5).alias("mean"), rnd("sd", 5).alias("sd"))


@query
def t9_silhouette(spark, sf):
    return vectors.silhouette(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").select("n", rnd("silhouette", 5).alias("silhouette"))


def _query_pairs(spark, sf):
    """Each vector of the stated query set with each other vector, and their labels."""
    e = table(spark, sf, "embeddings")
    near = vectors.similar(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", -2.0)
    labels = e.select(F.col("vec_id").alias("i"), "label")
    both = near.join(labels.select(F.col("i").alias("vec_id"), F.col("label").alias("lq")), "vec_id").join(labels.select(F.col("i").alias("neighbour"), F.col("label").alias("lb")), "neighbour")
    return both.select("vec_id", "neighbour", "similarity", "lq", "lb")


@query
def t8_cosine_percentiles(spark, sf):
    """5th and 95th percentile of the cosine over the pairs with the stated query set on one side."""
    e = table(spark, sf, "embeddings")
    near = vectors.similar(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", -2.0)
    return near.agg(F.count(F.lit(1)).alias("pairs"), *[rnd(F.percentile("similarity", F.lit(p)), 5).alias(n) for n, p in (("p05", 0.05), ("p95", 0.95))])


@query
def t10_rank_correlation(spark, sf):
    pairs = _query_pairs(spark, sf).select(F.round(1 - F.col("similarity"), 6).alias("d"), F.abs(F.col("lb") - F.col("lq")).cast("double").alias("gap"))
    return stats.spearman(pairs, [], "d", "gap").select("n", rnd("rho", 4).alias("rho"))


@query
def t5_scaling(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    s = e.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
    return e.join(F.broadcast(s), "i").select("vec_id", "i", rnd(F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0)), 4).alias("z"))


@query
def m1_knn_regression(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("y", F.col("label").cast("double"))
    got = models.knn(e.where("vec_id % 100 <> 0"), e.where("vec_id % 100 = 0"), "vec_id", "embedding", "y", 7)
    return got.select("vec_id", r6("y_pred").alias("y_pred"))


@query
def f18_cosine_to_mean(spark, sf):
    e = table(spark, sf, "embeddings")
    mean = vectors.mean_pool(e, ["label"], "embedding").select(F.col("label").alias("l"), F.col("embedding").alias("m"))
    return e.join(mean, F.col("label") == F.col("l")).select("vec_id", rnd(cosine(F.col("embedding"), F.col("m")), 5).alias("cosine"))


@query
def f4_normalise(spark, sf):
    return table(spark, sf, "transcription").where("text is not null").select("row_id", F.md5(tx.normalise(F.col("text"))).alias("normalised"))


@query
def proj3_not_blank(spark, sf):
    df = table(spark, sf, "transcription")
    flat = F.trim(F.regexp_replace("text", r"[\s\u00A0]+", " "))
    kind = F.when(F.col("text").isNull(), "null").when(flat == "", "blank").when(F.upper(flat) == "OMITIDA", "omitted").otherwise("answer")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def x13_sparse_features(spark, sf):
    wide = f7_membership(spark, sf)
    rates = [c for c in wide.columns if c.endswith("_rate")]
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in rates])).alias("s")).select("s.*")
    share = long.groupBy("feature").agg(rnd(100 * F.avg((F.col("v") != 0).cast("double")), 4).alias("pct_nonzero"))
    return share.select("feature", "pct_nonzero", (F.col("pct_nonzero") < 20).alias("sparse"))


@query
def d3_group_split(spark, sf):
    rows = scored(spark, sf).select("session")
    return splits.group_split(rows, "session").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("session").alias("people"))


@query
def d6_named_corpora(spark, sf):
    a = answers(spark, sf).select(F.lit("interviews").alias("corpus"), F.col("participant").alias("person"), "text")
    b = table(spark, sf, "documents").where("text is not null and author is not null").select(F.lit("documents").alias("corpus"), F.col("author").alias("person"), "text")
    both = runs_union([a, b])
    return both.groupBy("corpus").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("person").alias("people"), F.sum(F.char_length("text")).alias("chars"))


def runs_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query
def o1_mixed_sort(spark, sf):
    df = log(spark, sf, "family", "target", "rmse").where("rmse is not null")
    return df.groupBy("family", "target").agg(F.count(F.lit(1)).alias("n"), r6(F.min("rmse")).alias("best")).orderBy(F.col("n").desc(), "family", F.col("target").desc_nulls_last())


@query
def o8_global_first(spark, sf):
    df = table(spark, sf, "documents").where("text is not null")
    first = df.groupBy(tx.fold(F.trim(F.regexp_replace("text", r"[\s\u00A0]+", " "))).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return first.where("copies > 1").select("doc_id", "copies")


@query
def x8_paired_comparison(spark, sf):
    """Both sides of the paired comparison, squared and absolute errors: mean difference and Wilcoxon p."""
    keys = ["encoder", "target"]
    pairs = _pairs(spark, sf).withColumns({"qa": F.round(F.col("ea") ** 2, 9), "qb": F.round(F.col("eb") ** 2, 9)})
    squared = stats.wilcoxon(pairs, keys, "qa", "qb").select(*keys, "pairs", rnd("p", 5).alias("p"))
    absolute = stats.wilcoxon(pairs, keys, "ea", "eb").select(*keys, rnd("p", 5).alias("p_absolute"))
    means = pairs.groupBy(*keys).agg(r6(F.avg(F.col("ea") ** 2 - F.col("eb") ** 2)).alias("d_squared"), r6(F.avg(F.col("ea") - F.col("eb"))).alias("d_absolute"))
    return means.join(squared, keys).join(absolute, keys).select(*keys, "pairs", "d_squared", "p", "d_absolute", "p_absolute")


@query
def a6_equal_seeds(spark, sf):
    sets = scored(spark, sf).where("encoder is not null").groupBy("encoder", "target").agg(F.sort_array(F.collect_set("seed")).alias("seeds"))
    return sets.groupBy("encoder").agg((F.countDistinct("seeds") == 1).alias("same_seeds"))


@query
def x8_intervals(spark, sf):
    """Bootstrap intervals of both sides (2000 resamples; no SQL, as the draws are numpy's)."""
    keys = ["encoder", "target"]
    pairs = _pairs(spark, sf).withColumns({"squared": F.col("ea") ** 2 - F.col("eb") ** 2, "absolute": F.col("ea") - F.col("eb")})
    got = stats.bootstrap_intervals(pairs, keys, "session", ["squared", "absolute"])
    return got.select(*keys, *[r6(f"{s}_{side}").alias(f"{s}_{side}") for s in ("squared", "absolute") for side in ("low", "high")])


from tallyframe.plans import further as _further  # noqa: E402, F401
