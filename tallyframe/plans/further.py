"""Queries of the operators that combine several others; registered with those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schemas
from tallyframe.functions import lexicons as lex
from tallyframe.functions import text as tx
from tallyframe.functions import tokenizer
from tallyframe.functions.vectors import norm, unit
from tallyframe.operators import arms, corpus, features, linear, metrics, models, splits, stats, tfidf, vectors
from tallyframe.plans import blocks
from tallyframe.plans.queries import BASE_ARM, QUERIES, answers, log, people, query, r6, rnd, scored, word_stats
from tallyframe.session import materialise, scratch_path, table
from tallyframe.sources import readers, sinks, workbook

LISTS = {"absolutist": lex.ABSOLUTIST, "negation": lex.NEGATION, "marker": lex.MARKERS, "intensifier": lex.INTENSIFIERS}
PERSON_FEATURES = ["words", "word_len", *(f"{k}_rate" for k in LISTS)]
TARGETS = ["phq9_total", "gad7_total"]


# Projections, registries, joins ------------------------------------------------------------------------------


@query
def proj6_drop(spark, sf):
    kept = table(spark, sf, "experiment_log").drop("notes", "no_such_column")
    return kept.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.lit(len(kept.columns)).cast("bigint").alias("columns"))


ORDER = ["lexical", "frozen", "fine-tuning", "fine-tuning-cv", "not-run", "fine-tuning-multitask"]


@query
def proj9_reindex(spark, sf):
    """Rows in a declared order; a label without rows keeps its place with NULL."""
    mean = log(spark, sf, "family", "rmse").where("rmse is not null").groupBy("family").agg(r6(F.avg("rmse")).alias("rmse"))
    wanted = spark.createDataFrame([(k, f) for k, f in enumerate(ORDER)], "pos int, family string")
    return wanted.join(mean, "family", "left").select("pos", "family", "rmse").orderBy("pos")


@query
def proj11_head_tail(spark, sf):
    """The eight lowest and the eight highest arms of a target; all of them, once, where there are no more than sixteen."""
    mean = log(spark, sf, "encoder", "target", "rmse").where("encoder is not null and target is not null and rmse is not null").groupBy("encoder", "target").agg(r6(F.avg("rmse")).alias("rmse"))
    low = F.row_number().over(Window.partitionBy("target").orderBy("rmse", "encoder"))
    high = F.row_number().over(Window.partitionBy("target").orderBy(F.col("rmse").desc(), F.col("encoder").desc()))
    ranked = mean.withColumns({"low": low, "high": high})
    head = ranked.where("low <= 8").select("target", "encoder", "rmse", F.lit("head").alias("part"))
    return head.union(ranked.where("low > 8 and high <= 8").select("target", "encoder", "rmse", F.lit("tail").alias("part")))


@query
def proj13_arms(spark, sf):
    """Runs of the arms the registry has for each family and granularity, 0 where an arm was never run."""
    known = [(f, g, a) for f in ("frozen", "lexical") for g in ("participant", "question") for a in arms.applicable(f, g)]
    ran = log(spark, sf, "encoder", "family", "granularity").where("encoder is not null").groupBy("family", "granularity", F.substring_index("encoder", "_v", 1).alias("arm")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(spark.createDataFrame(known, "family string, granularity string, arm string")).join(ran, ["family", "granularity", "arm"], "left").select("family", "granularity", "arm", F.coalesce("n", F.lit(0)).alias("runs"))


@query
def t7_matrices(spark, sf):
    """What the matrix of each arm in the log is made of, by the registry."""
    df = log(spark, sf, "encoder", "family").where("encoder is not null")
    return df.groupBy(F.coalesce(arms.matrix_of(F.col("encoder")), F.lit("none")).alias("matrix"), "family").agg(F.count(F.lit(1)).alias("n"))


@query
def j9_baseline_lookup(spark, sf):
    """The baseline's score looked up by search, granularity and target for the best arm of each, and the gain over it."""
    keys = ["search", "granularity", "target"]
    df = log(spark, sf, "encoder", *keys, "rmse").where("encoder is not null and rmse is not null").dropna(subset=keys)
    mean = df.groupBy("encoder", *keys).agg(F.round(F.avg("rmse"), 9).alias("rmse"))
    base = mean.where(F.col("encoder") == BASE_ARM).select(*keys, F.col("rmse").alias("baseline"))
    best = mean.where(F.col("encoder") != BASE_ARM).groupBy(*keys).agg(F.min(F.struct("rmse", "encoder")).alias("b")).select(*keys, F.col("b.encoder").alias("encoder"), F.col("b.rmse").alias("rmse"))
    return best.join(base, keys, "left").select(*keys, "encoder", r6("rmse").alias("rmse"), r6("baseline").alias("baseline"), r6(F.col("baseline") - F.col("rmse")).alias("gain"))


@query
def j12_configurations(spark, sf):
    """Every combination of target, granularity and search with the runs there are, 0 where there are none."""
    made = spark.createDataFrame([(t,) for t in TARGETS], "target string").crossJoin(F.broadcast(spark.createDataFrame([(g,) for g in ("participant", "question")], "granularity string"))).crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in ("defaults", "random15", "grid")], "search string")))
    ran = log(spark, sf, "target", "granularity", "search").groupBy("target", "granularity", "search").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(made).join(ran, ["target", "granularity", "search"], "left").select("target", "granularity", "search", F.coalesce("n", F.lit(0)).alias("runs"))


@query
def a13_error_by_question(spark, sf):
    """RMSE of each question's rows, not clipped; the question stands in the stored participant."""
    df = scored(spark, sf).where("target is not null").withColumn("question", F.regexp_extract("participant", r"__(Q[0-9]+)", 1)).where("question <> ''")
    return metrics.regression(df, ["question", "target"], "y_true", "y_pred").select("question", "target", "n", r6("rmse").alias("rmse"))


# Logs through the writers and readers ------------------------------------------------------------------------


@query
def s9_routed_log(spark, sf):
    """The log appended in two parts, each row to the folder its own columns name, and read back."""
    df = log(spark, sf, "family", "augmentation", "granularity", "rmse").dropna(subset=sinks.PLACE)
    root = scratch_path(spark, "log")
    for part in (F.col("run_id") % 2 == 0, F.col("run_id") % 2 == 1):
        sinks.append_rows(df.where(part), root)
    back = readers.read_run_logs(spark, root)
    return back.groupBy(*sinks.PLACE).agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first"), r6(F.avg("rmse")).alias("rmse"))


@query
def s10_snapshots(spark, sf):
    """A snapshot of all families, then one of a single family that replaces its own alone."""
    df = log(spark, sf, "family", "search", "rmse").where("family is not null")
    root = scratch_path(spark, "snapshot")
    sinks.overwrite_snapshot(df, root, ["family"])
    sinks.overwrite_snapshot(df.where("family = 'lexical' and search = 'defaults'"), root, ["family"])
    return readers.read_run_logs(spark, root).groupBy("family", "search").agg(F.count(F.lit(1)).alias("n"))


@query
def s12_placed_logs(spark, sf):
    """Logs of which some leave their place blank: it is filled from the path."""
    df = log(spark, sf, "family", "augmentation", "granularity", "rmse").dropna(subset=sinks.PLACE)
    root = scratch_path(spark, "placed")
    for family in ("frozen", "lexical"):
        for granularity in ("participant", "question"):
            part = df.where((F.col("family") == family) & (F.col("augmentation") == "augmented") & (F.col("granularity") == granularity))
            blank = part.withColumn("family", F.when(F.col("run_id") % 3 > 0, F.col("family"))).drop("granularity")
            blank.write.parquet(f"{root}/{family}/augmented/{granularity}")
    return readers.read_placed_logs(spark, root).groupBy(*sinks.PLACE).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rmse")).alias("rmse"))


@query
def s16_migration(spark, sf):
    """Rows each destination gets and, after the rewrite has been verified, really has."""
    df = log(spark, sf, "family", "granularity", "rmse").dropna(subset=["family", "granularity"])
    root = scratch_path(spark, "moved")
    plan = sinks.migrate(df, root, ["family", "granularity"], dry_run=False)
    moved = readers.read_run_logs(spark, root).groupBy("family", "granularity").agg(F.count(F.lit(1)).alias("moved"))
    return plan.join(moved, ["family", "granularity"]).select("family", "granularity", F.col("rows").alias("planned"), "moved")


@query
def s2_score_workbook(spark, sf):
    """Scores written as a workbook and read from its first sheet."""
    path = scratch_path(spark, "scores") + ".xlsx"
    workbook.write_workbook(spark, {"scores": table(spark, sf, "scores").select("participant", *TARGETS)}, path)
    return workbook.read_workbooks(spark, path, schemas.SCORES).select("participant", *TARGETS)


@query
def s3_csv(spark, sf):
    """Scores written as CSV and read under an explicit schema."""
    root = scratch_path(spark, "csv")
    sinks.export_sheets({"scores": table(spark, sf, "scores").select("participant", *TARGETS)}, root)
    return readers.read_csv(spark, f"{root}/scores", schemas.SCORES)


def results_sheets(spark, sf) -> dict[str, DataFrame]:
    """The sheets of the results workbook: summary, best runs, mean baseline, clinical metrics, contrasts."""
    return {"summary": QUERIES["a2_summary"](spark, sf), "best": QUERIES["a4_best_arm"](spark, sf), "baseline": QUERIES["a18_mean_baseline"](spark, sf), "clinical": QUERIES["a22_metric_means"](spark, sf), "contrasts": QUERIES["x16_contrasts"](spark, sf)}


@query
def s14_summary_sheet(spark, sf):
    """The summary as it comes back from the first sheet of the results workbook."""
    path = scratch_path(spark, "results") + ".xlsx"
    workbook.write_workbook(spark, {"summary": QUERIES["a2_summary"](spark, sf)}, path)
    keys = ["family", "granularity", "encoder", "search", "target"]
    schema = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], *[T.StructField(k, T.DoubleType()) for k in ("mean", "sd", "n")]])
    return workbook.read_workbooks(spark, path, schema).select(*keys, "mean", "sd", F.col("n").cast("bigint").alias("n"))


@query
def s15_results_workbook(spark, sf):
    """Rows of each of the five sheets of the results workbook, counted in the written file."""
    path, sheets = scratch_path(spark, "results") + ".xlsx", results_sheets(spark, sf)
    workbook.write_workbook(spark, sheets, path)
    out = None
    for k, name in enumerate(sheets):
        rows = workbook.read_workbooks(spark, path, T.StructType([T.StructField(sheets[name].columns[0], T.StringType())]), sheet=k).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("sheet"), "rows")
        out = rows if out is None else out.union(rows)
    return out


@query
def f19_round_trip(spark, sf):
    """Nested fields written as JSON and read again."""
    df = log(spark, sf, "seed", "rmse", "mae")
    text = F.to_json(F.struct("seed", F.struct(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae")).alias("metrics")))
    back = F.from_json(text, "seed int, metrics struct<rmse: double, mae: double>")
    return df.select("run_id", back["seed"].alias("seed"), back["metrics"]["rmse"].alias("rmse"), back["metrics"]["mae"].alias("mae"))


# Texts -------------------------------------------------------------------------------------------------------


@query
def f8_subscales(spark, sf):
    """Symptom group of each word by lemma, first word of a lemma of several words, then form, with the guard on parts of speech; lemmas and tags are drawn."""
    words = answers(spark, sf).select(F.explode(tx.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    d = tx.draw(F.lit("lemma"), F.col("w"))
    lemma = F.when(d % 4 == 0, F.col("w")).when(d % 4 == 1, F.concat("w", F.lit(" yo"))).when(d % 4 == 2, F.lit("triste"))
    tagged = words.select("w", "n", lemma.alias("lemma"), blocks._pick(tx.draw(F.lit("tag"), F.col("w")), 1, blocks.POS).alias("pos"))
    group = features.subscale_of(F.col("w"), F.col("lemma"), F.col("pos"))
    return tagged.withColumn("subscale", group).where("subscale is not null").groupBy("subscale").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("words"))


@query
def f9_clinical_words(spark, sf):
    df = answers(spark, sf).select("row_id", tx.words(F.col("text")).alias("w"))
    return df.select("row_id", F.size(F.filter("w", lambda w: features.is_clinical(w))).cast("bigint").alias("n"))


@query
def f12_split_to_fit(spark, sf):
    df = answers(spark, sf).select("row_id", corpus.split_to_fit(F.col("text"), 40).alias("p"))
    size = lambda p: F.size(F.split(p, " "))
    return df.select("row_id", F.size("p").cast("bigint").alias("pieces"), F.coalesce(F.array_max(F.transform("p", size)), F.lit(0)).cast("bigint").alias("longest"), F.aggregate(F.transform("p", size), F.lit(0), lambda a, x: a + x).cast("bigint").alias("words"))


@query
def f23_readability(spark, sf):
    df = answers(spark, sf).select("row_id", tx.words(F.col("text")).alias("w"), F.size(F.filter(F.split("text", r"(?<=[.!?…])\s+"), lambda s: F.trim(s) != "")).alias("s"))
    syllables = F.aggregate(F.transform("w", tx.syllables), F.lit(0), lambda a, x: a + x)
    return df.select("row_id", r6(tx.readability(syllables, F.size("w"), F.greatest(F.col("s"), F.lit(1)))).alias("readability"))


@query
def f24_neutral_stats(spark, sf):
    """Statistics of the negative R² of an encoder; an encoder without any gets the neutral value."""
    df = log(spark, sf, "encoder", "r2").where("encoder is not null").withColumn("bad", F.when(F.col("r2") < 0, F.col("r2")))
    got = stats.neutral_stats(df, ["encoder"], "bad", 5.0)
    return got.select("encoder", *[r6(c).alias(c) for c in ("mean", "sd", "min", "max", "p05")])


@query
def f17_elements(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", norm(F.col("embedding")).alias("n"), F.posexplode(unit(F.col("embedding"))).alias("i", "x"))
    return e.select("vec_id", "i", rnd("x", 5).alias("x"))


@query
def f28_destandardise(spark, sf):
    df = people(spark, sf)
    s = df.agg(F.avg("phq9_total").alias("m"), F.coalesce(F.nullif(F.stddev_pop("phq9_total"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    z = df.crossJoin(F.broadcast(s)).withColumn("z", (F.col("phq9_total") - F.col("m")) / F.col("s"))
    return z.select("participant", r6(F.col("z") * F.col("s") + F.col("m")).alias("phq9_total"))


@query
def f26_weighted_mask(spark, sf):
    """Masking with more weight on listed words; a text where no word is drawn gets one."""
    listed = tuple(sorted({tx.fold_word(t) for t in lex.NEGATION}))
    df = table(spark, sf, "documents").where("text is not null").select("doc_id", tx.words(F.col("text")).alias("w"))
    plan = df.select("doc_id", "w", corpus.weighted_mask_plan(F.col("w"), listed, 0.15, 0.5, "7", F.col("doc_id")).alias("m"))
    n = lambda v: F.size(F.filter("m", lambda x: x == v)).cast("bigint")
    return plan.select("doc_id", F.size("w").cast("bigint").alias("words"), n(1).alias("masked"), n(2).alias("replaced"), n(3).alias("kept"))


@query
def h10_word_spans(spark, sf):
    """Words of the answers with their places, those of placeholders left out."""
    df = table(spark, sf, "transcription").where("text is not null").select("row_id", F.explode(corpus.word_spans(F.col("text"))).alias("x")).select("row_id", "x.*")
    return df.groupBy("row_id").agg(F.count(F.lit(1)).alias("words"), F.sum(F.col("s").cast("bigint")).alias("starts"), F.sum((F.col("e") - F.col("s")).cast("bigint")).alias("letters"), F.sum(F.when(features.is_clinical(F.col("form")), 1).otherwise(0)).alias("lexicon"))


#: A public vocabulary; any other rank file does as well.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@query
def x14_fertility(spark, sf):
    """Pieces of a public tokenizer for each word, counted in context: all words and those of the lexicon (no SQL: a tokenizer)."""
    words = corpus.fertility(table(spark, sf, "documents"), "doc_id", "text", tokenizer.offsets(TOKENIZER), ["source"])
    p = F.col("pieces").cast("double")
    split = (F.col("pieces") > 1).cast("double")
    return words.groupBy("source").agg(F.count(F.lit(1)).alias("words"), r6(F.avg(p)).alias("fertility"), r6(100 * F.avg(split)).alias("pct_split"), r6(F.avg(F.when(F.col("lexicon"), p))).alias("lexicon_fertility"), r6(100 * F.avg(F.when(F.col("lexicon"), split))).alias("lexicon_pct_split"))


@query
def t1_stop_words(spark, sf):
    """Stop words, with their forms without accents, and how often each occurs."""
    known = spark.createDataFrame([(w,) for w in tfidf.stop_words()], "word string")
    found = table(spark, sf, "documents").select(F.explode(tx.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(known).join(found, F.col("word") == F.col("w"), "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


@query
def t2_trigrams(spark, sf):
    """Vocabulary with one to three words a term."""
    docs = table(spark, sf, "documents").where("text is not null")
    counts = tfidf.term_counts(docs, "doc_id", "text", 3)
    got = tfidf.vocabulary(counts, docs.agg(F.count(F.lit(1)).alias("n_docs")), [], cap=1000)
    return got.select("term", "df", "total", r6("idf").alias("idf"))


@query
def t4_side_by_side(spark, sf):
    """TF-IDF terms of a document beside two standardised counts."""
    docs = table(spark, sf, "documents").where("text is not null")
    counts = tfidf.term_counts(docs, "doc_id", "text", 1)
    weights = tfidf.tfidf(counts, tfidf.vocabulary(counts, docs.agg(F.count(F.lit(1)).alias("n_docs")), [], cap=100), "doc_id")
    named = docs.select("doc_id", F.char_length("text").alias("chars"), F.size(tx.words(F.col("text"))).alias("words"))
    return tfidf.side_by_side(weights, named, "doc_id", ["chars", "words"]).select("doc_id", "feature", rnd("value", 5).alias("value"))


@query
def t6_pooled_levels(spark, sf):
    """Chunks to questions to persons: mean of means, brought back to length 1 at the last level."""
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 7).alias("question"), F.col("label").alias("person"), "embedding")
    got = vectors.pool_levels(e, [["person", "question"], ["person"]], "embedding", (False, True))
    return got.select("person", F.posexplode("embedding").alias("i", "x")).select("person", "i", rnd("x", 5).alias("x"))


# Statistics --------------------------------------------------------------------------------------------------


def person_features(spark, sf) -> DataFrame:
    """Counts and rates of a participant's answers beside both scores."""
    w = word_stats(spark, sf)
    rates = {f"{k}_rate": tx.rate(tx.count_any(F.col("w"), terms), F.size("w")) for k, terms in LISTS.items()}
    made = w.select("participant", "n_words", "mean_word_len", *[c.alias(k) for k, c in rates.items()])
    per = made.groupBy("participant").agg(F.sum("n_words").cast("double").alias("words"), F.round(F.avg("mean_word_len"), 9).alias("word_len"), *[F.round(F.avg(k), 9).alias(k) for k in rates])
    return per.join(people(spark, sf), "participant")


@query
def a10_feature_summary(spark, sf):
    got = stats.feature_summary(person_features(spark, sf), PERSON_FEATURES, TARGETS)
    return got.select("feature", *[rnd(c, 4).alias(c) for c in ("mean", "sd", "min", "max", "pct_nonzero", *(f"{k}_{t}" for t in TARGETS for k in ("rho", "p", "q")), "abs_rho_max")])


@query
def x13_survivors(spark, sf):
    """Features whose correlation with a score survives Benjamini-Hochberg at 0.05."""
    got = stats.feature_summary(person_features(spark, sf), PERSON_FEATURES, TARGETS)
    return got.select("feature", *[(F.col(f"q_{t}") <= 0.05).alias(f"survives_{t}") for t in TARGETS], (F.col("pct_nonzero") < 20).alias("sparse"))


@query
def x11_rank_p(spark, sf):
    """Rank correlation of each feature with each score, with its p; 0 and 1 where a side is constant."""
    df = person_features(spark, sf).withColumn("constant", F.lit(1.0))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.lit(t).alias("target"), F.col(t).alias("y")) for f in [*PERSON_FEATURES, "constant"] for t in TARGETS])).alias("s")).select("s.*")
    got = stats.spearman(long, ["feature", "target"], "x", "y").withColumn("r", F.round("rho", 9)).withColumn("p", stats.spearman_p(F.col("r"), F.col("n")))
    return got.select("feature", "target", "n", rnd("r", 4).alias("rho"), rnd("p", 4).alias("p"))


SCORES = ["rmse", "mae", "r2", "band_f1_macro", "band_qwk", "screening_f1", "screening_auc"]


@query
def x12_rank_collinear(spark, sf):
    got = stats.collinear(log(spark, sf, *SCORES).dropna(), SCORES, 0.1)
    return got.select("feature_a", "feature_b", rnd("abs_spearman", 4).alias("abs_spearman"))


@query
def w9_exact_wilcoxon(spark, sf):
    """The signed-rank test of the two augmentations of an encoder, with the exact p where there are few pairs."""
    mean = metrics.aggregate_predictions(scored(spark, sf).where("encoder is not null and target is not null and augmentation is not null"), ["encoder", "target", "augmentation"], "session").withColumns({"y_pred": F.round("y_pred", 6)})
    wide = mean.groupBy("encoder", "target", "session").pivot("augmentation", ["augmented", "no_augmentation"]).agg(F.first("y_pred")).dropna()
    return stats.wilcoxon_exact(stats.wilcoxon(wide, ["encoder", "target"], "augmented", "no_augmentation")).select("encoder", "target", "pairs", rnd("w", 3).alias("w"), rnd("p", 5).alias("p"))


# Models ------------------------------------------------------------------------------------------------------


@query
def m6_coefficients(spark, sf):
    """Ridge coefficients of the standardised features, lowest first (no SQL: an eigenvalue problem)."""
    got = linear.ridge_cv(person_features(spark, sf), PERSON_FEATURES, "phq9_total").table(spark)
    return got.select("feature", r6("coefficient").alias("coefficient"), "place")


@query
def m7_run_loop(spark, sf):
    """Both targets through the run loop: folds, refit, predictions of the test participants, mean, clip, metrics."""
    df = splits.group_folds(splits.rank_split(splits.stratify_key(person_features(spark, sf), *TARGETS), "participant", "stratum"), "participant", "stratum").withColumn("train", F.col("split") == "train")
    got = models.run_arm(materialise(df, "people"), "participant", PERSON_FEATURES, TARGETS, "train", "fold", "l0_counts")
    return got.select("arm", "target", "model", "n", *[r6(c).alias(c) for c in ("cv_rmse", "rmse", "mae", "r2")], "chosen")


@query
def m3_search(spark, sf):
    """Cross-validated score of a decision tree with default parameters beside the mean baseline (no SQL: Spark's trees)."""
    from pyspark.ml.feature import VectorAssembler

    df = splits.group_folds(splits.stratify_key(person_features(spark, sf), *TARGETS), "participant", "stratum")
    got = models.search(VectorAssembler(inputCols=PERSON_FEATURES, outputCol="x").transform(materialise(df, "people")), ["decision_tree"], "x", "phq9_total", "fold")
    return got.select("model", "params", r6("cv_rmse").alias("cv_rmse"))


@query
def m1_mean_baseline_folds(spark, sf):
    """Cross-validated RMSE of the mean of the other folds, by target."""
    df = splits.group_folds(splits.stratify_key(people(spark, sf), *TARGETS), "participant", "stratum")
    found = [models.search(df, [], "", t, "fold").select(F.lit(t).alias("target"), "model", r6("cv_rmse").alias("cv_rmse")) for t in TARGETS]
    return found[0].union(found[1])


@query
def d5_train_frame(spark, sf):
    """Augmented rows of the participants outside the test set; the guard raises if one of them were inside."""
    marked = splits.rank_split(splits.stratify_key(people(spark, sf), *TARGETS), "participant", "stratum")
    held = marked.where("split = 'test'").select(tx.session_key(F.col("participant")).alias("p"))
    rows = scored(spark, sf).where("augmentation = 'augmented'").join(held, F.col("session") == F.col("p"), "left_anti")
    got = splits.train_frame(scored(spark, sf), rows, held, F.col("session") == F.col("p"))
    return got.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("session").alias("people"))


@query
def d6_corpora(spark, sf):
    """Two of the named corpora; an unknown or an empty one would raise."""
    known = {
        "interviews": lambda: answers(spark, sf).select(F.col("participant").alias("person"), "text"),
        "documents": lambda: table(spark, sf, "documents").where("text is not null and author is not null").select(F.col("author").alias("person"), "text"),
        "names": lambda: table(spark, sf, "given_names").select(F.col("given_name").alias("person"), F.col("lang").alias("text")),
    }
    return corpus.build_corpora(known, ["documents", "interviews"]).groupBy("corpus").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("person").alias("people"))


@query
def a4_first_per_column(spark, sf):
    """Best run of an experiment, but each column's first value that is there, as a group's ``first`` skips missing values column by column."""
    df = log(spark, sf, "family", "granularity", "target", "rmse", "r2", "screening_auc").where("rmse is not null")
    order = F.struct("rmse", "run_id")
    first = {c: F.min_by(c, F.when(F.col(c).isNotNull(), order)) for c in ("rmse", "r2", "screening_auc")}
    return df.groupBy("family", "granularity", "target").agg(*[r6(c).alias(k) for k, c in first.items()])


@query
def w4_rank_of_runs(spark, sf):
    """Average ranks of the scores of a target's encoders."""
    mean = log(spark, sf, "encoder", "target", "rmse").where("encoder is not null and target is not null and rmse is not null").groupBy("encoder", "target").agg(rnd(F.avg("rmse"), 2).alias("rmse"))
    got = metrics.average_rank(mean, ["target"], "rmse")
    return got.select("target", "rmse", "n", F.col("avg_rank").cast("double").alias("avg_rank"))
