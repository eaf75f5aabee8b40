"""Regressors that need no model server: mean baseline, nearest neighbours, ridge, and Spark's trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.vectors import neighbours

UNSUPPORTED = ("svr_rbf", "extra_trees", "adaboost", "lightgbm")


def dummy(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Predict the mean of the training rows."""
    return test.crossJoin(F.broadcast(train.agg(F.avg(y).alias("y_pred"))))


def knn(train: DataFrame, test: DataFrame, ident: str, vector: str, y: str, k: int = 7) -> DataFrame:
    """Mean target of the k most similar training rows."""
    near = neighbours(test, train, ident, vector, k)
    return near.join(train.select(F.col(ident).alias("neighbour"), y), "neighbour").groupBy(ident).agg(F.avg(y).alias("y_pred"))


def regressor(name: str, features: str, label: str, **params):
    """An unfitted Spark ML estimator by name; names Spark has no counterpart for are refused, not replaced."""
    from pyspark.ml import regression as r

    if name in UNSUPPORTED:
        raise ValueError(f"{name} has no counterpart in Spark")
    made = {"ridge": lambda: r.LinearRegression(regParam=1.0, elasticNetParam=0.0), "random_forest": lambda: r.RandomForestRegressor(numTrees=300, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=42), "gradient_boosting": lambda: r.GBTRegressor(maxIter=300, stepSize=0.05, maxDepth=4, subsamplingRate=0.8, seed=42), "decision_tree": lambda: r.DecisionTreeRegressor(maxDepth=5, minInstancesPerNode=3, seed=42)}
    if name not in made:
        raise KeyError(name)
    return made[name]().setParams(featuresCol=features, labelCol=label, **params)


def candidates(names: list[str], baseline: str = "dummy") -> list[str]:
    """The named candidates in order, the baseline always among them; an unknown name raises."""
    known = {"dummy", "knn", "ridge", "random_forest", "gradient_boosting", "decision_tree"}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise KeyError(f"unknown regressors {unknown}")
    return list(dict.fromkeys([baseline, *names]))


#: Folds are fitted one by one; more than these are refused.
MOST_FOLDS = 1_000

#: What a random search draws from, by regressor; a pair is a range, a list a choice.
GRIDS: dict[str, dict] = {
    "ridge": {"regParam": (1e-2, 1e4)},
    "random_forest": {"numTrees": [100, 200, 300, 400], "featureSubsetStrategy": ["sqrt", "log2", "0.3"], "minInstancesPerNode": [1, 2, 3, 4, 5], "maxDepth": [5, 10, 20]},
    "gradient_boosting": {"maxIter": [100, 200, 300], "stepSize": (1e-2, 3e-1), "maxDepth": [2, 3, 4, 5]},
    "decision_tree": {"maxDepth": [3, 4, 5, 7, 10], "minInstancesPerNode": [1, 2, 3, 4, 5, 6, 7]},
}


def draws(name: str, n: int, seed: int) -> list[dict]:
    """``n`` parameter sets of a regressor, the same for a seed: choices evenly, ranges evenly in the logarithm."""
    import random

    if name not in GRIDS:
        raise KeyError(name)
    rng = random.Random(f"{name}|{seed}")
    pick = lambda v: rng.choice(v) if isinstance(v, list) else v[0] * (v[1] / v[0]) ** rng.random()
    return [{k: pick(v) for k, v in GRIDS[name].items()} for _ in range(n)]


def cross_validate(df: DataFrame, name: str, features: str, label: str, fold: str, params: list[dict]) -> DataFrame:
    """Mean of the fold RMSEs of each parameter set, over folds given in a column; one row a parameter set."""
    from pyspark.ml.evaluation import RegressionEvaluator

    spark, folds = df.sparkSession, sorted(r[0] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    measure = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")
    rows = []
    for nr, p in enumerate(params):
        scores = [measure.evaluate(regressor(name, features, label, **p).fit(df.where(F.col(fold) != k)).transform(df.where(F.col(fold) == k))) for k in folds]
        rows.append((nr, str(p), sum(scores) / len(scores)))
    return spark.createDataFrame(rows, "nr int, params string, cv_rmse double")


def search(df: DataFrame, names: list[str], features: str, label: str, fold: str, n_iter: int = 0, seed: int = 42) -> DataFrame:
    """(model, params, cv_rmse) of the best parameter set of each candidate; without ``n_iter`` each has its defaults. The mean baseline is scored too."""
    out = None
    for name in candidates(names):
        if name == "dummy":
            means = df.groupBy(fold).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
            whole = means.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
            held = means.crossJoin(F.broadcast(whole)).select(F.col(fold).alias("__f"), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("__m"))
            scored = df.join(F.broadcast(held), F.col(fold) == F.col("__f")).groupBy(fold).agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("__m"), F.lit(2)))).alias("r"))
            made = scored.agg(F.avg("r").alias("cv_rmse")).select(F.lit("dummy").alias("model"), F.lit("{}").alias("params"), "cv_rmse")
        else:
            found = cross_validate(df, name, features, label, fold, draws(name, n_iter, seed) if n_iter else [{}])
            made = found.orderBy("cv_rmse", "nr").limit(1).select(F.lit(name).alias("model"), "params", "cv_rmse")
        out = made if out is None else out.union(made)
    return out


def run_arm(df: DataFrame, ident: str, columns: list[str], targets: list[str], train: str, fold: str, arm: str) -> DataFrame:
    """The run loop of an arm with ridge and the mean baseline: cross-validated on the training rows, refitted, predicted on the test rows, averaged by ``ident``, clipped to the scale, scored.

    One row a target and candidate: ``arm``, ``target``, ``model``, ``cv_rmse``, ``n``, ``rmse``, ``mae``, ``r2``, ``chosen`` (the best by cross-validation,
    the baseline never). The loop over targets and folds runs on the driver; everything else is distributed.
    """
    from tallyframe.functions.scores import clip_target
    from tallyframe.operators.linear import ridge_cv
    from tallyframe.operators.metrics import regression

    folds = sorted(r[0] for r in df.where(F.col(train)).select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    rmse = lambda d, y: d.agg(F.sqrt(F.avg(F.pow(F.col(y) - F.col("y_pred"), F.lit(2))))).first()[0]
    out = None
    for y in targets:
        fit_rows, test_rows = df.where(F.col(train) & F.col(y).isNotNull()), df.where(~F.col(train) & F.col(y).isNotNull())
        cv = {"dummy": [], "ridge": []}
        for k in folds:
            inside, held = fit_rows.where(F.col(fold) != k), fit_rows.where(F.col(fold) == k)
            cv["ridge"].append(rmse(ridge_cv(inside, columns, y).predict(held), y))
            cv["dummy"].append(rmse(dummy(inside, held, y), y))
        predicted = {"ridge": ridge_cv(fit_rows, columns, y).predict(test_rows), "dummy": dummy(fit_rows, test_rows, y)}
        for model, p in predicted.items():
            mean = p.groupBy(ident).agg(F.avg(y).alias("y_true"), F.avg("y_pred").alias("y_pred"))
            clipped = mean.withColumn("y_pred", clip_target(F.col("y_pred"), F.lit(y)))
            made = regression(clipped, [], "y_true", "y_pred").select(F.lit(arm).alias("arm"), F.lit(y).alias("target"), F.lit(model).alias("model"), F.lit(sum(cv[model]) / max(1, len(folds))).alias("cv_rmse"), "n", "rmse", "mae", "r2", F.lit(model == "ridge").alias("chosen"))
            out = made if out is None else out.union(made)
    return out


def best_candidate(scores: DataFrame, model: str, score: str, baseline: str = "dummy") -> DataFrame:
    """The candidate with the lowest score, the baseline excluded; ties by name."""
    return scores.where(F.col(model) != baseline).orderBy(score, model).limit(1)
