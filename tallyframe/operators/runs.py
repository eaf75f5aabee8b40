"""Questions over append-only run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import label

RUN_KEY = ["encoder", "augmentation", "target", "seed", "search"]
TRIAL_KEY = [*RUN_KEY, "selected_model"]


def clean_log(df: DataFrame) -> DataFrame:
    """Labels in one spelling; a line logged twice under one run id counts once (the rows agree but for spelling)."""
    named = df.withColumns({c: label(F.col(c)) for c in ("encoder", "target")})
    return named.dropDuplicates(["run_id"])


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that was appended last. NULL is a key value. ``max_by`` keeps one row a key before the shuffle."""
    kept = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def best(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of each key with the lowest score, then the lowest ``tie``; rows without a finite score do not take part."""
    ok = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf")))
    kept = [c for c in df.columns if c not in keys]
    found = ok.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(score, tie)).alias("__row"))
    return found.select(*keys, "__row.*").select(*df.columns)


def summarize(df: DataFrame, keys: list[str], score: str, digits: int = 3) -> DataFrame:
    """Mean, sample deviation and number of a score per key; NULL keys are left out."""
    ok = df.dropna(subset=keys).where(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf")))
    return ok.groupBy(*keys).agg(F.round(F.avg(score), digits).alias("mean"), F.round(F.stddev_samp(score), digits).alias("sd"), F.count(F.lit(1)).alias("n"))


def first_not_null(df: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column))


def strict_pivot(df: DataFrame, index: list[str], column: str, values: list[str], cell: str) -> DataFrame:
    """Pivot that refuses a second value for a cell."""
    if df.where(F.col(column).isin(values)).groupBy(*index, column).count().where("count > 1").limit(1).count():
        raise ValueError(f"duplicate entries for {index} and {column}")
    return df.groupBy(*index).pivot(column, values).agg(F.first(cell))


def early_stop(df: DataFrame, keys: list[str], epoch: str, loss: str, patience: int = 3, tolerance: float = 1e-4) -> DataFrame:
    """Best epoch and stop epoch of each curve: an epoch is better only by more than ``tolerance``. A curve is bounded by its epochs."""
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(a, x):
        over = a["stop"].isNotNull()
        better = x["l"] < a["best"] - tolerance
        bad = F.when(better, 0).otherwise(a["bad"] + 1)
        return F.struct(
            F.when(~over & better, x["l"]).otherwise(a["best"]).alias("best"), F.when(~over & better, x["e"]).otherwise(a["at"]).alias("at"), F.when(over, a["bad"]).otherwise(bad).alias("bad"), F.when(over, a["stop"]).when(bad >= patience, x["e"]).alias("stop")
        )

    curves = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("int").alias("e"), F.col(loss).cast("double").alias("l")))).alias("c"))
    done = curves.select(*keys, F.aggregate("c", zero, step).alias("r"))
    return done.select(*keys, F.col("r.at").alias("best_epoch"), F.col("r.stop").alias("stop_epoch"))


def last_in_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``latest`` with several order columns, as a window (for the window-shaped form of the question)."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
