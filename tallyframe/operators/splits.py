"""Deterministic, leakage-guarded splits by md5 ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scores import band
from tallyframe.functions.text import draw
from tallyframe.operators.ranking import bits_for, class_rank


class LeakageError(ValueError):
    """Protected units occur among training units."""


def stratify_key(df: DataFrame, phq: str, gad: str, least: int = 2) -> DataFrame:
    """Adds ``stratum``: 4·band + band, 0 for strata of fewer than ``least`` rows. Strata are counted, not sorted."""
    keyed = df.withColumn("__k", band(F.col(phq)) * 4 + band(F.col(gad)))
    sizes = keyed.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("__k", "__j")
    return keyed.join(F.broadcast(sizes), F.col("__k").eqNullSafe(F.col("__j"))).withColumn("stratum", F.when(F.col("__n") < least, 0).otherwise(F.col("__k"))).drop("__k", "__j", "__n")


def _sized(df: DataFrame, classes: list[str], size: str = "__n") -> DataFrame:
    """Adds the number of rows of each class; the counts are broadcast only where Spark finds them small."""
    counts = df.groupBy(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(classes)]).agg(F.count(F.lit(1)).alias(size))
    on = F.lit(True)
    for i, c in enumerate(classes):
        on = on & F.col(c).eqNullSafe(F.col(f"__c{i}"))
    return df.join(counts, on).drop(*[f"__c{i}" for i in range(len(classes))])


def _bits(df: DataFrame, bits: int | None) -> int:
    """Buckets for ranks inside strata follow the number of units; counting reads no more than their ids."""
    return bits_for(df.count()) if bits is None else bits


def rank_split(df: DataFrame, ident: str, stratum: str, test: float = 0.3, seed: str = "42", bits: int | None = None) -> DataFrame:
    """Adds ``split``: in each stratum the first round(n·test) units by md5 are the test set. No stratum is sorted in one task."""
    ranked = class_rank(df, [stratum], [ident], "__r", _bits(df, bits), draw(F.col(ident), F.lit(seed)))
    return _sized(ranked, [stratum]).withColumn("split", F.when(F.col("__r") < F.bround(F.col("__n") * F.lit(test)), "test").otherwise("train")).drop("__r", "__n")


def group_folds(df: DataFrame, group: str, stratum: str | None, k: int = 5, seed: str = "42", bits: int | None = None) -> DataFrame:
    """Adds ``fold``: groups are dealt to folds by md5 rank inside their stratum, then carried to the rows."""
    groups = df.groupBy(F.col(group).alias("__g")).agg((F.min(stratum) if stratum else F.lit(0)).alias("__s"))
    ranked = class_rank(groups, ["__s"], ["__g"], "__r", _bits(groups, bits), draw(F.col("__g"), F.lit(seed)))
    dealt = ranked.select("__g", (F.col("__r") % k).cast("int").alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def group_split(df: DataFrame, group: str, test: float = 0.2, seed: str = "42", bits: int | None = None) -> DataFrame:
    """Adds ``split``: round(n·test) whole groups by md5 rank are the test set."""
    groups = df.select(F.col(group).alias("__g")).distinct().withColumn("__s", F.lit(0))
    marked = rank_split(groups, "__g", "__s", test, seed, bits).select("__g", "split")
    return df.join(marked, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def hold_out_groups(df: DataFrame, source: str, group: str, fraction: float = 0.1, seed: str = "42", bits: int | None = None) -> DataFrame:
    """Adds ``validation``: in each source max(1, round half even(n·fraction)) whole groups are held out."""
    groups = df.select(F.col(source).alias("__s"), F.col(group).alias("__g")).distinct()
    ranked = _sized(class_rank(groups, ["__s"], ["__g"], "__r", _bits(groups, bits), draw(F.col("__s"), F.col("__g"), F.lit(seed))), ["__s"])
    held = ranked.select("__s", "__g", (F.col("__r") < F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(fraction)))).alias("validation"))
    return df.join(held, F.col(source).eqNullSafe(F.col("__s")) & F.col(group).eqNullSafe(F.col("__g"))).drop("__s", "__g")


def leaks(train: DataFrame, protected: DataFrame, on: Column) -> DataFrame:
    """Training rows whose unit is protected."""
    return train.join(protected, on, "left_semi")


def assert_disjoint(train: DataFrame, protected: DataFrame, on: Column) -> None:
    """Raise before anything is trained if a protected unit occurs; stops at the first one."""
    if leaks(train, protected, on).limit(1).count():
        raise LeakageError("protected units occur in the training rows")


def train_frame(plain: DataFrame, augmented: DataFrame | None, protected: DataFrame, on: Column) -> DataFrame:
    """The rows to train on: the augmented ones where there are any, else the plain ones; either way a protected unit among them raises."""
    chosen = plain if augmented is None else augmented
    assert_disjoint(chosen, protected, on)
    return chosen


def fold_audit(df: DataFrame, group: str, k: int) -> DataFrame:
    """For each fold: rows and distinct groups on either side, and groups on both (0 for a sound split)."""
    groups = df.groupBy(group, "fold").agg(F.count(F.lit(1)).alias("n"))
    spread = groups.groupBy(group).agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("by"))
    each = spread.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("f", "all", F.coalesce(F.element_at("by", F.col("f")), F.lit(0)).alias("mine"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return each.groupBy(F.col("f").alias("fold")).agg(
        F.sum("mine").alias("test_rows"), F.sum(F.col("all") - F.col("mine")).alias("train_rows"), count(F.col("mine") > 0).alias("test_groups"), count(F.col("all") > F.col("mine")).alias("train_groups"), count((F.col("mine") > 0) & (F.col("all") > F.col("mine"))).alias("overlap")
    )
