"""Rank statistics, paired comparisons and corrections for multiple testing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scores import normal_cdf
from tallyframe.operators.metrics import average_rank, running_sums, same_keys


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, ident: str) -> DataFrame:
    """Adds ``q``: the running minimum of p·n/rank from the largest p, at most 1."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(by.orderBy(p, ident))).withColumn("__n", F.count(F.lit(1)).over(by))
    down = by.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down))).drop("__r", "__n")


def holm(df: DataFrame, keys: list[str], p: str, ident: str, alpha: float = 0.05) -> DataFrame:
    """Adds ``threshold`` and ``significant``; the chain stops at the first failure."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumn("__r", F.row_number().over(by.orderBy(p, ident))).withColumn("__n", F.count(F.lit(1)).over(by))
    cut = ranked.withColumn("threshold", F.lit(alpha) / (F.col("__n") - F.col("__r") + 1))
    chain = by.orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.withColumn("significant", F.min((F.col(p) <= F.col("threshold")).cast("int")).over(chain) == 1).drop("__r", "__n")


def correlation(x: str, y: str):
    """Pearson's r as an aggregate; NULL instead of an error where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rho with average ranks; 0 where a side is constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counted = pairs.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("w"))
    for value, out in ((x, "rx"), (y, "ry")):
        ranks = average_rank(pairs, keys, value)
        on = same_keys("a", "b", [*keys, value])
        counted = counted.alias("a").join(ranks.alias("b"), on).select("a.*", F.col("b.avg_rank").alias(out))
    w, rx, ry = F.col("w").cast("double"), F.col("rx"), F.col("ry")
    sums = counted.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * ry).alias("sxy"), F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"))
    n = F.col("n")
    top = F.col("sxy") - F.col("sx") * F.col("sy") / n
    low = F.sqrt(F.greatest(F.lit(0.0), (F.col("sxx") - F.col("sx") ** 2 / n)) * F.greatest(F.lit(0.0), (F.col("syy") - F.col("sy") ** 2 / n)))
    return sums.select(*keys, n.cast("bigint").alias("n"), F.coalesce(F.when(low > 1e-12, top / low), F.lit(0.0)).alias("rho"))


def _cosine_power(low, high, power, steps: int = 400):
    """Simpson's rule for the integral of cos(x) ** power."""
    width = (high - low) / (2.0 * steps)
    f = lambda k: F.pow(F.greatest(F.cos(low + k * width), F.lit(0.0)), power)
    weights = F.transform(F.sequence(F.lit(0), F.lit(2 * steps)), lambda k: F.when((k == 0) | (k == 2 * steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0) * f(k))
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) * width / 3.0


def student_p(t, freedom):
    """Two-sided p of Student's t: with x = sqrt(freedom)·tan(angle) the density is a power of the cosine, whose tail and whole are integrated alike."""
    angle, half = F.atan(F.abs(t) / F.sqrt(freedom)), F.lit(1.5707963267948966)
    # The power falls to nothing within a few widths, so the interval is cut there and the steps are always fine enough.
    reach = F.least(half, F.lit(12.0) / F.sqrt(freedom))
    whole = _cosine_power(F.lit(0.0), reach, freedom - 1)
    return F.when(angle >= reach, 0.0).otherwise(F.least(F.lit(1.0), _cosine_power(angle, reach, freedom - 1) / whole))


def spearman_p(rho, n):
    """Two-sided p of a rank correlation over n pairs: 1 where it is 0 or n < 3, 0 where it is 1."""
    r, freedom = rho.cast("double"), (n - 2).cast("double")
    t = F.abs(r) * F.sqrt(F.try_divide(freedom, 1.0 - r * r))
    return F.when((n < 3) | (r == 0), 1.0).when(F.abs(r) >= 1 - 1e-12, 0.0).otherwise(student_p(t, freedom))


def feature_summary(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """For each feature: mean, sample deviation, least, greatest, share of rows that are not 0, and for each target rank correlation, p and Benjamini-Hochberg q; strongest first."""
    long = df.select(*targets, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select(*targets, "s.*")
    out = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"), (100 * F.avg((F.col("x") != 0).cast("double"))).alias("pct_nonzero"))
    for t in targets:
        rho = spearman(long, ["feature"], "x", t).select("feature", F.round("rho", 9).alias(f"rho_{t}"), F.round(spearman_p(F.round("rho", 9), F.col("n")), 9).alias(f"p_{t}"))
        out = out.join(benjamini_hochberg(rho, [], f"p_{t}", "feature").withColumnRenamed("q", f"q_{t}"), "feature")
    return out.withColumn("abs_rho_max", F.greatest(*[F.abs(f"rho_{t}") for t in targets]) if len(targets) > 1 else F.abs(f"rho_{targets[0]}"))


def collinear(df: DataFrame, features: list[str], threshold: float = 0.8) -> DataFrame:
    """Pairs of features whose ranks correlate by ``threshold`` or more, either way, over the rows that have all of them."""
    rows = df.select(F.monotonically_increasing_id().alias("__i"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    ranked = rows
    for k, f in enumerate(features):
        ranks = average_rank(rows.select(f), [], f).select(F.col(f).alias(f"__v{k}"), F.col("avg_rank").alias(f"__r{k}"))
        ranked = ranked.join(ranks, F.col(f) == F.col(f"__v{k}"))
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    one = ranked.agg(*[F.abs(correlation(f"__r{i}", f"__r{j}")).alias(f"{i}|{j}") for i, j in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(features[i]).alias("feature_a"), F.lit(features[j]).alias("feature_b"), F.col(f"`{i}|{j}`").alias("abs_spearman")) for i, j in pairs])).alias("s")).select("s.*")
    return long.where(F.col("abs_spearman") >= threshold)


def neutral_stats(df: DataFrame, keys: list[str], value: str, neutral: float) -> DataFrame:
    """Mean, population deviation, least, greatest and 5th percentile of a value per key; where there is none, ``neutral`` and deviation 0."""
    v, n = F.col(value), F.lit(neutral)
    return df.groupBy(*keys).agg(*[F.coalesce(c, d).alias(name) for name, c, d in (("mean", F.avg(v), n), ("sd", F.stddev_pop(v), F.lit(0.0)), ("min", F.min(v), n), ("max", F.max(v), n), ("p05", F.percentile(v, F.lit(0.05)), n))])


def wilcoxon(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank statistic W (the smaller rank sum) of ``a - b`` without zeros, and the two-sided p of the normal approximation with ties.

    p is 1 where every difference is 0. For few pairs without ties see ``wilcoxon_exact``.
    """
    d = F.col(a) - F.col(b)
    size = F.when(F.abs(d) > 1e-12, F.round(F.abs(d), 12)).otherwise(0.0)
    # One pass: signs are counted for each size of the difference before anything is ranked; size 0 keeps groups without any difference.
    counted = df.select(*keys, F.coalesce(size, F.lit(0.0)).alias("m"), d.alias("d")).groupBy(*keys, "m").agg(F.sum(F.when((F.col("m") > 0) & (F.col("d") > 0), 1).otherwise(0)).alias("up"), F.sum(F.when((F.col("m") > 0) & (F.col("d") < 0), 1).otherwise(0)).alias("down"))
    ranked = running_sums(counted.withColumn("n", F.col("up") + F.col("down")), keys, "m", ["n"]).withColumn("rank", F.col("n_below") + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.sum(F.col("up") * F.col("rank")).alias("wp"), F.sum(F.col("down") * F.col("rank")).alias("wm"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n = F.col("pairs").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.try_divide(F.least("wp", "wm") - n * (n + 1) / 4, spread)
    return sums.select(*keys, "pairs", F.least("wp", "wm").alias("w"), F.coalesce(F.least(F.lit(1.0), 2 * normal_cdf(z)), F.lit(1.0)).alias("p"))


def exact_signed_rank_p(w: float, n: int) -> float:
    """Two-sided exact p of the smaller rank sum ``w`` over ``n`` pairs without ties, by counting subsets of 1..n."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))


def wilcoxon_exact(tested: DataFrame, most: int = 50) -> DataFrame:
    """``wilcoxon``'s rows with the exact p where there are at most ``most`` pairs and W is whole; the others keep theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = [exact_signed_rank_p(w, int(n)) if 0 < n <= most and float(w).is_integer() else q for w, n, q in zip(batch["w"], batch["pairs"], batch["p"])]
            yield batch.assign(p=p)

    return tested.mapInPandas(run, tested.schema)


def _poisson_steps() -> np.ndarray:
    """The distribution function of Poisson(1) in units of 2**-64, as far as a double tells it from 1."""
    steps, term, total, k = [], math.exp(-1), math.exp(-1), 0
    while total < 1:
        steps.append(int(total * 2**64))
        k += 1
        term /= k
        total += term
        if steps[-1] == int(min(total, 1) * 2**64):
            break
    return np.array(steps, dtype=np.uint64)


def poisson_weights(seed: str, ident: str, resamples: int) -> np.ndarray:
    """How often a row takes part in each resample: Poisson(1), from a Philox generator keyed by the md5 of seed and id."""
    key = int.from_bytes(hashlib.md5(f"{seed}|{ident}".encode()).digest(), "big")
    return np.searchsorted(_STEPS, np.random.Philox(key=key).random_raw(resamples), side="right").astype(np.uint8)


_STEPS = _poisson_steps()


def bootstrap_intervals(df: DataFrame, keys: list[str], ident: str, values: list[str], resamples: int = 2000, seed: str = "42") -> DataFrame:
    """Percentile interval (2.5 %, 97.5 %) of the mean of each of ``values`` under Poisson resampling: ``<value>_low``, ``<value>_high``.

    Rows where one of the values is NULL don't take part. The weights depend on the id alone, so they are the same on
    every run, and an id has the same in all groups. A partition is read in the order of the keys with one running sum a
    resample: no group is held, and nothing is multiplied by the number of resamples before it is summed. The sums are
    numpy's, as the weights of one id are made once and met by all its rows.
    """
    cols = [F.col(v).cast("double").alias(v) for v in values]
    rows = df.dropna(subset=values).select(*keys, F.col(ident).cast("string").alias("__id"), *cols)
    apart = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys)
    out = [f"{v}_{side}" for v in values for side in ("low", "high")]

    def interval(group: tuple, sums: np.ndarray) -> tuple:
        drawn = sums[-1] > 0
        means = sums[:-1, drawn] / sums[-1, drawn]
        return (*group, *(np.quantile(means, [0.025, 0.975], axis=1).T.ravel().tolist() if drawn.any() else [None] * len(out)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        group, sums = None, None
        for batch in batches:
            if not len(batch):
                continue
            codes = np.stack([pd.factorize(batch[k])[0] for k in keys] or [np.zeros(len(batch), int)])
            at = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1), len(batch)]
            ids, done = batch["__id"].to_numpy(), []
            of = np.vstack([batch[values].to_numpy(float).T, np.ones(len(batch))])
            for start, stop in zip(at, at[1:]):
                name = tuple(None if pd.isna(batch[k].iat[start]) else batch[k].iat[start] for k in keys)
                if name != group or sums is None:
                    if sums is not None:
                        done.append(interval(group, sums))
                    group, sums = name, np.zeros((len(of), resamples))
                for i in range(start, stop, 500):
                    some = ids[i : min(i + 500, stop)]
                    for x in some:
                        if x not in known:
                            if len(known) >= 32_768:
                                known.clear()
                            known[x] = poisson_weights(seed, x, resamples)
                    sums += of[:, i : i + len(some)] @ np.stack([known[x] if x in known else poisson_weights(seed, x, resamples) for x in some]).astype(float)
            yield pd.DataFrame(done, columns=[*keys, *out])
        if sums is not None:
            yield pd.DataFrame([interval(group, sums)], columns=[*keys, *out])

    kinds = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema], *[f"`{c}` double" for c in out]]
    return apart.mapInPandas(run, ", ".join(kinds))


def bootstrap_interval(df: DataFrame, keys: list[str], ident: str, value: str, resamples: int = 2000, seed: str = "42") -> DataFrame:
    """``bootstrap_intervals`` of one value, as ``low`` and ``high``."""
    got = bootstrap_intervals(df, keys, ident, [value], resamples, seed)
    return got.select(*keys, F.col(f"{value}_low").alias("low"), F.col(f"{value}_high").alias("high"))


def paired(df: DataFrame, by: list[str], arm: str, a, b, y: str, p: str, keep: list[str]) -> DataFrame:
    """Rows of two arms side by side: ``keep``, ``by``, truth, both predictions and the differences of squared and absolute errors (a - b)."""
    cols = [*keep, *by]
    left = df.where(F.col(arm) == a).select(*cols, F.col(y).alias("y"), F.col(p).alias("pa"))
    right = df.where(F.col(arm) == b).select(*cols, F.col(p).alias("pb"))
    ea, eb = F.col("pa") - F.col("y"), F.col("pb") - F.col("y")
    return left.join(right, cols).withColumns({"d_squared": ea * ea - eb * eb, "d_absolute": F.abs(ea) - F.abs(eb)})
