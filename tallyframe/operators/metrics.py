"""Regression, ordinal and screening metrics per group. Undefined values are NULL; group keys keep NULL as a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` of two aliased sides."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def regression(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """n, RMSE, MAE and R² (1 - SSE/SST); pairs with a NULL or NaN side do not count. One pass with map-side sums."""
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(y) & ~F.isnan(p))
    e = F.col(p) - F.col(y)
    sums = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    return sums.select(*keys, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", (1 - F.try_divide("sse", "sst")).alias("r2"))


def aggregate_predictions(df: DataFrame, keys: list[str], group: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean of truth and prediction of each group; clip afterwards, not before."""
    return df.groupBy(*keys, group).agg(F.avg(y).alias(y), F.avg(p).alias(p))


def confusion(df: DataFrame, keys: list[str], t: str, p: str, labels: list[int]) -> DataFrame:
    """Counts of every pair of the fixed ``labels``, zeros included, as rows (keys, t, p, n)."""
    counts = df.where(F.col(t).isin(labels) & F.col(p).isin(labels)).groupBy(*keys, t, p).agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in labels for b in labels]))
    cells = counts.select(*keys).distinct().withColumn("cell", grid).select(*keys, F.col("cell.a").alias(t), F.col("cell.b").alias(p))
    on = same_keys("g", "c", [*keys, t, p])
    return cells.alias("g").join(counts.alias("c"), on, "left").select(*[F.col(f"g.{k}").alias(k) for k in keys], F.col(f"g.{t}").alias(t), F.col(f"g.{p}").alias(p), F.coalesce("c.n", F.lit(0)).alias("n"))


def _label_counts(df: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    """tp, fp, fn of each label present on either side, from one pass over the pair counts."""
    pairs = df.where(F.col(t).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, t, p).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.col(t).alias("label"), F.lit(True).alias("true")), F.struct(F.col(p).alias("label"), F.lit(False).alias("true")))).alias("s"), F.col(t).alias("__t"), F.col(p).alias("__p"), "n")
    hit = F.col("__t") == F.col("__p")
    return sides.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum(F.when(hit & F.col("s.true"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit & ~F.col("s.true"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~hit & F.col("s.true"), F.col("n")).otherwise(0)).alias("fn")
    )


def f1(df: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    """F1 of each label present on either side; 0 where precision and recall are undefined."""
    return _label_counts(df, keys, t, p).select(*keys, "label", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def f1_macro(df: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    return f1(df, keys, t, p).groupBy(*keys).agg(F.avg("f1").alias("f1_macro"))


def qwk(df: DataFrame, keys: list[str], t: str, p: str) -> DataFrame:
    """Quadratic weighted kappa; weights use the position of a label among the labels present, NULL where nothing is expected."""
    pairs = df.where(F.col(t).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, t, p).agg(F.count(F.lit(1)).alias("n"))
    whole = pairs.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col(t).alias("t"), F.col(p).alias("p"), "n")).alias("cells"), F.array_sort(F.array_union(F.collect_set(t), F.collect_set(p))).alias("labels"), F.sum("n").cast("double").alias("total")
    )
    at = lambda x: F.array_position(F.col("labels"), x).cast("double")
    add = lambda s, x: s + x
    seen = F.aggregate(F.transform("cells", lambda c: F.pow(at(c["t"]) - at(c["p"]), F.lit(2)) * c["n"]), F.lit(0.0), add)
    margin = lambda side: F.transform("labels", lambda v: F.aggregate(F.transform("cells", lambda c: F.when(c[side] == v, c["n"].cast("double")).otherwise(0.0)), F.lit(0.0), add))
    counted = whole.select(*keys, "total", "labels", seen.alias("seen"), margin("t").alias("mt"), margin("p").alias("mp"))
    index = F.sequence(F.lit(0), F.size("labels") - 1)
    expected = F.aggregate(F.transform(index, lambda i: F.aggregate(F.transform(index, lambda j: F.pow(i - j, F.lit(2)) * F.get("mt", i) * F.get("mp", j)), F.lit(0.0), add)), F.lit(0.0), add) / F.col("total")
    return counted.select(*keys, (1 - F.try_divide(F.col("seen"), expected)).alias("qwk"))


def running_sums(counts: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds ``<sum>_below`` for each of ``sums``: its total over smaller values of the key. ``counts`` has a row for each value.

    The values of a key are cut into ranges by a monotone function of the value (32 ranges for each doubling of 1 + |v|),
    which needs no look at the data; ranges are summed apart, so that a key with a third of all values is no single task.
    """
    v = F.col(value).cast("double")
    part = F.when(F.isnan(v), F.lit(2**40)).otherwise(F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * 32)).cast("bigint")
    placed = counts.withColumn("__part", part)
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p")).agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    across = Window.partitionBy(*[f"__{k}" for k in keys]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *[f"__{k}" for k in keys], *[F.coalesce(F.sum(f"__s_{c}").over(across), F.lit(0)).alias(f"__b_{c}") for c in sums])
    each = placed.withColumns({f"__i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__part") == F.col("__p"))
    joined = each.join(before, on)
    return joined.select(*counts.columns, *[(F.col(f"__i_{c}") + F.col(f"__b_{c}")).alias(f"{c}_below") for c in sums])


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per distinct value: its count ``n`` and the average rank of its ties. Values are counted before anything is sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, keys, value, ["n"]).select(*keys, value, "n", (F.col("n_below") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Area under the ROC curve by the rank sum; NULL unless both classes occur."""
    counts = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
    won = running_sums(counts, keys, score, ["neg"]).withColumn("w", F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return won.groupBy(*keys).agg(F.try_divide(F.sum("w"), F.sum("pos") * F.sum("neg")).alias("auc"))
