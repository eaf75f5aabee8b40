"""Ridge regression from sums: moments in one pass, the penalty by exact leave-one-out errors in a second."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns whose second moments reach the driver; more are refused.
MOST_COLUMNS = 4_000
#: Penalties tried by default.
ALPHAS = tuple(10.0 ** (k / 4.0) for k in range(-8, 17))


@dataclass(frozen=True)
class Ridge:
    names: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float
    alpha: float

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """Adds the prediction as a native expression."""
        total = F.lit(self.intercept)
        for n, m, s, c in zip(self.names, self.mean, self.scale, self.coefficients):
            total = total + (F.col(n).cast("double") - F.lit(float(m))) * F.lit(float(c / s))
        return df.withColumn(out, total)

    def table(self, spark) -> DataFrame:
        """One row a column: ``feature``, ``coefficient`` (of the standardised column), ``place`` from the lowest."""
        order = sorted(zip(self.coefficients.tolist(), self.names))
        return spark.createDataFrame([(n, c, k + 1) for k, (c, n) in enumerate(order)], "feature string, coefficient double, place int")


def _moments(names: list[str], label: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.ones(len(batch)), batch[names].to_numpy(float), batch[label].to_numpy(float)])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "x": total.ravel()})

    return run


def _left_out(shared, names: list[str], label: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, scale, middle, vectors, weights, fitted, n = shared.value
        total = np.zeros(len(weights))
        for batch in batches:
            if len(batch):
                z = ((batch[names].to_numpy(float) - mean) / scale) @ vectors
                e = (batch[label].to_numpy(float) - middle)[:, None] - z @ fitted.T
                h = (z * z) @ weights.T + 1.0 / n
                total += ((e / np.maximum(1e-12, 1 - h)) ** 2).sum(0)
        yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

    return run


def ridge_cv(df: DataFrame, names: list[str], label: str, alphas: tuple[float, ...] = ALPHAS) -> Ridge:
    """Ridge on standardised columns (population deviation, 1 where it is 0), the penalty with the least leave-one-out error.

    Rows with a NULL or NaN do not take part; without any row it raises. Two passes over the rows; what reaches the driver is
    d² sums and one number a penalty.
    """
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    used = [*names, label]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in used]).dropna()
    sums = rows.mapInPandas(_moments(names, label), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    d = len(names)
    if not len(sums):
        raise ValueError("no row has all columns")
    m = np.zeros((d + 2) ** 2)
    m[sums["i"]] = sums["x"]
    m = m.reshape(d + 2, d + 2)
    n, mean, middle = m[0, 0], m[0, 1 : d + 1] / m[0, 0], m[0, d + 1] / m[0, 0]
    cov = m[1 : d + 1, 1 : d + 1] - n * np.outer(mean, mean)
    spread = np.maximum(np.diag(cov) / n, 0)
    # A constant column: what is left of its variance is rounding.
    flat = spread <= 1e-12 * np.maximum(1.0, mean * mean)
    scale = np.where(flat, 1.0, np.sqrt(spread))
    gram = np.where(flat[:, None] | flat[None, :], 0.0, cov / np.outer(scale, scale))
    right = np.where(flat, 0.0, (m[1 : d + 1, d + 1] - n * mean * middle) / scale)
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0)
    weights = np.array([1.0 / (values + a) for a in alphas])
    fitted = weights * (vectors.T @ right)
    shared = df.sparkSession.sparkContext.broadcast((mean, scale, middle, vectors, weights, fitted, n))
    errors = rows.mapInPandas(_left_out(shared, names, label), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    best = int(errors.argmin())
    return Ridge(tuple(names), mean, scale, vectors @ fitted[best], float(middle), float(alphas[best]))
