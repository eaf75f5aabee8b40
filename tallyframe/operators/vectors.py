"""Neighbours, spread and silhouette over embeddings: matrix products over Arrow batches, without pairs of all rows where sums do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.vectors import unit
from tallyframe.session import materialise

#: Rows of a stated query set that are broadcast at once; a larger set takes several passes over the base.
BLOCK = 16_384
#: Distinct labels whose summed vectors are broadcast; more are refused.
MOST_LABELS = 100_000


def mean_pool(df: DataFrame, keys: list[str], vector: str, renormalise: bool = False) -> DataFrame:
    """Mean vector of each key, by position, with map-side sums; optionally brought back to length 1."""
    parts = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))
    return rows.withColumn(vector, unit(F.col(vector))) if renormalise else rows


def pool_levels(df: DataFrame, levels: list[list[str]], vector: str, renormalise: tuple[bool, ...] = ()) -> DataFrame:
    """Mean of means, level by level (chunk, question, person): each level weighs its members alike; a level may bring its means back to length 1."""
    for k, keys in enumerate(levels):
        df = mean_pool(df, keys, vector, k < len(renormalise) and renormalise[k])
    return df


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of a batch brought to length 1; zero vectors stay."""
    x = np.stack(vectors.to_numpy()).astype(float)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _against(shared, ident: str, vector: str, least: float | None, k: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            base = batch[ident].to_numpy()
            near = np.round(_matrix(batch[vector]) @ q.T, 6) + 0.0
            near[base[:, None] == ids[None, :]] = -np.inf
            if k is not None and len(base) > k:
                # The k best of the batch for each query, and all that tie with the last of them.
                last = -np.partition(-near, k - 1, axis=0)[k - 1]
                b, a = np.nonzero((near >= last) & (near > -np.inf))
            else:
                b, a = np.nonzero(near >= (-np.inf if least is None else least))
                keep = near[b, a] > -np.inf
                b, a = b[keep], a[keep]
            yield pd.DataFrame({"q": ids[a], "b": base[b], "similarity": near[b, a]})

    return run


def _scored(queries: DataFrame, base: DataFrame, ident: str, vector: str, least: float | None = None, k: int | None = None) -> DataFrame:
    """Query rows with other rows of ``base``: (q, b, similarity), as many as ``least`` or the best ``k`` of a batch leave.

    The query set is stated by the caller and may be of any size: at most ``BLOCK`` of its rows are broadcast at once, each
    block takes one pass over ``base`` in which a batch of rows meets the block in one matrix product. Nothing is shuffled;
    with several blocks the pairs of each are written before the next is read.
    """
    spark = base.sparkSession
    kind = base.schema[ident].dataType.simpleString()
    rows = queries.select(F.col(ident).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    total = rows.count()
    blocks = max(1, -(-2 * total // BLOCK)) if total > BLOCK else 1
    found = base.select(ident, vector).where(F.col(ident).isNotNull() & F.col(vector).isNotNull())
    out = None
    for n in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
        held = some.toPandas()
        if not len(held):
            continue
        shared = spark.sparkContext.broadcast((held["id"].to_numpy(), _matrix(held["v"])))
        met = found.mapInPandas(_against(shared, ident, vector, least, k), f"q {kind}, b {kind}, similarity double")
        if blocks > 1:
            met = materialise(met, "near")
            shared.destroy()
        out = met if out is None else out.union(met)
    return out if out is not None else spark.createDataFrame([], f"q {kind}, b {kind}, similarity double")


def similar(queries: DataFrame, base: DataFrame, ident: str, vector: str, least: float) -> DataFrame:
    """All pairs of a query row and another row of ``base`` with at least that similarity, however many: (ident, neighbour, similarity). Nothing is sorted or shuffled."""
    near = _scored(queries, base, ident, vector, least=least)
    return near.select(F.col("q").alias(ident), F.col("b").alias("neighbour"), "similarity")


def neighbours(queries: DataFrame, base: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """The k most similar rows of ``base`` for each query row, itself excluded: (ident, neighbour, similarity, place); ties by id.

    Each batch of ``base`` keeps k a query, with ties, and only those move.
    """
    order = Window.partitionBy("q").orderBy(F.col("similarity").desc(), "b")
    top = _scored(queries, base, ident, vector, k=k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return top.select(F.col("q").alias(ident), F.col("b").alias("neighbour"), "similarity", "place")


def _moments(vector: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            if not len(batch):
                continue
            u = _matrix(batch[vector])
            u = u[(u != 0).any(1)]
            n, first, second = n + len(u), first + u.sum(0), second + u.T @ u
        if n:
            yield pd.DataFrame({"i": np.arange(1 + len(first) + second.size), "x": np.concatenate([[float(n)], first, second.ravel()])})

    return run


def cosine_moments(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation of the cosine over all ordered pairs of different rows, from sums alone; zero vectors have no cosine.

    The sum of all dot products is the squared length of the summed vectors; the sum of their squares is the squared
    Frobenius norm of the d×d second-moment matrix. One pass; a task hands on d² + d + 1 sums.
    """
    sums = df.select(vector).where(F.col(vector).isNotNull()).mapInPandas(_moments(vector), "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x"))
    one = sums.agg(F.max(F.when(F.col("i") == 0, F.col("x"))).alias("n"), F.max("i").alias("last"), F.sum(F.lit(0)).alias("z"))
    d = F.round((F.sqrt(4.0 * F.col("last") + 1) - 1) / 2).cast("bigint")
    parts = sums.crossJoin(F.broadcast(one.select("n", d.alias("d")))).groupBy("n").agg(
        F.sum(F.when((F.col("i") > 0) & (F.col("i") <= F.col("d")), F.col("x") * F.col("x")).otherwise(0.0)).alias("s1"), F.sum(F.when(F.col("i") > F.col("d"), F.col("x") * F.col("x")).otherwise(0.0)).alias("s2")
    )
    pairs = F.col("n") * (F.col("n") - 1.0)
    made = parts.withColumn("mean", F.try_divide(F.col("s1") - F.col("n"), pairs))
    return made.select(F.col("n").cast("bigint").alias("n"), "mean", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("s2") - F.col("n"), pairs) - F.col("mean") ** 2)).alias("sd"))


def _label_sums(vector: str, label: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, list] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(k, n, s) for k, (n, s) in sums.items()], columns=["c", "n", "s"])

        for batch in batches:
            if not len(batch):
                continue
            u = _matrix(batch[vector])
            codes, names = pd.factorize(batch[label])
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            for at, total, n in zip(cuts, np.add.reduceat(u[order], cuts), np.diff([*cuts, len(order)])):
                known = sums.setdefault(names[codes[order][at]], [0, 0.0])
                known[0] += int(n)
                known[1] = known[1] + total
            if len(sums) > 10_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    return run


def _silhouettes(shared, vector: str, label: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, sizes, sums = shared.value
        for batch in batches:
            if not len(batch):
                continue
            u = _matrix(batch[vector])
            own = np.array([where[k] for k in batch[label]])
            dots = u @ sums.T
            rows = np.arange(len(u))
            far = 1 - dots / sizes
            n = sizes[own]
            a = np.where(n > 1, 1 - (dots[rows, own] - (u * u).sum(1)) / np.maximum(n - 1, 1), np.nan)
            far[rows, own] = np.inf
            b = far.min(1)
            top = np.maximum(a, b)
            s = np.divide(b - a, top, out=np.zeros(len(u)), where=np.isfinite(top) & (top != 0) & np.isfinite(a))
            yield pd.DataFrame({"n": [len(u)], "s": [s.sum()]})

    return run


def silhouette(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """Mean silhouette under cosine distance. The mean distance to a cluster is 1 minus the dot product with its mean, so rows meet clusters, never rows.

    Two passes; a row alone in its cluster, or all rows in one cluster, count 0. The clusters' sums are broadcast: at most
    ``MOST_LABELS``, more are refused. Rows without vector or label do not take part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(label).alias("l"), F.col(vector).alias("v")).where("l is not null and v is not null")
    kind = rows.schema["l"].dataType.simpleString()
    parts = rows.mapInPandas(_label_sums("v", "l"), f"c {kind}, n bigint, s array<double>")
    summed = parts.select("c", "n", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    clusters = summed.groupBy("c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s")).limit(MOST_LABELS + 1).toPandas()
    if len(clusters) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not len(clusters):
        return spark.createDataFrame([(0, None)], "n bigint, silhouette double")
    shared = spark.sparkContext.broadcast(({c: i for i, c in enumerate(clusters["c"])}, clusters["n"].to_numpy(float), np.stack(clusters["s"])))
    return rows.mapInPandas(_silhouettes(shared, "v", "l"), "n bigint, s double").agg(F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("n")).alias("silhouette"))
