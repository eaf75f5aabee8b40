"""Top N items within every group, by statistics-guided skipping.

The items are written once, clustered by group and score, as files of small row groups. Footers are then read in
parallel; a row group that holds one group only and lies strictly beyond a bound proved by another row group of that
group is dropped unread. The rest is read best score first, and a row group whose best score lies strictly beyond the
current N-th score of every group in it is skipped as well.

Here the lowest score is best ("descending maximum score" of the negated score). Ties: earliest time, then smallest id.

Defined results: rows with a NULL or blank group, a NULL id, or a score that is NULL, NaN, infinite or below ``least``
do not take part; an id counts once in its group, with its best line; a NULL time comes after all others; a group of
fewer than N items gives all it has; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import parallelism, scratch_path

FOOTER = "path string, rg int, rows bigint, pure boolean, keys array<string>, s_min double, s_max double"
FAR = 2**62


def normal_label(name: str):
    """Lower case without outer blanks; blank is NULL."""
    low = F.lower(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""))
    return F.when(low != "", low)


def eligible(df: DataFrame, groups: list[str], score: str, time: str, ident: str, least: float | None = 0.0) -> DataFrame:
    """Columns k0.., s, t (microseconds), i of the rows that take part, one line for each group and id."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf")) & F.col(ident).isNotNull()
    if least is not None:
        ok = ok & (F.col(score) >= least)
    keys = [normal_label(g).alias(f"k{n}") for n, g in enumerate(groups)]
    rows = df.where(ok).select(*keys, F.col(score).cast("double").alias("s"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(FAR)).alias("t"), F.col(ident).cast("bigint").alias("i"))
    names = [f"k{n}" for n in range(len(groups))]
    best = rows.dropna(subset=names).groupBy(*names, "i").agg(F.min(F.struct("s", "t")).alias("b"))
    return best.select(*names, F.col("b.s").alias("s"), F.col("b.t").alias("t"), "i").withColumn("g", F.xxhash64(*names))


def cluster_by_group(rows: DataFrame, names: list[str], path: str, files: int, row_group_bytes: int) -> None:
    """Range partitioning on group and score: a group with a third of all rows is spread over a third of the files."""
    order = ["g", *names, "s", "t", "i"]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", max(row_group_bytes // 8, 4096)).parquet(path)


def _list_files(spark, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [s.getPath().toString() for s in found if s.getPath().getName().endswith(".parquet")]


def _open(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
    system, inner = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(system.open_input_file(inner))


def read_footers(names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                file = _open(path)
                meta = file.metadata
                at = {meta.schema.column(c).name: c for c in range(meta.num_columns)}
                out = []
                for rg in range(meta.num_row_groups):
                    part = meta.row_group(rg)
                    stats = {n: part.column(at[n]).statistics for n in ("g", "s", *names)}
                    pure = all(stats[n] is not None and stats[n].has_min_max and stats[n].min == stats[n].max for n in ("g", *names))
                    known = stats["s"] is not None and stats["s"].has_min_max
                    out.append((path, rg, part.num_rows, pure, [stats[n].min for n in names] if pure else None, stats["s"].min if known else float("-inf"), stats["s"].max if known else float("inf")))
                yield pd.DataFrame(out, columns=["path", "rg", "rows", "pure", "keys", "s_min", "s_max"])

    return run


def best_first(n: int, names: list[str], report: bool = False):
    """For each file: its row groups best score first, with the current N-th score of each group in memory."""
    columns = ["g", *names, "s", "t", "i"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, parts in zip(batch["path"], batch["parts"]):
                file = _open(path)
                top: pd.DataFrame | None = None
                limit: dict[tuple, float] = {}
                for part in sorted(parts, key=lambda p: (p["s_min"], p["rg"])):
                    if limit:
                        held = file.read_row_group(part["rg"], columns=["g", *names]).to_pandas().drop_duplicates()
                        if all(part["s_min"] > limit.get(k, float("inf")) for k in held.itertuples(index=False, name=None)):
                            continue
                    rows = file.read_row_group(part["rg"], columns=columns).to_pandas()
                    top = rows if top is None else pd.concat([top, rows], ignore_index=True)
                    top = top.sort_values(columns, kind="stable", ignore_index=True)
                    groups = top.groupby(["g", *names], sort=False)
                    place = groups.cumcount().to_numpy()
                    top, place = top[place < n], place[place < n]
                    full = top[place == n - 1]
                    limit = dict(zip(full[["g", *names]].itertuples(index=False, name=None), full["s"]))
                if top is not None and len(top):
                    yield top[[*names, "s", "t", "i"]]

    return run


def plan_reading(footers: DataFrame, n: int) -> DataFrame:
    """Footers without the row groups that statistics alone rule out.

    A pure row group of at least N rows proves that the N-th score of its group is at most its largest score; every
    pure row group of the same group whose smallest score lies strictly beyond the least such proof is dropped.
    """
    proof = footers.where(F.col("pure") & (F.col("rows") >= n)).groupBy("keys").agg(F.min("s_max").alias("bound"))
    return footers.join(proof, "keys", "left").where(~F.col("pure") | F.col("bound").isNull() | (F.col("s_min") <= F.col("bound"))).drop("bound")


def row_group_size(df: DataFrame, files: int) -> int:
    """Bytes of a row group: an eighth of a file of the input, from 64 KiB to 16 MiB, so that the number of footers follows the number of files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(16 * 1024 * 1024, max(64 * 1024, size // max(1, files) // 8))


def top_n_clustered(spark, path: str, names: list[str], n: int, tasks: int) -> DataFrame:
    """Columns ``names``, s, t, i and ``place`` of the N best of each group of a table clustered as ``cluster_by_group`` does; nothing is written."""
    listed = spark.createDataFrame(pd.DataFrame({"path": _list_files(spark, path)}, dtype=object), "path string").repartition(tasks)
    footers = listed.mapInPandas(read_footers(names), FOOTER)
    wanted = plan_reading(footers, n).groupBy("path").agg(F.collect_list(F.struct("rg", "s_min")).alias("parts"))
    fields = ", ".join(f"{k} string" for k in names) + ", s double, t bigint, i bigint"
    near = wanted.repartition(tasks).mapInPandas(best_first(n, names), fields)
    place = F.row_number().over(Window.partitionBy(*names).orderBy("s", "t", "i"))
    return near.withColumn("place", place).where(F.col("place") <= n)


def top_n_by_group(
    df: DataFrame,
    groups: list[str],
    score: str,
    time: str,
    ident: str,
    n: int = 5,
    least: float | None = 0.0,
    row_group_bytes: int | None = None,
    files: int | None = None,
) -> DataFrame:
    """The N best items of each group as columns ``groups`` (normalised), ``ident``, ``score`` and ``place`` (from 1).

    Groups are clustered over ``files`` files. A group that fills several of them lies there in the order of its scores, so
    that the footers of all but its first rule them out.
    """
    spark = df.sparkSession
    names = [f"k{k}" for k in range(len(groups))]
    path = scratch_path(spark, "topn")
    files = files or parallelism(spark)
    cluster_by_group(eligible(df, groups, score, time, ident, least), names, path, files, row_group_bytes or row_group_size(df, files))
    final = top_n_clustered(spark, path, names, n, files)
    return final.select(*[F.col(k).alias(g) for k, g in zip(names, groups)], F.col("i").alias(ident), F.col("s").alias(score), "place")
