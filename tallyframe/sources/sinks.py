"""Writers: append-only logs, overwritten snapshots, guarded caches, sheets and layout migration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.sources.readers import exists

PLACE = ["family", "augmentation", "granularity"]


def append_rows(df: DataFrame, root: str, seq: str = "run_id", place: list[str] | None = None) -> None:
    """Append to a log; rows go to the folder their own columns name. ``seq`` (the append order) must be there: Spark keeps no order."""
    if seq not in df.columns:
        raise ValueError(f"an append-only log needs its order in {seq}")
    df.write.mode("append").partitionBy(*(place or PLACE)).parquet(root)


def number_rows(df: DataFrame, after: int, order: list[str], seq: str = "run_id") -> DataFrame:
    """Give a small batch of new rows the next numbers of a log."""
    return df.withColumn(seq, F.lit(after) + F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def overwrite_snapshot(df: DataFrame, root: str, keys: list[str]) -> None:
    """One snapshot a run key: partitions that occur in ``df`` are replaced, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)


class StaleCache(ValueError):
    """The cached matrix belongs to other ids or another producer."""


def load_or_compute(spark: SparkSession, path: str, ids: DataFrame, signature: str | None, compute) -> DataFrame:
    """A cached matrix with a row for each ``id``, guarded by the ids in their order and by the signature of its producer.

    ``ids`` has ``id`` and, where the order of rows matters, ``pos``; what ``compute`` gives has the same columns and is
    written where there is nothing yet. A cache without a signature is stamped with the first one that is asked for.
    """
    stamp = f"{path.rstrip('/')}.signature"
    if exists(spark, path):
        known = spark.read.text(stamp).first()[0] if exists(spark, stamp) else None
        if signature is not None and known is not None and known != signature:
            raise StaleCache(f"{path} was made by {known}, not by {signature}")
        found = spark.read.parquet(path)
        keys = ["id", "pos"] if "pos" in ids.columns else ["id"]
        a, b = found.select(*keys), ids.select(*keys)
        if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
            raise StaleCache(f"{path} holds other ids or another order")
        if signature is not None and known is None:
            _stamp(spark, stamp, signature)
        return found
    compute().write.parquet(path)
    if signature is not None:
        _stamp(spark, stamp, signature)
    return spark.read.parquet(path)


def _stamp(spark: SparkSession, path: str, signature: str) -> None:
    spark.createDataFrame([(signature,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_diagnostics(root: str, tables: dict[str, DataFrame], facts: dict | None = None) -> None:
    """Small diagnostic tables as one CSV file each, rounded to four digits, and facts as one line of JSON."""
    for name, df in tables.items():
        rounded = df.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
        rounded.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{root.rstrip('/')}/{name}")
    if facts is not None:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/facts")


def export_sheets(sheets: dict[str, DataFrame], root: str, kind: str = "csv") -> None:
    """One folder a sheet, with a header."""
    for name, df in sheets.items():
        df.coalesce(1).write.mode("overwrite").option("header", "true").format(kind).save(f"{root.rstrip('/')}/{name}")


def migrate(df: DataFrame, root: str, place: list[str], dry_run: bool = True) -> DataFrame:
    """Rewrite a log into a layout by ``place``. Returns rows per destination; writes, and verifies every row, unless ``dry_run``."""
    plan = df.groupBy(*place).agg(F.count(F.lit(1)).alias("rows"))
    if not dry_run:
        df.write.mode("errorifexists").partitionBy(*place).parquet(root)
        back = df.sparkSession.read.schema(df.schema).parquet(root).select(*df.columns)
        if back.exceptAll(df).limit(1).count() or df.exceptAll(back).limit(1).count():
            raise ValueError("the rewritten rows differ from the source")
    return plan
