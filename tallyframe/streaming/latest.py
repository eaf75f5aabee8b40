"""Latest run per key and score windows over a growing log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.runs import RUN_KEY


def distinct_runs(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Runs once each, though lines may be logged twice up to ``late`` apart; older state is dropped."""
    return stream.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_id"])


def latest_state(stream: DataFrame, keys: list[str] = RUN_KEY, order: str = "run_id") -> DataFrame:
    """Running latest row a key, for update or complete mode; one row of state a key."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def score_windows(stream: DataFrame, length: str = "1 day", late: str | None = "2 hours") -> DataFrame:
    """Mean score and number of runs of each window of log time; lines later than ``late`` are left out (None: the stream has its watermark)."""
    seen = stream.withWatermark("logged_at", late) if late else stream
    return seen.groupBy(F.window("logged_at", length), "target").agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("runs"))
