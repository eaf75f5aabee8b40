import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import topn

SCHEMA = "run_id long, encoder string, target string, rmse double, logged_at timestamp"


def brute(rows, n):
    best = {}
    for i, e, t, s, at in rows:
        if None in (i, e, t, s) or not e.strip() or not t.strip() or not 0 <= s < float("inf"):
            continue
        key, line = (e.strip().lower(), t.strip().lower()), (s, at is None, at or datetime.min, i)
        best.setdefault(key, {})
        best[key][i] = min(best[key].get(i, line), line)
    return {(e, t, i, k + 1) for (e, t), found in best.items() for k, (_, _, _, i) in enumerate(sorted(found.values())[:n])}


def run(spark, rows, n=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("k0", "g", "s", "t", "place")})
    got = topn.top_n_by_group(df, ["encoder", "target"], "rmse", "logged_at", "run_id", n, **options)
    return {(r["encoder"], r["target"], r["run_id"], r["place"]) for r in got.collect()}


@pytest.mark.parametrize("row_group_bytes,files", [(4096, 3), (1 << 20, 1), (2048, 7)])
def test_against_brute_force(spark, row_group_bytes, files):
    rng = random.Random(row_group_bytes)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(4000):
        e = rng.choice(["Hot ", "hot", "HOT", *(f"e{k}" for k in range(40)), None, " "])
        s = rng.choice([None, float("nan"), float("inf"), -1.0, *([round(rng.random() * 5, 1)] * 9)])
        rows.append((i, e, rng.choice(["A", "b ", None]), s, rng.choice([None, start + timedelta(hours=rng.randrange(5))])))
    rows += rows[:300]
    assert run(spark, rows, row_group_bytes=row_group_bytes, files=files) == brute(rows, 5)


def test_one_id_with_two_lines_counts_with_its_best(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "a", "t", 3.0, at), (1, "a", "t", 1.0, at), (2, "a", "t", 2.0, at)]
    assert run(spark, rows, 2) == {("a", "t", 1, 1), ("a", "t", 2, 2)}


def test_empty(spark):
    assert run(spark, []) == set()


def test_statistics_rule_out_row_groups(spark, tmp_path):
    """A hot group of 60,000 runs over many row groups: nearly all are dropped unread, ties with the bound are kept."""
    df = spark.range(60_000).select(F.col("id").alias("run_id"), F.lit("hot").alias("encoder"), F.lit("t").alias("target"), (F.col("id") % 20_000 / 100.0).alias("rmse"), F.lit(None).cast("timestamp").alias("logged_at"))
    names, path = ["k0", "k1"], "file://" + str(tmp_path / "c")
    topn.cluster_by_group(topn.eligible(df, ["encoder", "target"], "rmse", "logged_at", "run_id"), names, path, 4, 16 * 1024)
    files = spark.createDataFrame([(p,) for p in topn._list_files(spark, path)], "path string")
    footers = files.mapInPandas(topn.read_footers(names), topn.FOOTER)
    kept = topn.plan_reading(footers, 5)
    assert footers.count() > 8 and kept.count() <= 3
