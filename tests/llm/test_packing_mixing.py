import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import mixing, packing
from tallyframe.llm.tokens import encoding, token_sizes


@pytest.mark.parametrize("seed", range(3))
def test_configurations_hold_all_items(seed):
    rng = random.Random(seed)
    hist = Counter(rng.randrange(65, 513) for _ in range(500))
    groups = packing.linear_groups(hist, 24)
    assert sum(n for _, n in groups) == 500 and [s for s, _ in groups] == sorted((s for s, _ in groups), reverse=True)
    plan = packing.configurations(groups, 512)
    for j, (_, n) in enumerate(groups):
        assert sum(p[j] * k for p, k in plan) >= n
    assert all(sum(a * s for a, (s, _) in zip(p, groups)) <= 512 for p, _ in plan)
    rows, made = packing.slot_plan(hist, groups, plan)
    load, seen = Counter(), Counter()
    for size, lo, hi, first, per, off in rows:
        for r in range(lo, hi):
            load[first + (r - lo + off) // per] += size
            seen[size] += 1
    assert seen == hist and max(load.values()) <= 512 and max(load) < made
    assert made <= 1.12 * sum(s * n for s, n in hist.items()) / 512 + 26


def test_best_fit_equals_item_by_item(seed=9):
    rng = random.Random(seed)
    room = Counter(rng.randrange(1, 200) for _ in range(60))
    small = Counter(rng.randrange(1, 65) for _ in range(300))
    free = {(r, i): r for r, n in room.items() for i in range(n)}
    opened = 0
    for size in sorted(small.elements(), reverse=True):
        fits = [k for k, v in free.items() if v >= size]
        if not fits:
            fits = [(-1, opened)]
            free[fits[0]] = 512
            opened += 1
        best = min(fits, key=lambda k: (free[k], k))
        free[best] -= size
    left = {(r, i): r for r, n in room.items() for i in range(n)}
    placed = Counter()
    for size, lo, hi, cls, first, per in packing.best_fit(dict(room), dict(small), 512):
        for q in range(lo, hi):
            key = (cls, first + (q - lo) // per)
            left[key] = left.get(key, 512) - size
            placed[size] += 1
    assert placed == small and min(left.values()) >= 0
    assert Counter(left.values()) == Counter(free.values())


def docs(spark, texts):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("k0", "len", "rank", "container", "c", "copy")})


def test_packing_is_whole(spark):
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(["sol", "casa", "perro", "noche"]) for _ in range(rng.choice([3, 20, 90, 250, 400, 900, 1500]))), "a") for _ in range(300)] + [(None, "a"), ("", "a")]
    df = docs(spark, texts)
    df = df.union(df.where("doc_id < 20"))
    out = packing.pack(df).collect()
    count = encoding().encode_ordinary
    load, by = Counter(), {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
        if r["container"]:
            load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 512
    for i, (t, _) in enumerate(texts):
        n, times = len(count(t or "")), 2 if i < 20 else 1
        assert sum(b - a for a, b in by[i]) == n * times
        if n <= 512:
            assert len(by[i]) == times
    assert len({(r["container"], r["position"]) for r in out if r["container"]}) == sum(1 for r in out if r["container"])
    report = packing.fill_report(packing.pack(df)).first()
    assert report["filled"] > 0.9


def test_packing_nothing(spark):
    assert packing.pack(docs(spark, [("x", "a")]).where("false")).count() == 0
    assert [r["container"] for r in packing.pack(docs(spark, [(None, "a")])).collect()] == [None]


def test_quotas_fill_up_to_the_caps():
    q = mixing.quotas({"a": 100, "b": 10, "c": 50}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 2, "c": 4}, 160)
    assert q["b"] == 20 and sum(q.values()) == pytest.approx(160) and q["a"] / q["c"] == pytest.approx(2.5)
    assert sum(mixing.quotas({"a": 10}, {"a": 1.0}, {"a": 2}, 100).values()) == 20


def test_mixture(spark):
    rng = random.Random(2)
    texts = [(" ".join(["palabra"] * rng.randrange(5, 60)), rng.choice("aaaaaaab")) for _ in range(800)] + [("fuera", None), ("fuera", "z"), (None, "a"), ("", "b")]
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs(spark, texts), targets, block_tokens=256)
    rows = mixture.collect()
    total = sum(len(encoding().encode_ordinary(t or "")) for t, _ in texts)
    size = Counter()
    for r in rows:
        size[r["source"]] += r["n_tokens"]
    have = Counter()
    for t, s in texts:
        have[s] += len(encoding().encode_ordinary(t or ""))
    want = mixing.quotas({"a": have["a"], "b": have["b"]}, {"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 1, "b": 2, "c": 3}, total)
    assert all(abs(size[s] - want[s]) <= 130 for s in "abc")
    copies = Counter((r["doc_id"], r["source"]) for r in rows)
    assert all(n <= {"a": 1, "b": 2}[s] for (_, s), n in copies.items())
    order = sorted(rows, key=lambda r: (r["slot"], r["place"]))
    half, seen = sum(size.values()) / 2, Counter()
    for r in order:
        if sum(seen.values()) < half:
            seen[r["source"]] += r["n_tokens"]
    assert abs(seen["b"] / sum(seen.values()) - size["b"] / sum(size.values())) < 0.05
    got = {r["source"]: r for r in report.collect()}
    assert got["c"]["actual_share"] == 0 and got["a"]["most_copies"] == 1 and sum(r["actual_share"] for r in got.values()) == pytest.approx(1, abs=1e-5)
    again = mixing.mix(docs(spark, texts).repartition(5), targets, block_tokens=256)[0]
    assert again.exceptAll(mixture).count() == 0


def test_empty_mixture(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs(spark, [("x", "a")]).where("false"), targets)
    assert mixture.count() == 0 and report.count() == 1
    assert mixing.mix(docs(spark, [("x", "a")]), targets.where("false"))[0].count() == 0


def test_token_sizes_count_whole_texts(spark):
    got = token_sizes(docs(spark, [("hola " * 5000, "a"), (None, "b")]), ["doc_id"]).collect()
    assert {r["k0"]: r["n_tokens"] for r in got} == {0: len(encoding().encode_ordinary("hola " * 5000)), 1: 0}
