import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import splits as s
from tallyframe.llm.union_find import connected_components

VOCAB = [f"palabra{i}x" for i in range(400)]


def text(rng, n=80):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edit(rng, t, share):
    w = t.split()
    for i in rng.sample(range(len(w)), int(len(w) * share)):
        w[i] = rng.choice(VOCAB)
    return " ".join(w)


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("per_task", [10**6, 20])
def test_components_against_plain_union_find(spark, per_task):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)]
    df = spark.createDataFrame([*pairs, ("n1", None), ("n500", "n500")], "a string, b string")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b", per_task=per_task).collect()}
    assert got == components([*pairs, ("n500", "n500")])


@pytest.mark.parametrize("shape", ["chain", "star"])
def test_graphs_larger_than_a_task(spark, shape):
    """Neither a long chain nor a hot node needs a task that holds all of it."""
    ends = [(f"{i:03d}", f"{i + 1:03d}") if shape == "chain" else ("000", f"{i + 1:03d}") for i in range(120)]
    got = connected_components(spark.createDataFrame(ends, "a string, b string").repartition(4), "a", "b", per_task=30)
    assert {(r["node"], r["root"]) for r in got.collect()} == {(f"{i:03d}", "000") for i in range(121)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


@pytest.mark.parametrize("share,want", [(0.0, True), (0.05, True), (0.1, True), (0.13, False), (0.5, False)])
def test_same_but_few(share, want):
    rng = random.Random(1)
    a = list(range(100))
    b = a.copy()
    for i in rng.sample(range(100), int(share * 100)):
        b[i] = 1000 + i
    assert s.same_but_few(np.array(a, np.uint32), np.array(b, np.uint32), 0.1) is want
    assert s.same_but_few(np.array(a, np.uint32), np.array(a[::-1], np.uint32), 0.1) is False
    assert s.same_but_few(np.array(a, np.uint32), np.array(a[:60] + a[64:], np.uint32), 0.1) is True


def test_common_words_against_dynamic_programme():
    rng = random.Random(2)
    for _ in range(30):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert s.common_words(np.array(a), np.array(b)) == best[-1][-1]


@pytest.mark.parametrize("name,want", [("UTB_0001101", "UTB_1101"), ("data/UTB_0001101", "UTB_1101"), ("UTB_0001101_aug2", "UTB_1101"), ("utb 1101", "UTB_1101"), ("UNL0001101__aug1__Q03", "UNL_1101"), ("UTC-1101 ", "UTC_1101"), ("", None), ("x", None)])
def test_session_of(spark, name, want):
    assert spark.range(1).select(s.session_of(F.lit(name))).first()[0] == want


def answers(spark, rows):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "row_id long, participant string, text string")
    return df.withColumns({"rid": F.lit("clash"), "session": F.lit("clash"), "ids": F.lit(1), "key": F.lit(2)})


def test_links_against_brute_force(spark):
    """Recall and precision over all pairs, near-copies of up to one word in ten, a hot group of near-copies included."""
    rng = random.Random(3)
    rows, base = [], [text(rng) for _ in range(40)]
    for i, t in enumerate(base):
        rows.append((f"UTB_{i + 1:07d}", t))
        rows.append((f"UTC_{i + 1:07d}", edit(rng, t, rng.choice([0.0, 0.03, 0.06, 0.1, 0.3]))))
    hot = text(rng)
    rows += [(f"UNL_{i + 1:07d}", edit(rng, hot, 0.04)) for i in range(60)]
    rows += [("UTB_0000900", None), ("UTB_0000901", ""), (None, base[0]), ("UTB_0000902", base[1][:200])]
    words = [np.array([hash(w) & 0xFFFFFFFF for w in s.words_of(t)], np.uint32) if t and p and len(t) >= 300 else None for p, t in rows]
    name = lambda p: p[:3] + "_" + str(int(p[4:]))
    true = [(name(rows[i][0]), name(rows[j][0])) for i in range(len(rows)) for j in range(i) if words[i] is not None and words[j] is not None and s.same_but_few(words[i], words[j], 0.1)]
    got = s.link_sessions(answers(spark, rows))
    found = {r["node"]: r["root"] for r in connected_components(got, "session_a", "session_b").collect()}
    assert found == components(true)


def test_known_sites_anywhere(spark):
    sites = s.known_sites(spark.createDataFrame([("UTB_001",), ("abc 7",), ("x/UTC_1",), (None,), ("fold1_UTB_001",)], "participant string"))
    assert sites == ["ABC", "UTB"]
    df = spark.createDataFrame([("fold2_UTB_0012",), ("aug1 utb-12",), ("SESA_012",), ("data/PARTO-3",), ("abc7",)], "n string")
    assert [r[0] for r in df.select(s.session_of(F.col("n"), sites)).collect()] == ["UTB_12", "UTB_12", "SESA_12", "PARTO_3", "ABC_7"]


def test_crowded_bucket_without_links(spark):
    """Many answers on one form, with more than one word in ten filled in: few pairs are compared, and the links among them are found."""
    rng = random.Random(8)
    form = [rng.choice(VOCAB) for _ in range(80)]

    def filled():
        w = form.copy()
        for i in range(0, 80, 6):
            w[i] = f"relleno{rng.randrange(10**6)}"
        return w

    rows = [(f"UTB_{i + 1:07d}", " ".join(filled())) for i in range(1500)]
    twin = filled()
    rows += [("UTC_0000001", " ".join(twin)), ("UTC_0000002", " ".join([*twin[:-3], "uno", "dos", "tres"]))]
    got = s.link_sessions(answers(spark, rows))
    assert {tuple(sorted(r)) for r in got.collect()} == {("UTC_1", "UTC_2")}


def test_rare_words_meet_in_every_link(spark):
    """The prefix filter against all pairs."""
    rng = random.Random(12)
    base = [text(rng, rng.choice([40, 60, 90])) for _ in range(12)]
    texts = [edit(rng, t, x) for t in base for x in (0, 0.05, 0.1, 0.1, 0.3)]
    texts += [" ".join(t.split()[:-3]) for t in base]
    ids = [np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint32) for t in texts]
    docs = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(ids)], "rid long, ids binary")
    got = {tuple(r) for r in s._apart(docs.select(F.lit(1).alias("key"), "rid", F.col("rid").alias("part")), docs, 0.1).collect()}
    assert {(i, j) for j in range(len(ids)) for i in range(j) if s.same_but_few(ids[i], ids[j], 0.1)} <= got


def test_pairs_of_one_person(spark):
    rng = random.Random(5)
    t = text(rng)
    a = answers(spark, [("UTB_0000001", t), ("UTC_0000001", edit(rng, t, 0.05).upper()), ("UNL_0000003", text(rng)), ("UNL_0000003", text(rng))])
    p = spark.createDataFrame([("UTB_0000001",), ("utb 1",), ("UTC_0000001__Q01",), ("UNL_0000003",), ("UNL_0000003",), (None,), ("odd",)], "participant string")
    got = {tuple(r) for r in s.same_person_pairs(p, a).collect()}
    assert got == {("UTB_0000001", "UTC_0000001__Q01"), ("UTB_0000001", "utb 1"), ("UTC_0000001__Q01", "utb 1")}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_is_close_to_targets_and_whole(seed):
    rng = random.Random(seed)
    sizes = {k: n for k, n in zip(rng.sample(range(1, 60), 12), [rng.randrange(1, 80) for _ in range(12)])}
    sizes[600] = 1
    shares = [0.7, 0.15, 0.15]
    plan = s.greedy_shares(list(sizes.items()), shares)
    total, got = sum(k * n for k, n in sizes.items()), [0, 0, 0]
    for size, n in sizes.items():
        parts = sorted((a, b) for k, _, a, b in plan if k == size)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
    for size, k, a, b in plan:
        got[k] += size * (b - a)
    assert all(abs(g / total - w) < 0.02 for g, w in zip(got, shares))


def test_assigned_splits_keep_persons_whole(spark):
    p = spark.createDataFrame([(f"UTB_{i % 50:07d}{'__Q01' if i % 3 else ''}",) for i in range(600)] + [(None,)] * 5, "participant string")
    a = answers(spark, [(f"UTB_{i:07d}", "corto") for i in range(50)])
    got = s.assign_splits(p, a)
    assert got.groupBy("person").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert got.agg(F.sum("rows")).first()[0] == 655
    assert {r["split"]: abs(r["share"] - {"train": 0.7, "validation": 0.15, "test": 0.15}[r["split"]]) < 0.03 for r in s.split_shares(got).collect()} == dict.fromkeys(("train", "validation", "test"), True)


def test_empty_tables(spark):
    p, a = spark.createDataFrame([], "participant string"), answers(spark, [("UTB_1", "x")]).where("false")
    assert s.same_person_pairs(p, a).count() == 0
    assert s.assign_splits(p, a).count() == 0
