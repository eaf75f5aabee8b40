"""Fill containers of fixed capacity with whole texts, by linear grouping and best fit.

1. Only the histogram of lengths (at most ``capacity`` entries) reaches the driver. Large items, longest first, are cut
   into groups of equal cardinality and each length is rounded up to the largest of its group.
2. Configurations (multisets of the few rounded sizes that fit) are optimised as a linear programme by column
   generation; whole parts of the solution are taken, the remainder is packed first-fit.
3. Actual items take the slots of their group by rank, which are joins on small plans, never one task.
4. Small items go by best fit, longest first, into the room really left: containers of equal room and items of equal
   length are interchangeable, so this exact best fit runs over two histograms and is realised by ranks again.

Defined results: NULL and empty texts have no tokens and come out with a NULL container; a text larger than the
capacity is cut into full containers and one rest that is packed like a small text; repeated rows are items each; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.tokens import TOKENIZER, token_sizes
from tallyframe.operators.ranking import bits_for, class_rank
from tallyframe.session import materialise


def linear_groups(histogram: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(rounded size, number of items), largest first, of equal cardinality; groups of one rounded size are merged."""
    total = sum(histogram.values())
    each = max(1, -(-total // groups))
    out: list[list[int]] = []
    room = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if room == 0:
                room = each
                if not out or out[-1][0] != size:
                    out.append([size, 0])
            take = min(room, left)
            out[-1][1] += take
            room -= take
            left -= take
    return [(s, n) for s, n in out]


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over integer sizes."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        gain = best[c - sizes[fits]] + value[fits]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = gain[k], fits[k]
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c > 0:
        if pick[c] < 0 or best[c] <= best[c - 1] + 1e-12:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), pattern


def configurations(groups: list[tuple[int, int]], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """(items of each group in a container, number of such containers) that hold all items."""
    if not groups:
        return []
    sizes = np.array([s for s, _ in groups])
    demand = np.array([n for _, n in groups], dtype=float)
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    amount = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = np.ones(m) @ inverse
        worth, pattern = _best_pattern(sizes, price, capacity)
        if worth <= 1 + 1e-9:
            break
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        amount = np.maximum(amount - step * change, 0)
        amount[leave] = step
        basis[:, leave] = pattern
    plan = []
    left = demand.astype(np.int64)
    for k in range(m):
        pattern = basis[:, k].astype(np.int64)
        count = int(amount[k] + 1e-9)
        if count and pattern.sum():
            plan.append((pattern.tolist(), count))
            left -= pattern * count
    left = np.maximum(left, 0)
    while left.sum():
        pattern, room = np.zeros(m, dtype=np.int64), capacity
        for j in range(m):
            pattern[j] = min(left[j], room // sizes[j])
            room -= int(pattern[j] * sizes[j])
        count = int(min(left[j] // pattern[j] for j in range(m) if pattern[j]))
        plan.append((pattern.tolist(), count))
        left -= pattern * count
    return plan


def slot_plan(histogram: dict[int, int], groups: list[tuple[int, int]], plan: list[tuple[list[int], int]]) -> tuple[list[tuple], int]:
    """Rows (length, first rank in the length, end rank, first container, items a container, offset), and the number of containers."""
    rows, start, first = [], [], 0
    for pattern, count in plan:
        start.append(first)
        first += count
    ranges, at = [], 0
    for j, (_, n) in enumerate(groups):
        end = at + n
        for (pattern, count), container in zip(plan, start):
            if pattern[j] and at < end:
                take = min(pattern[j] * count, end - at)
                ranges.append((at, at + take, container, pattern[j]))
                at += take
    offset, k = 0, 0
    for size in sorted(histogram, reverse=True):
        end = offset + histogram[size]
        while k < len(ranges) and ranges[k][1] <= offset:
            k += 1
        i = k
        while i < len(ranges) and ranges[i][0] < end:
            lo, hi, container, per = ranges[i]
            a, b = max(lo, offset), min(hi, end)
            rows.append((size, a - offset, b - offset, container, per, a - lo))
            i += 1
        offset = end
    return rows, first


def best_fit(room: dict[int, int], small: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over histograms: rows (length, first rank, end rank, room class, first container rank, items a container).

    Room class -1 stands for containers opened here, ranked from 0.
    """
    by: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    for r, n in room.items():
        if 0 < r <= capacity:
            by[r].append((r, 0, n))
    plan, opened = [], 0
    for size in sorted(small, reverse=True):
        left, done, r = small[size], 0, size
        while left:
            while r <= capacity and not by[r]:
                r += 1
            if r > capacity:
                count = -(-left // (capacity // size))
                by[capacity].append((-1, opened, opened + count))
                opened += count
                r = capacity
            cls, lo, hi = by[r].pop()
            per = r // size
            full = min(hi - lo, left // per)
            if full:
                plan.append((size, done, done + full * per, cls, lo, per))
                by[r - per * size].append((cls, lo, lo + full))
                done, left, lo = done + full * per, left - full * per, lo + full
            if left and lo < hi:
                plan.append((size, done, done + left, cls, lo, left))
                by[r - left * size].append((cls, lo, lo + 1))
                lo, left = lo + 1, 0
            if lo < hi:
                by[r].append((cls, lo, hi))
    return plan


def _collect_histogram(df: DataFrame, column: str) -> dict[int, int]:
    return {r[column]: r["n"] for r in df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(
    df: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    capacity: int = 512,
    groups: int = 48,
    small_share: float = 0.125,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """Columns ``container``, ``position``, ``ident``, ``token_start``, ``token_end``, ``n_tokens``.

    Collected: two histograms of at most ``capacity`` entries. Broadcast: their plans, of a few thousand rows at most
    for any number of items.
    """
    spark = df.sparkSession
    sizes = materialise(token_sizes(df, [ident], text, tokenizer), "sizes")
    cap, bits = F.lit(capacity), bits_for(sizes.count())
    none = sizes.where("n_tokens = 0").select(F.lit(None).cast("string").alias("container"), F.lit(0).alias("position"), "k0", F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("token_end"))
    over = class_rank(sizes.where(F.col("n_tokens") > capacity).withColumn("pieces", F.expr(f"n_tokens div {capacity}")), ["pieces"], ["k0"], bits=bits)
    full = over.select("k0", "pieces", "rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("p")).select(
        F.concat_ws(":", F.lit("full"), "pieces", "rank", "p").alias("container"), F.lit(1).alias("position"), "k0", (F.col("p") * cap).alias("token_start"), ((F.col("p") + 1) * cap).alias("token_end")
    )
    items = sizes.where("n_tokens > 0").withColumn("token_start", F.when(F.col("n_tokens") > capacity, F.expr(f"n_tokens div {capacity}") * cap).otherwise(F.lit(0)).cast("bigint"))
    items = items.withColumn("len", (F.col("n_tokens") - F.col("token_start")).cast("int")).where("len > 0")
    ranked = materialise(class_rank(items, ["len"], ["k0", "token_start"], bits=bits), "ranked")
    histogram = _collect_histogram(ranked, "len")
    edge = int(capacity * small_share)
    large = {s: n for s, n in histogram.items() if s > edge}
    small = {s: n for s, n in histogram.items() if s <= edge}

    grouped = linear_groups(large, groups)
    slots, made = slot_plan(large, grouped, configurations(grouped, capacity))
    slot_rows = spark.createDataFrame(slots, "plen int, lo bigint, hi bigint, first bigint, per int, off bigint")
    on = (F.col("len") == F.col("plen")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = ranked.where(F.col("len") > edge).join(F.broadcast(slot_rows), on).select((F.col("first") + F.expr("(rank - lo + off) div per")).alias("c"), "k0", "token_start", "len")
    placed = materialise(placed, "large")

    room = placed.groupBy("c").agg((cap - F.sum("len")).cast("int").alias("room")).where("room > 0")
    ranked_room = materialise(class_rank(room, ["room"], ["c"], out="crank", bits=bits), "room")
    fit = best_fit(_collect_histogram(ranked_room, "room"), small, capacity)
    fit_rows = spark.createDataFrame(fit, "plen int, lo bigint, hi bigint, cls int, first bigint, per int")
    little = ranked.where(F.col("len") <= edge).join(F.broadcast(fit_rows), on).select("k0", "token_start", "len", "cls", (F.col("first") + F.expr("(rank - lo) div per")).alias("want"))
    into = little.where("cls >= 0").join(ranked_room, (F.col("cls") == F.col("room")) & (F.col("want") == F.col("crank"))).select("c", "k0", "token_start", "len")
    opened = little.where("cls < 0").select((F.col("want") + F.lit(made)).alias("c"), "k0", "token_start", "len")
    position = F.row_number().over(Window.partitionBy("c").orderBy(F.col("len").desc(), "k0", "token_start"))
    shared = placed.select("c", "k0", "token_start", "len").union(into).union(opened).select(
        F.concat(F.lit("mix:"), F.col("c").cast("string")).alias("container"), position.alias("position"), "k0", "token_start", (F.col("token_start") + F.col("len")).alias("token_end")
    )
    out = full.union(shared).union(none)
    return out.select("container", "position", F.col("k0").alias(ident), "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("n_tokens"))


def fill_report(packed: DataFrame, capacity: int = 512) -> DataFrame:
    """Containers, tokens, the least number of containers any packing needs, and the share of room that is filled."""
    each = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")).select(
        "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.lit(capacity)).cast("bigint").alias("least_containers"), F.round(F.try_divide(F.col("tokens"), F.col("containers") * F.lit(capacity)), 6).alias("filled")
    )
