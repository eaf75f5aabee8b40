"""Mix sources to target weights of the total size in tokens, with a low-discrepancy schedule.

Each source gets a quota of tokens: its target share, at most ``max_repeats`` times what it has; what capped sources
leave open goes to the others in proportion to their targets. A source's documents are shuffled by a hash, once a pass,
and cut into blocks of equal tokens. Slots run over the van der Corput sequence mapped through the cumulative weights
of the quotas; the k-th slot of a source takes its k-th block, so that every stretch of the mixture has nearly the
target shares.

Defined results: documents of a NULL source, of a source without a target, or without tokens never enter; a target
without documents gets share 0; where all sources together cannot reach the size, the mixture is as large as the caps
allow; repeated rows count as documents each; empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.tokens import TOKENIZER, token_sizes
from tallyframe.operators.ranking import bits_for
from tallyframe.session import materialise

MOST_SOURCES = 10_000


def quotas(have: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Water filling: tokens each source gives, so that caps hold and the open rest goes to the others by weight."""
    cap = {s: float(have.get(s, 0) * max(0, repeats[s])) for s in share}
    quota = dict.fromkeys(share, 0.0)
    free, left = {s for s in share if cap[s] > 0 and share[s] > 0}, float(total)
    while free and left > 1e-6:
        weight = sum(share[s] for s in free)
        full = {s for s in free if cap[s] - quota[s] <= left * share[s] / weight}
        if not full:
            for s in free:
                quota[s] += left * share[s] / weight
            break
        for s in full:
            left -= cap[s] - quota[s]
            quota[s] = cap[s]
        free -= full
    return quota


def _slots(spark, names: list[str], blocks: list[int], seed_bits: int = 40) -> DataFrame:
    """Columns source, block, slot: the k-th slot of each source, in the order of the sequence."""
    total = sum(blocks)
    edges, run = [], 0
    for b in blocks:
        run += b
        edges.append(run / total)
    point = F.conv(F.reverse(F.lpad(F.bin("id"), seed_bits, "0")), 2, 10).cast("double") / F.lit(float(2**seed_bits))
    slots = spark.range(total + 64).select(F.col("id").alias("slot"), point.alias("u"))
    which = F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]), lambda e: e <= F.col("u"))) if len(edges) > 1 else F.lit(0)
    slots = slots.select("slot", which.alias("s"), F.shiftright("slot", 12).alias("bucket"))
    sizes = slots.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("s").alias("os"), F.col("bucket").alias("ob"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    inside = F.row_number().over(Window.partitionBy("s", "bucket").orderBy("slot")) - 1
    ranked = slots.withColumn("r", inside).join(offsets, (F.col("s") == F.col("os")) & (F.col("bucket") == F.col("ob")))
    return ranked.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("s") + 1).alias("source"), (F.col("r") + F.col("o")).alias("block"), "slot")


def mix(
    docs: DataFrame,
    targets: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_tokens: int | None = None,
    seed: str = "mix",
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """The mixture (``slot``, ``place``, ``source``, ``ident``, ``copy``, ``n_tokens``) and the report of shares.

    Collected: one row for each target (at most 10,000, checked). Order the mixture by ``slot`` and ``place``. Blocks have
    ``block_tokens`` tokens or, where that is None, a 64th of the smallest quota, between 128 and 2048, so that a small source
    appears all along the mixture.
    """
    spark = docs.sparkSession
    wanted = targets.select(F.col("source").alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
    wanted = sorted(wanted, key=lambda r: r["source"])
    sizes = materialise(token_sizes(docs, [ident, source], text, tokenizer), "sizes")
    bits = bits_for(sizes.count())
    names = [r["source"] for r in wanted]
    weight = sum(r["w"] for r in wanted)
    share = {r["source"]: r["w"] / weight for r in wanted}
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    have = {r["k1"]: r["t"] for r in sizes.where(F.col("k1").isin(names)).groupBy("k1").agg(F.sum("n_tokens").alias("t")).collect()} if names else {}
    quota = quotas(have, share, {r["source"]: r["m"] or 0 for r in wanted}, total)
    used = [n for n in names if quota[n] > 0]
    block_tokens = block_tokens or int(min(2048, max(128, min((quota[n] for n in used), default=0) // 64)))
    schema = "ts string, quota double, have bigint, passes int"
    plan = spark.createDataFrame([(n, quota[n], have[n], int(-(-quota[n] // have[n]))) for n in used], schema)

    copies = sizes.where("n_tokens > 0").join(F.broadcast(plan), F.col("k1") == F.col("ts")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "copy", "k0")).withColumn("b", F.shiftright("h", 64 - bits))
    each = copies.groupBy("k1", "copy", "b").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("k1", "copy").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(F.col("k1").alias("os"), F.col("copy").alias("oc"), F.col("b").alias("ob"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("o"))
    inside = Window.partitionBy("k1", "copy", "b").orderBy("h", "k0", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = copies.withColumn("i", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, (F.col("k1") == F.col("os")) & (F.col("copy") == F.col("oc")) & (F.col("b") == F.col("ob")))
    start = (F.col("copy") - 1) * F.col("have") + F.col("o") + F.col("i")
    taken = at.withColumn("start", start).where(F.col("start") + F.col("n_tokens") / 2 <= F.col("quota"))
    taken = taken.select("k0", "k1", "copy", "n_tokens", "start", F.expr(f"start div {block_tokens}").alias("nr"))

    blocks = [int(quota[n] // block_tokens) + 1 for n in used]
    if used:
        slots = _slots(spark, used, blocks).withColumnRenamed("source", "ss")
        mixed = taken.join(slots, (F.col("k1") == F.col("ss")) & (F.col("nr") == F.col("block")), "left")
    else:
        mixed = taken.withColumn("slot", F.lit(None).cast("bigint"))
    late = F.lit(sum(blocks) + 64) + F.col("nr")
    mixture = mixed.select(F.coalesce("slot", late).alias("slot"), F.col("start").alias("place"), F.col("k1").alias("source"), F.col("k0").alias(ident), "copy", "n_tokens")
    goal = spark.createDataFrame([(n, share[n], quota[n] / total if total else 0.0) for n in names], "ts string, target_share double, allowed_share double")
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.max("copy").alias("most_copies"))
    whole = mixture.agg(F.sum("n_tokens").alias("whole"))
    report = goal.join(got, F.col("ts") == F.col("source"), "left").crossJoin(whole).select(
        F.col("ts").alias("source"), F.round("target_share", 6).alias("target_share"), F.round("allowed_share", 6).alias("allowed_share"), F.round(F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return mixture, report
