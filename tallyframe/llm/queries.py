"""Queries of the problems p1 to p8 on the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.splits import same_person_pairs

    return same_person_pairs(table(spark, sf, "predictions"), table(spark, sf, "transcription"))


def p1_persons(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.splits import person_of_values

    return person_of_values(table(spark, sf, "predictions"), table(spark, sf, "transcription"))


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.splits import assign_splits

    return assign_splits(table(spark, sf, "predictions"), table(spark, sf, "transcription"))


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.splits import split_shares

    return split_shares(p1_splits(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_top_runs(spark, sf).select("encoder", "target", "run_id")


def p2_top_runs(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.topn import top_n_by_group

    return top_n_by_group(table(spark, sf, "experiment_log"), ["encoder", "target"], "rmse", "logged_at", "run_id", 5)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.sentences import split_sentences

    return split_sentences(table(spark, sf, "transcription"), with_text=False).select("row_id", "sent_start", "sent_end")


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.sentences import split_sentences

    return split_sentences(table(spark, sf, "transcription"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_mentions(spark, sf).select("row_id", "kind", "char_start").distinct()


def p4_mentions(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.pii import find_mentions

    return find_mentions(table(spark, sf, "transcription"), table(spark, sf, "given_names"))


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.pii import redact

    return redact(table(spark, sf, "transcription"), table(spark, sf, "given_names"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).where(F.col("piece") == 1).select("row_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.chunking import split_oversized

    return split_oversized(table(spark, sf, "transcription"), limit=1200, overlap=100)


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.packing import pack

    return pack(table(spark, sf, "documents"), capacity=512)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.packing import fill_report

    return fill_report(p6_containers(spark, sf), 512)


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.mixing import mix

    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.mixing import mix

    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.langid import doubtful

    return doubtful(p8_segments(spark, sf))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.langid import fit_on, identify

    docs = table(spark, sf, "documents")
    return identify(docs, fit_on(docs)).distinct()


# Invariants: what must hold of a result whatever the models decide, as rows (what, n) that SQL can state from the tables alone.


def _facts(spark: SparkSession, *pairs) -> DataFrame:
    rows = [df.agg(n.cast("bigint").alias("n")).select(F.lit(what).alias("what"), F.coalesce("n", F.lit(0)).alias("n")) for what, df, n in pairs]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def _one():
    return F.count(F.lit(1))


def _some(test):
    return F.sum(F.when(test, 1).otherwise(0))


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.session import materialise

    got = materialise(p1_splits(spark, sf), "check")
    people = got.groupBy("person").agg(F.countDistinct("split").alias("s"))
    return _facts(spark, ("rows", got, F.sum("rows")), ("persons in two splits", people, _some(F.col("s") > 1)), ("values", got.where("participant is not null").select("participant").distinct(), _one()))


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.session import materialise

    got = materialise(p3_sentences(spark, sf), "check")
    per = got.groupBy("row_id").agg(F.max(F.struct("sentence", "sent_end")).alias("l"), _one().alias("n"))
    plain = F.char_length(F.regexp_replace("sent_text", r"[^\p{L}\p{N}]", ""))
    before = got.select("row_id", (F.col("sentence") + 1).alias("sentence"), F.col("sent_end").alias("was"))
    over = got.join(before, ["row_id", "sentence"]).where("was > sent_start")
    return _facts(
        spark, ("rows with sentences", per, _one()), ("letters and digits in sentences", got, F.sum(plain)), ("overlaps", over, _one()), ("white space at an end", got, _some(F.col("sent_text").rlike(r"(?U)^\s|\s$"))),
        ("length unlike places", got, _some(F.char_length("sent_text") != F.col("sent_end") - F.col("sent_start"))),
    )


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.session import materialise

    texts = table(spark, sf, "transcription").select("row_id", "text")
    got = materialise(p4_mentions(spark, sf).join(texts, "row_id"), "check")
    other = got.alias("a").join(got.alias("b"), F.expr("a.row_id = b.row_id and a.char_start < b.char_start and b.char_start < a.char_end"))
    redacted = materialise(p4_redacted(spark, sf), "check").join(texts, "row_id")
    clean = redacted.join(got.select("row_id").distinct(), "row_id", "left_anti")
    return _facts(
        spark, ("rows redacted", redacted, _one()), ("mentions unlike their places", got, _some(F.expr("substring(text, char_start + 1, char_end - char_start) <> mention"))), ("overlaps", other, _one()),
        ("texts without a mention that changed", clean, _some(~F.col("redacted").eqNullSafe(F.col("text")))), ("placeholders as mentions", got, _some(F.col("mention").rlike(r"^\[[A-Z_]+\]$"))),
    )


def p5_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.session import materialise

    got = materialise(p5_pieces(spark, sf), "check")
    ends = got.groupBy("row_id").agg(F.max("char_end").alias("e"), F.min("char_start").alias("s"))
    new = F.col("char_end") - F.col("char_start") - F.col("overlap")
    return _facts(
        spark, ("texts", ends, _one()), ("characters", ends, F.sum("e")), ("characters of pieces less overlaps", got, F.sum(new)), ("pieces over 1200", got, _some(F.char_length("text") > 1200)),
        ("later pieces without overlap", got, _some((F.col("piece") > 0) & (F.col("overlap") <= 0))), ("texts not from the start", ends, _some(F.col("s") > 0)),
    )


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.session import materialise

    got = materialise(p6_containers(spark, sf), "check")
    load = got.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("t"))
    docs = got.groupBy("doc_id").agg(F.min("token_start").alias("a"), F.max("token_end").alias("b"), F.sum("n_tokens").alias("n"), _one().alias("pieces"))
    return _facts(
        spark, ("documents", docs, _one()), ("containers over 512", load, _some(F.col("t") > 512)), ("documents with gaps", docs, _some((F.col("a") != 0) | (F.col("b") != F.col("n")))),
        ("small documents in pieces", docs, _some((F.col("n") <= 512) & (F.col("pieces") > 1))), ("places taken twice", got.where("container is not null").groupBy("container", "position").count(), _some(F.col("count") > 1)),
    )


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.mixing import mix
    from tallyframe.llm.tokens import token_sizes
    from tallyframe.session import materialise

    mixture, report = mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    # A document enters while at least half of it fits the quota, so a source misses its quota by half a document at most.
    total = token_sizes(table(spark, sf, "documents"), ["doc_id"]).agg(F.sum("n_tokens").alias("total"))
    got = materialise(mixture, "check")
    longest = got.groupBy(F.col("source").alias("ls")).agg(F.max("n_tokens").alias("longest"))
    shares = materialise(report.crossJoin(F.broadcast(total)).join(longest, F.col("source") == F.col("ls"), "left"), "check")
    caps = table(spark, sf, "mix_targets").select("source", "max_repeats")
    often = got.groupBy("source", "doc_id").agg(_one().alias("n")).join(caps, "source", "left")
    foreign = got.select("doc_id", F.col("source").alias("s")).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "left")
    return _facts(
        spark, ("sources", shares, _one()), ("documents too often", often, _some(F.col("max_repeats").isNull() | (F.col("n") > F.col("max_repeats")))), ("documents of another source", foreign, _some(~F.col("s").eqNullSafe(F.col("source")))),
        ("quotas missed by more than half a document", shares, _some(F.abs(F.col("tokens") - F.col("allowed_share") * F.col("total")) > F.coalesce("longest", F.lit(0)) / 2 + 1e-6 * F.col("total"))), ("places taken twice", got.groupBy("slot", "place", "source").count(), _some(F.col("count") > 1)),
    )


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    from tallyframe.llm.langid import LANGS
    from tallyframe.session import materialise

    got = materialise(p8_segments(spark, sf), "check")
    docs = table(spark, sf, "documents").select("doc_id", F.char_length("text").alias("chars"))
    before = got.select("doc_id", (F.col("segment") + 1).alias("segment"), F.col("char_end").alias("was"), F.col("seg_lang").alias("lang"))
    pairs = got.join(before, ["doc_id", "segment"])
    return _facts(
        spark, ("documents with a language", got.select("doc_id").distinct(), _one()), ("confidence outside 0 to 1", got, _some((F.col("confidence") < 0) | (F.col("confidence") > 1))), ("overlaps", pairs, _some(F.col("was") > F.col("char_start"))),
        ("neighbours of one language", pairs, _some(F.col("lang") == F.col("seg_lang"))), ("unknown languages", got, _some(~F.col("seg_lang").isin(LANGS))), ("segments outside the text", got.join(docs, "doc_id"), _some((F.col("char_start") < 0) | (F.col("char_end") > F.col("chars")))),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_persons, p1_splits, p1_shares, p2_found, p2_top_runs, p3_found, p3_sentences, p4_found, p4_mentions, p4_redacted, p5_found, p5_pieces, p6_containers, p6_fill, p7_mixture, p7_shares, p8_found, p8_segments, p1_checks, p3_checks, p4_checks, p5_checks, p6_checks, p7_checks, p8_checks)
}
