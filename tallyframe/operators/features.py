"""Named text features in a registry with a fixed order.

A block is a function from the columns of an annotated answer to an ordered mapping of feature name to column. Annotated
answers have ``text`` (placeholders stripped), ``tokens`` (array of struct form, lemma, pos, morph map, is_alpha, sent)
and ``n_sentences``. ``annotate`` builds that table with rules only: it knows no parts of speech, so blocks that need them
refuse to run on it instead of reporting zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import lexicons as lex
from tallyframe.functions import text as tx

VERSION = "lexical-v1"
TOKEN = "array<struct<form:string,lemma:string,pos:string,morph:map<string,string>,is_alpha:boolean,sent:int>>"


class NeedsTags(ValueError):
    """The answers carry no parts of speech."""


@dataclass(frozen=True)
class Block:
    name: str
    features: tuple[str, ...]
    build: Callable[[], dict[str, Column]]
    tags: bool


REGISTRY: dict[str, Block] = {}


def block(name: str, features: list[str], tags: bool):
    def register(build: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
        REGISTRY[name] = Block(name, tuple(features), build, tags)
        return build

    return register


def _alpha() -> Column:
    """The alphabetic tokens with folded form ``ff`` and lemma ``fl``, made once an answer by ``extract``."""
    return F.col("__alpha")


def _folded_tokens() -> Column:
    alpha = F.filter(F.col("tokens"), lambda t: t["is_alpha"])
    fields = ("form", "lemma", "pos", "morph", "sent")
    return F.transform(alpha, lambda t: F.struct(*[t[f].alias(f) for f in fields], tx.fold(t["form"]).alias("ff"), tx.fold(t["lemma"]).alias("fl")))


def _hits() -> Column:
    """Symptom group ``g`` and lemma ``l`` of the tokens that have one."""
    groups = F.transform(_alpha(), lambda t: F.struct(subscale_of(t["ff"], t["fl"], t["pos"], folded=True).alias("g"), t["fl"].alias("l")))
    return F.filter(groups, lambda g: g["g"].isNotNull())


def _n() -> Column:
    return F.size(_alpha())


def _count(test: Callable[[Column], Column], alpha: bool = True) -> Column:
    return F.size(F.filter(_alpha() if alpha else F.col("tokens"), lambda t: F.coalesce(test(t), F.lit(False))))


def _rate(count: Column) -> Column:
    return tx.rate(count, _n())


def _lemmas() -> Column:
    """The folded lemmas, a column of their own: windows over them must not make them again."""
    return F.col("__lemmas")


def _listed(t: Column, terms: tuple[str, ...], lemma: bool = True) -> Column:
    known = sorted({tx.fold_word(w) for w in terms})
    form = t["ff"].isin(known)
    return (form | F.coalesce(t["fl"].isin(known), F.lit(False))) if lemma else form


def _morph(t: Column, key: str, value: str) -> Column:
    return F.coalesce(t["morph"][key], F.lit("")) == value


def _person(t: Column) -> Column:
    """Grammatical person of finite verbs and pronouns."""
    return F.when((t["pos"] == "PRON") | _morph(t, "VerbForm", "Fin"), t["morph"]["Person"])


@block("person", ["fps_verb_rate", "fps_pron_rate", "fps_explicit_ratio", "fpp_rate", "sps_rate", "tps_rate", "self_other_ratio"], tags=True)
def person() -> dict[str, Column]:
    first = lambda t: (_person(t) == "1") & _morph(t, "Number", "Sing")
    pron = lambda t: t["pos"] == "PRON"
    verbs, prons = _count(lambda t: first(t) & ~pron(t), False), _count(lambda t: first(t) & pron(t), False)
    explicit = _count(lambda t: first(t) & pron(t) & _morph(t, "Case", "Nom"), False)
    plural = _count(lambda t: (_person(t) == "1") & ~_morph(t, "Number", "Sing"), False)
    second, third = _count(lambda t: _person(t) == "2", False), _count(lambda t: _person(t) == "3", False)
    return {
        "fps_verb_rate": _rate(verbs), "fps_pron_rate": _rate(prons), "fps_explicit_ratio": tx.ratio(explicit, verbs), "fpp_rate": _rate(plural), "sps_rate": _rate(second), "tps_rate": _rate(third),
        "self_other_ratio": tx.ratio(verbs + prons, verbs + prons + second + third),
    }


@block("negation", ["negation_rate", "absolutist_rate", "absolutist_coverage", "neg_per_sentence"], tags=False)
def negation() -> dict[str, Column]:
    negated = _count(lambda t: _morph(t, "Polarity", "Neg") | _listed(t, lex.NEGATION))
    hits = F.filter(_alpha(), lambda t: _listed(t, lex.ABSOLUTIST))
    seen = F.size(F.array_distinct(F.transform(hits, lambda t: t["fl"])))
    return {"negation_rate": _rate(negated), "absolutist_rate": _rate(F.size(hits)), "absolutist_coverage": tx.ratio(seen, F.lit(len(lex.ABSOLUTIST))), "neg_per_sentence": tx.ratio(negated, F.col("n_sentences"))}


def _subscale_map() -> Column:
    pairs = {tx.fold_word(t): name for table in (lex.SUBSCALES, lex.INFLECTIONS) for name, terms in table.items() for t in terms}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def subscale_of(form: Column, lemma: Column, pos: Column, folded: bool = False) -> Column:
    """Symptom group of a token: lemma, first word of a lemma of several words, form; a homograph of the wrong part of speech passes on to the next."""
    table, terms = _subscale_map(), {tx.fold_word(t) for part in (lex.SUBSCALES, lex.INFLECTIONS) for group in part.values() for t in group}
    allowed: dict[tuple[str, ...], list[str]] = {}
    for w, tags in lex.PARTS_OF_SPEECH.items():
        allowed.setdefault(tags, []).append(tx.fold_word(w))

    def lookup(word: Column) -> Column:
        w = word if folded else tx.fold(word)
        wrong = F.lit(False)
        for tags, words in allowed.items():
            wrong = wrong | (w.isin(words) & ~F.coalesce(pos.isin(*tags), F.lit(False)))
        # Membership is a hash lookup; only words that are in the map are looked for in it.
        return F.when(w.isin(sorted(terms)) & ~wrong, table[w])

    return F.coalesce(lookup(lemma), F.when(lemma.contains(" "), lookup(F.substring_index(lemma, " ", 1))), lookup(form))


def is_clinical(form: Column, lemma: Column | None = None) -> Column:
    """Whether the form or the lemma is a term of the lexicon itself; inflections and parts of speech do not count."""
    terms = sorted({tx.fold_word(t) for group in lex.SUBSCALES.values() for t in group})
    hit = F.coalesce(tx.fold(form).isin(terms), F.lit(False))
    return hit if lemma is None else hit | F.coalesce(tx.fold(lemma).isin(terms), F.lit(False))


@block("clinical", [*(f"clin_{n}" for n in lex.SUBSCALES), "clin_total_rate", "clin_coverage"], tags=True)
def clinical() -> dict[str, Column]:
    hits = F.col("__hits")
    terms = len({t for group in lex.SUBSCALES.values() for t in group})
    in_group = lambda n: F.size(F.filter(hits, lambda g: g["g"] == n))
    out = {f"clin_{n}": _rate(in_group(n)) for n in lex.SUBSCALES}
    return out | {"clin_total_rate": _rate(F.size(hits)), "clin_coverage": tx.ratio(F.size(F.array_distinct(F.transform(hits, lambda g: g["l"]))), F.lit(terms))}


@block("morphosyntax", ["pos_pron_rate", "pos_verb_rate", "pos_adj_rate", "pos_adv_rate", "pos_noun_rate", "pos_conj_rate", "tense_past_rate", "tense_pres_rate", "tense_fut_rate", "mood_subjunctive_rate", "modal_rate", "intensifier_rate"], tags=True)
def morphosyntax() -> dict[str, Column]:
    pos = lambda *p: _rate(_count(lambda t: t["pos"].isin(*p)))
    finite = lambda key, value: _rate(_count(lambda t: _morph(t, "VerbForm", "Fin") & _morph(t, key, value)))
    modal = _count(lambda t: t["fl"].isin(sorted({tx.fold_word(w) for w in lex.MODALS}))) + tx.phrase_count(F.col("text"), lex.MODAL_PHRASES)
    return {
        "pos_pron_rate": pos("PRON"), "pos_verb_rate": pos("VERB", "AUX"), "pos_adj_rate": pos("ADJ"), "pos_adv_rate": pos("ADV"), "pos_noun_rate": pos("NOUN"), "pos_conj_rate": pos("CCONJ", "SCONJ"),
        "tense_past_rate": finite("Tense", "Past"), "tense_pres_rate": finite("Tense", "Pres"), "tense_fut_rate": finite("Tense", "Fut"), "mood_subjunctive_rate": finite("Mood", "Sub"),
        "modal_rate": _rate(modal), "intensifier_rate": _rate(_count(lambda t: _listed(t, lex.INTENSIFIERS, lemma=False))),
    }


@block("richness", ["mattr_50", "mtld", "hapax_rate", "mean_word_len", "lexical_density", "fernandez_huerta"], tags=True)
def richness() -> dict[str, Column]:
    lemmas = _lemmas()
    add = lambda s, x: s + x
    syllables = F.aggregate(F.transform(_alpha(), lambda t: tx.syllables(t["form"])), F.lit(0), add)
    chars = F.aggregate(F.transform(_alpha(), lambda t: F.char_length(t["form"])), F.lit(0), add)
    return {
        "mattr_50": tx.mattr(lemmas), "mtld": tx.mtld(lemmas), "hapax_rate": tx.ratio(F.when(F.size(lemmas) > 0, tx.hapax(lemmas)).otherwise(0), _n()), "mean_word_len": tx.ratio(chars, _n()),
        "lexical_density": tx.ratio(_count(lambda t: t["pos"].isin(*lex.DENSITY_POS)), _n()), "fernandez_huerta": tx.readability(syllables, _n(), F.col("n_sentences")),
    }


def _sentence_lengths() -> tuple[Column, Column]:
    """Mean and population deviation of the words in a sentence, from one fold: tokens come in the order of their sentences."""
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("n"), F.lit(0.0).alias("squares"))

    def step(a: Column, t: Column) -> Column:
        same = a["at"] == t["sent"]
        return F.struct(t["sent"].alias("at"), F.when(same, a["n"] + 1).otherwise(1.0).alias("n"), F.when(same, a["squares"]).otherwise(a["squares"] + a["n"] * a["n"]).alias("squares"))

    squares = F.aggregate(_alpha(), zero, step, lambda a: a["squares"] + a["n"] * a["n"])
    mean = _n() / F.col("n_sentences")
    return mean, F.sqrt(F.greatest(F.lit(0.0), squares / F.col("n_sentences") - mean * mean))


@block("discourse", ["discourse_marker_rate", "hesitation_rate", "repetition_rate", "mean_sentence_len", "sentence_len_sd"], tags=False)
def discourse() -> dict[str, Column]:
    markers = _count(lambda t: _listed(t, lex.MARKERS, lemma=False)) + tx.phrase_count(F.col("text"), lex.MARKER_PHRASES)
    mean, spread = _sentence_lengths()
    return {"discourse_marker_rate": _rate(markers), "hesitation_rate": _rate(tx.ellipses(F.col("text"))), "repetition_rate": _rate(tx.adjacent_repeats(_lemmas())), "mean_sentence_len": mean, "sentence_len_sd": spread}


SETS = {"lexical": ("person", "negation", "clinical", "morphosyntax", "richness", "discourse")}
SPREAD = {"lexical": ("fps_verb_rate", "negation_rate", "clin_total_rate", "mattr_50", "mean_sentence_len"), "affect": ("val_mean", "aro_mean", "emo_fear_mean", "emo_sadness_mean")}
AFFECT = (
    "val_mean", "val_sd", "val_min", "val_p05", "val_low_rate", "val_high_rate", "aro_mean", "aro_max", "aro_high_rate", *(f"emo_{e}_{s}" for e in lex.EMOTIONS for s in ("mean", "max")), "affect_coverage", "emo_coverage",
)


def feature_names(name: str = "lexical") -> list[str]:
    """The features of a set in their fixed order: ``lexical``, ``affect``, ``lexical-affect``."""
    out: list[str] = []
    for part in name.split("-"):
        out += list(AFFECT) if part == "affect" else [f for b in SETS[part] for f in REGISTRY[b].features]
    return out


def annotate(df: DataFrame, text: str) -> DataFrame:
    """Rule annotation: letters make words, the lemma is the lower-cased form, sentences end at end marks; no tags."""
    plain = tx.strip_placeholders(F.coalesce(F.col(text), F.lit("")))
    sents = F.filter(F.split(plain, r"(?<=[.!?…])\s+|\n+"), lambda s: F.trim(s) != "")
    found = F.flatten(F.transform(sents, lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(r"([\p{L}\p{M}]+)"), 1), lambda w: F.struct(
        w.alias("form"), F.lower(w).alias("lemma"), F.lit(None).cast("string").alias("pos"), F.lit(None).cast("map<string,string>").alias("morph"), F.lit(True).alias("is_alpha"), i.cast("int").alias("sent")
    ))))
    return df.withColumns({"text": plain, "tokens": found.cast(TOKEN), "n_sentences": F.greatest(F.size(sents), F.lit(1))})


def extract(annotated: DataFrame, blocks: tuple[str, ...] = SETS["lexical"], keep: list[str] | None = None) -> DataFrame:
    """``keep`` and the features of the blocks, in registry order. Never NULL or NaN, also on empty texts."""
    if any(REGISTRY[b].tags for b in blocks):
        untagged = F.size(F.filter("tokens", lambda t: t["is_alpha"] & t["pos"].isNull())) > 0
        if annotated.where(untagged).limit(1).count():
            raise NeedsTags(f"blocks {blocks} need parts of speech; supply an annotator")
    columns = {}
    for b in blocks:
        made = REGISTRY[b].build()
        if tuple(made) != REGISTRY[b].features:
            raise ValueError(f"block {b} does not keep its declared order")
        columns |= made
    # Arrays that many features read are columns of their own, made once an answer.
    prepared = annotated.withColumn("__alpha", _folded_tokens())
    prepared = prepared.withColumn("__lemmas", F.transform(_alpha(), lambda t: t["fl"]))
    if "clinical" in blocks:
        prepared = prepared.withColumn("__hits", _hits())
    return prepared.select(*(keep or []), *[F.coalesce(c, F.lit(0.0)).cast("double").alias(n) for n, c in columns.items()])


def affect(annotated: DataFrame, norms: DataFrame, keep: list[str]) -> DataFrame:
    """The 21 affect features per answer. ``norms``: key, valence, arousal, five emotions, dominant_pos (any may be NULL).

    Tokens are looked up by join, lemma before form; the norms are broadcast only if Spark finds them small enough.
    """
    token = annotated.select(*keep, F.explode_outer(F.filter("tokens", lambda t: t["is_alpha"] & t["pos"].isin(*lex.AFFECT_POS))).alias("t"))
    base = token.select(*keep, F.col("t.pos").alias("pos"), tx.fold(F.col("t.lemma")).alias("kl"), tx.fold(F.col("t.form")).alias("kf"))
    fields = ["valence", "arousal", "dominant_pos", *lex.EMOTIONS]
    side = lambda a: norms.select(F.col("key").alias(f"{a}_key"), *[F.col(f).alias(f"{a}_{f}") for f in fields])
    both = base.join(side("l"), F.col("kl") == F.col("l_key"), "left").join(side("f"), F.col("kf") == F.col("f_key"), "left")
    named = F.create_map(*[F.lit(x) for p in lex.NORM_POS.items() for x in p])[F.coalesce("l_dominant_pos", "f_dominant_pos")]
    agrees = F.coalesce(named == F.col("pos"), F.lit(True))
    val, aro = F.when(agrees, F.coalesce("l_valence", "f_valence")), F.when(agrees, F.coalesce("l_arousal", "f_arousal"))
    emo = {e: F.when(agrees, F.when(F.col("l_fear").isNotNull(), F.col(f"l_{e}")).otherwise(F.col(f"f_{e}"))) for e in lex.EMOTIONS}
    rated = both.select(*keep, F.col("pos").isNotNull().alias("content"), val.alias("v"), aro.alias("a"), *[c.alias(e) for e, c in emo.items()])
    content = F.sum(F.col("content").cast("int"))
    share = lambda c, over: F.coalesce(F.try_divide(F.sum(c.cast("double")), F.count(over)), F.lit(0.0))
    neutral = lambda c, x: F.coalesce(c, F.lit(x))
    v = F.col("v")
    stats = {
        "val_mean": neutral(F.avg("v"), lex.VALENCE_NEUTRAL), "val_sd": neutral(F.stddev_pop("v"), 0.0), "val_min": neutral(F.min("v"), lex.VALENCE_NEUTRAL), "val_p05": neutral(F.percentile("v", F.lit(0.05)), lex.VALENCE_NEUTRAL),
        "val_low_rate": share(v < lex.VALENCE_LOW, "v"), "val_high_rate": share(v > lex.VALENCE_HIGH, "v"), "aro_mean": neutral(F.avg("a"), lex.AROUSAL_NEUTRAL), "aro_max": neutral(F.max("a"), lex.AROUSAL_NEUTRAL), "aro_high_rate": share(F.col("a") > lex.AROUSAL_HIGH, "a"),
    }
    for e in lex.EMOTIONS:
        stats |= {f"emo_{e}_mean": neutral(F.avg(e), lex.EMOTION_NEUTRAL), f"emo_{e}_max": neutral(F.max(e), lex.EMOTION_NEUTRAL)}
    stats |= {"affect_coverage": F.coalesce(F.try_divide(F.count("v").cast("double"), content), F.lit(0.0)), "emo_coverage": F.coalesce(F.try_divide(F.count("fear").cast("double"), content), F.lit(0.0))}
    return rated.groupBy(*keep).agg(*[c.alias(n) for n, c in stats.items()])


def per_entity(answers: DataFrame, entities: DataFrame, entity: str, features: list[str], spread: tuple[str, ...] = (), words: str | None = None) -> DataFrame:
    """Mean of every feature and population deviation of ``spread`` per entity; entities without answers get 0."""
    aggs = [F.avg(f).alias(f) for f in features] + [F.stddev_pop(f).alias(f"{f}_sd") for f in spread]
    if words:
        aggs += [F.sum(words).cast("double").alias("n_words_total"), F.count(F.lit(1)).cast("double").alias("n_answers"), F.avg(words).alias("words_per_answer_mean"), F.stddev_pop(words).alias("words_per_answer_sd")]
    found = answers.groupBy(F.col(entity).alias("__e")).agg(*aggs)
    names = [c for c in found.columns if c != "__e"]
    every = entities.select(entity).distinct()
    return every.join(found, F.col(entity) == F.col("__e"), "left").select(entity, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
