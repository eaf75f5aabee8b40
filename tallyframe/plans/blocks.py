"""The named feature blocks as queries, on the answers with a stand-in annotation, and independent SQL for them.

No tagger is installed, so words get parts of speech, morphology and affect ratings by md5 draws of the folded word: no
linguistics, but every rule of every block is exercised on whole tables and can be recomputed in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import lexicons as lex
from tallyframe.functions import text as tx
from tallyframe.operators import features
from tallyframe.session import materialise

POS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "AUX", "PROPN", "DET", "ADP", "CCONJ", "SCONJ", "INTJ")
RATED = ("NOUN", "VERB", "ADJECTIVE", "ADVERB", None)
#: Morphology by draw: key, divisor, values in turn (None: absent).
MORPH = [("Person", 12, ("1", "2", "3", None)), ("Number", 48, ("Sing", "Plur")), ("VerbForm", 96, ("Fin", "Inf")), ("Tense", 192, ("Past", "Pres", "Fut", None)), ("Mood", 768, ("Ind", "Sub")), ("Case", 1536, ("Nom", "Acc")), ("Polarity", 3072, ("Neg", None, None, None, None, None, None, None))]


def _pick(n, divisor: int, values: tuple):
    """The value whose turn it is; ``n`` is evaluated once."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(F.floor(n / F.lit(divisor)), F.lit(len(values))).cast("int"))


def annotated(answers: DataFrame) -> DataFrame:
    """Answers with tokens whose tags are drawn by their folded word."""
    plain = features.annotate(answers.select("row_id", "participant", "text"), "text")

    def tag(x):
        t, n = x["t"], x["n"]
        morph = F.create_map(*[x for key, divisor, values in MORPH for x in (F.lit(key), _pick(n, divisor, values))])
        return F.struct(t["form"].alias("form"), t["lemma"].alias("lemma"), _pick(n, 1, POS).alias("pos"), morph.alias("morph"), t["is_alpha"].alias("is_alpha"), t["sent"].alias("sent"))

    # The draw is bound first, so that it is made once a token.
    drawn = F.transform("tokens", lambda t: F.struct(t.alias("t"), tx.draw(F.lit("tag"), tx.fold(t["form"])).alias("n")))
    return plain.withColumn("tokens", F.transform(drawn, tag).cast(features.TOKEN)).withColumn("n_words", F.size("tokens").cast("double"))


def norms(tagged: DataFrame) -> DataFrame:
    """Ratings of half of the words, drawn like their tags; some ratings are missing."""
    words = tagged.select(F.explode("tokens").alias("t")).select(tx.fold(F.col("t.form")).alias("key")).distinct()
    words, n = words.withColumn("n", tx.draw(F.lit("norm"), F.col("key"))), F.col("n")
    turn = lambda divisor, size: F.pmod(F.floor(n / F.lit(divisor)), F.lit(size))
    scale = lambda divisor, low, size: (F.lit(low) + turn(divisor, size) / 10.0)
    rated = words.where(turn(1, 2) == 0)
    emotions = [F.when(turn(20, 3) > 0, scale(100 * (k + 1), 1.0, 41)).alias(e) for k, e in enumerate(lex.EMOTIONS)]
    return rated.select("key", F.when(turn(2, 5) > 0, scale(10, 1.0, 81)).alias("valence"), F.when(turn(2, 5) > 0, scale(30, 1.0, 81)).alias("arousal"), *emotions, _pick(n, 7, RATED).alias("dominant_pos"))


def answer_features(answers: DataFrame) -> DataFrame:
    """The 72 features of an answer, in registry order, with its participant and number of words."""
    tagged = materialise(annotated(answers), "tagged")
    lexical = features.extract(tagged, features.SETS["lexical"], ["row_id", "participant", "n_words"])
    rated = features.affect(tagged.select("row_id", "tokens"), norms(tagged), ["row_id"])
    return lexical.join(rated, "row_id").select("row_id", "participant", "n_words", *features.feature_names("lexical-affect"))


def participant_features(answers: DataFrame, people: DataFrame) -> DataFrame:
    """Means of the 72 features, deviations of nine, and four counts: 85 columns a participant; those without answers have 0."""
    spread = features.SPREAD["lexical"] + features.SPREAD["affect"]
    return features.per_entity(answer_features(answers), people, "participant", features.feature_names("lexical-affect"), spread, "n_words")


# SQL ---------------------------------------------------------------------------------------------------------


def _sql_pick(n: str, divisor: int, values: tuple) -> str:
    return "case " + " ".join(f"when ({n} // {divisor}) % {len(values)} = {k} then '{v}'" for k, v in enumerate(values) if v is not None) + " end"


def block_sql(answers: str, fold, draw, in_list, phrases) -> str:
    """Common tables up to ``answer``, the features of each answer, from SQL fragments of ``oracles``."""
    ph = r"\[[A-ZÁÉÍÓÚÑ_]+\]"
    n = draw("'tag'", "ff")
    m = draw("'norm'", "ff")
    morph = ", ".join(f"{_sql_pick('d', divisor, values)} as \"{key.lower()}\"" for key, divisor, values in MORPH)
    table = {tx.fold_word(t): name for part in (lex.SUBSCALES, lex.INFLECTIONS) for name, terms in part.items() for t in terms}
    groups = "case ff " + " ".join(f"when '{w}' then '{g}'" for w, g in table.items()) + " end"
    only = {tags: [w for w, t in lex.PARTS_OF_SPEECH.items() if t == tags] for tags in lex.PARTS_OF_SPEECH.values()}
    wrong = " or ".join(f"(ff in {in_list(words)} and pos not in ({', '.join(f'{chr(39)}{t}{chr(39)}' for t in tags)}))" for tags, words in only.items())
    rate = lambda test: f"100.0 * count(*) filter ({test}) / greatest(count(*), 1)"
    first = "(pos = 'PRON' or verbform = 'Fin') and person = '1' and number = 'Sing'"
    who = lambda p, extra="": f"(pos = 'PRON' or verbform = 'Fin') and person = '{p}'{extra}"
    terms = len({t for group in lex.SUBSCALES.values() for t in group})
    neg = f"(coalesce(polarity, '') = 'Neg' or ff in {in_list(lex.NEGATION)})"
    absolute = f"ff in {in_list(lex.ABSOLUTIST)}"
    finite = lambda key, value: f"verbform = 'Fin' and {key} = '{value}'"
    vowels = "[aeiouáéíóúüàèìòù]+"
    emo = ", ".join(f"case when (m // 20) % 3 > 0 then 1.0 + ((m // {100 * (k + 1)}) % 41) / 10.0 end as {e}" for k, e in enumerate(lex.EMOTIONS))
    pos_map = " ".join(f"when '{a}' then '{b}'" for a, b in lex.NORM_POS.items())
    emo_out = ", ".join(f"coalesce(avg({e}), 1.0) as emo_{e}_mean, coalesce(max({e}), 1.0) as emo_{e}_max" for e in lex.EMOTIONS)
    ratio = lambda a, b: f"coalesce({a} / nullif({b}, 0)::double, 0)"
    return f"""{answers},
plain as (select row_id, participant, regexp_replace(text, '{ph}', ' ', 'g') as text from answers),
sents as (select row_id, participant, text, list_filter(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as s from plain),
docs as (select row_id, participant, text, greatest(len(s), 1) as n_sentences from sents),
words as (select row_id, i, regexp_extract_all(s[i], '([\\p{{L}}\\p{{M}}]+)', 1) as w from (select row_id, s, unnest(range(1, len(s) + 1)) as i from sents)),
raw as (select row_id, i, k, w[k] as form, {fold("w[k]")} as ff from (select row_id, i, w, unnest(range(1, len(w) + 1)) as k from words)),
drawn as (select *, {n} as d, {m} as m from raw),
tok as (select *, {_sql_pick("d", 1, POS)} as pos, {morph}, row_number() over (partition by row_id order by i, k) as nr from drawn),
sub as (select *, case when {wrong} then null else {groups} end as g, list_sum(list_transform(regexp_extract_all(lower(form), '({vowels})', 1), lambda x: 1 + len(list_filter(range(1, length(x)), lambda j: regexp_matches(substr(x, j::bigint, 2), '^[aeoáéó]{{2}}$|[íú]'))))) as syl,
  lag(ff) over (partition by row_id order by nr) as before from tok),
per_sent as (select row_id, i, count(*) as c from tok group by all),
lens as (select row_id, sum(c * c)::double as squares from per_sent group by all),
ordered as (select row_id, list(ff order by nr) as w from tok group by all),
freq as (select row_id, count(*) filter (c = 1) as once from (select row_id, ff, count(*) as c from tok group by all) group by all),
walk as (select row_id, w, 0 as nr, []::varchar[] as types, 0 as n, 0.0::double as f from ordered union all select row_id, list_reverse(w), 0, []::varchar[], 0, 0.0 from ordered),
{{MTLD}}
counts as (select s.row_id, count(*) as words,
  {rate(first + " and pos <> 'PRON'")} as fps_verb_rate, {rate(first + " and pos = 'PRON'")} as fps_pron_rate,
  {ratio(f"count(*) filter ({first} and pos = 'PRON' and \"case\" = 'Nom')", f"count(*) filter ({first} and pos <> 'PRON')")} as fps_explicit_ratio,
  {rate(who("1", " and number <> 'Sing'"))} as fpp_rate, {rate(who("2"))} as sps_rate, {rate(who("3"))} as tps_rate,
  {ratio(f"count(*) filter ({first})", f"(count(*) filter ({first}) + count(*) filter ({who('2')}) + count(*) filter ({who('3')}))")} as self_other_ratio,
  {rate(neg)} as negation_rate, {rate(absolute)} as absolutist_rate, count(distinct ff) filter ({absolute}) / {len(lex.ABSOLUTIST)}.0 as absolutist_coverage, count(*) filter ({neg}) as negations,
  {", ".join(f"{rate(f'''g = '{name}' ''')} as clin_{name}" for name in lex.SUBSCALES)}, {rate("g is not null")} as clin_total_rate, count(distinct ff) filter (g is not null) / {terms}.0 as clin_coverage,
  {rate("pos = 'PRON'")} as pos_pron_rate, {rate("pos in ('VERB', 'AUX')")} as pos_verb_rate, {rate("pos = 'ADJ'")} as pos_adj_rate, {rate("pos = 'ADV'")} as pos_adv_rate, {rate("pos = 'NOUN'")} as pos_noun_rate, {rate("pos in ('CCONJ', 'SCONJ')")} as pos_conj_rate,
  {rate(finite("tense", "Past"))} as tense_past_rate, {rate(finite("tense", "Pres"))} as tense_pres_rate, {rate(finite("tense", "Fut"))} as tense_fut_rate, {rate(finite("mood", "Sub"))} as mood_subjunctive_rate,
  count(*) filter (ff in {in_list(lex.MODALS)}) as modals, {rate(f"ff in {in_list(lex.INTENSIFIERS)}")} as intensifier_rate,
  sum(length(form)) / count(*)::double as mean_word_len, count(*) filter (pos in {lex.DENSITY_POS}) / count(*)::double as lexical_density, sum(greatest(coalesce(syl, 0), 1))::double as syl,
  count(*) filter (ff in {in_list(lex.MARKERS)}) as markers, 100.0 * count(*) filter (before = ff) / count(*) as repetition_rate
  from sub s group by s.row_id),
lexical as (select d.row_id, d.participant, coalesce(words, 0)::double as n_words, coalesce(negations, 0) / n_sentences::double as neg_per_sentence,
  {", ".join(f"coalesce({c}, 0.0) as {c}" for c in [*features.REGISTRY["person"].features, "negation_rate", "absolutist_rate", "absolutist_coverage", *features.REGISTRY["clinical"].features, *[f for f in features.REGISTRY["morphosyntax"].features if f != "modal_rate"], "mean_word_len", "lexical_density", "repetition_rate"])},
  coalesce(100.0 * (modals + {phrases(lex.MODAL_PHRASES)}) / nullif(words, 0), 0.0) as modal_rate,
  coalesce(100.0 * (markers + {phrases(lex.MARKER_PHRASES)}) / nullif(words, 0), 0.0) as discourse_marker_rate,
  coalesce(100.0 * len(regexp_extract_all(d.text, '\\.\\.\\.|…')) / nullif(words, 0), 0.0) as hesitation_rate,
  case when words is null then 0.0 when words <= 50 then len(list_distinct(w)) / words::double else list_avg(list_transform(range(1, words - 48), lambda j: len(list_distinct(w[j : j + 49])) / 50.0)) end as mattr_50,
  coalesce(mtld, 0.0) as mtld, coalesce(once / nullif(words, 0)::double, 0.0) as hapax_rate,
  206.84 - 60.0 * coalesce(syl / words, 0.0) - 1.02 * coalesce(words, 0) / n_sentences::double as fernandez_huerta,
  coalesce(words, 0) / n_sentences::double as mean_sentence_len, sqrt(greatest(0.0, coalesce(squares, 0.0) / n_sentences - (coalesce(words, 0) / n_sentences::double) ** 2)) as sentence_len_sd
  from (select *, {fold("text")} as f from docs) d left join counts using (row_id) left join ordered using (row_id) left join freq using (row_id) left join lens using (row_id) left join mtld using (row_id)),
content as (select row_id, case when m % 2 = 0 then m end as m, pos from tok where pos in {lex.AFFECT_POS}),
rated as (select row_id, pos, coalesce(case {_sql_pick("m", 7, RATED)} {pos_map} end = pos, true) as agrees, case when (m // 2) % 5 > 0 then 1.0 + ((m // 10) % 81) / 10.0 end as v, case when (m // 2) % 5 > 0 then 1.0 + ((m // 30) % 81) / 10.0 end as a, {emo} from content),
kept as (select row_id, pos, case when agrees then v end as v, case when agrees then a end as a, {", ".join(f"case when agrees then {e} end as {e}" for e in lex.EMOTIONS)} from rated),
affect as (select d.row_id, coalesce(avg(v), 5.0) as val_mean, coalesce(stddev_pop(v), 0.0) as val_sd, coalesce(min(v), 5.0) as val_min, coalesce(quantile_cont(v, 0.05), 5.0) as val_p05, coalesce(avg((v < 4.0)::int), 0.0) as val_low_rate, coalesce(avg((v > 6.0)::int), 0.0) as val_high_rate,
  coalesce(avg(a), 5.0) as aro_mean, coalesce(max(a), 5.0) as aro_max, coalesce(avg((a > 6.0)::int), 0.0) as aro_high_rate, {emo_out}, {ratio("count(v)", "count(pos)")} as affect_coverage, {ratio("count(fear)", "count(pos)")} as emo_coverage
  from docs d left join kept using (row_id) group by d.row_id),
answer as (select * from lexical join affect using (row_id))"""


MTLD_STEPS = """steps as (select * from walk union all
  select row_id, w, nr + 1, case when len(t) / (n + 1)::double <= 0.72 then [] else t end, case when len(t) / (n + 1)::double <= 0.72 then 0 else n + 1 end, case when len(t) / (n + 1)::double <= 0.72 then f + 1 else f end
  from (select *, case when list_contains(types, w[nr + 1]) then types else list_append(types, w[nr + 1]) end as t from steps where nr < len(w)) s),
passes as (select row_id, len(w) as size, f + case when n > 0 and len(types) < n then (1 - len(types) / n::double) / 0.28 else 0.0 end as f from steps where nr = len(w)),
mtld as (select row_id, avg(case when f > 0 then size / f else size end) as mtld from passes group by row_id),"""
