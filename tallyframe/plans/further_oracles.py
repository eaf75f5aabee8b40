"""DuckDB SQL for the queries of ``further`` and for those that fold over a text."""

from __future__ import annotations

from tallyframe.functions import lexicons as lex
from tallyframe.functions import text as tx
from tallyframe.operators import arms, features
from tallyframe.operators.tfidf import stop_words
from tallyframe.plans import blocks, oracles as o
from tallyframe.plans.oracles import ORACLES as O  # noqa: N814

LISTS = {"absolutist": lex.ABSOLUTIST, "negation": lex.NEGATION, "marker": lex.MARKERS, "intensifier": lex.INTENSIFIERS}
TARGETS = ("phq9_total", "gad7_total")
PERSON_FEATURES = ["words", "word_len", *(f"{k}_rate" for k in LISTS)]
NO_PLACE = "family is not null and augmentation is not null and granularity is not null"
ORDER = ["lexical", "frozen", "fine-tuning", "fine-tuning-cv", "not-run", "fine-tuning-multitask"]

O["proj6_drop"] = "select family, count(*) as n, 25::bigint as columns from experiment_log group by all"
O["proj9_reindex"] = f"with {o.log('family', 'rmse')}, m as (select family, round(avg(rmse), 6) as rmse from log where rmse is not null group by all), w as (select * from (values {', '.join(f'({k}, {chr(39)}{f}{chr(39)})' for k, f in enumerate(ORDER))}) t(pos, family)) select pos, family, rmse from w left join m using (family)"
O["proj11_head_tail"] = f"""with {o.log("encoder", "target", "rmse")}, m as (select encoder, target, round(avg(rmse), 6) as rmse from log where encoder is not null and target is not null and rmse is not null group by all),
r as (select *, row_number() over (partition by target order by rmse, encoder) as low, row_number() over (partition by target order by rmse desc, encoder desc) as high from m)
select target, encoder, rmse, case when low <= 8 then 'head' else 'tail' end as part from r where low <= 8 or high <= 8"""
_KNOWN = ", ".join(f"('{f}', '{g}', '{a}')" for f in ("frozen", "lexical") for g in ("participant", "question") for a in arms.applicable(f, g))
O["proj13_arms"] = f"with {o.log('encoder', 'family', 'granularity')}, k as (select * from (values {_KNOWN}) t(family, granularity, arm)), r as (select family, granularity, split_part(encoder, '_v', 1) as arm, count(*) as n from log where encoder is not null group by all) select k.family, k.granularity, k.arm, coalesce(n, 0) as runs from k left join r on r.family = k.family and r.granularity = k.granularity and r.arm = k.arm"
O["t7_matrices"] = f"with {o.log('encoder', 'family')} select case split_part(encoder, '_v', 1) {' '.join(f'when {chr(39)}{a.name}{chr(39)} then {chr(39)}{a.matrix}{chr(39)}' for a in arms.ARMS.values())} else 'none' end as matrix, family, count(*) as n from log where encoder is not null group by all"
O["j9_baseline_lookup"] = f"""with {o.log("encoder", "search", "granularity", "target", "rmse")}, m as (select encoder, search, granularity, target, round(avg(rmse), 9) as rmse from log where encoder is not null and rmse is not null and search is not null and granularity is not null and target is not null group by all),
b as (select *, row_number() over (partition by search, granularity, target order by rmse, encoder) as k from m where encoder <> 'e0_tfidf_base'), d as (select search, granularity, target, rmse as baseline from m where encoder = 'e0_tfidf_base')
select search, granularity, target, encoder, round(rmse, 6) as rmse, round(baseline, 6) as baseline, round(baseline - rmse, 6) as gain from b left join d using (search, granularity, target) where k = 1"""
O["j12_configurations"] = f"with {o.log('target', 'granularity', 'search')}, c as (select * from (values ('phq9_total'), ('gad7_total')) t(target), (values ('participant'), ('question')) g(granularity), (values ('defaults'), ('random15'), ('grid')) s(search)), r as (select target, granularity, search, count(*) as n from log group by all) select c.target, c.granularity, c.search, coalesce(n, 0) as runs from c left join r using (target, granularity, search)"
_QUESTION = o.SCORED.replace("select * from (select", "select * from (select regexp_extract(participant, '__(Q[0-9]+)', 1) as question,", 1)
O["a13_error_by_question"] = f"with {_QUESTION} select question, target, count(*) as n, round(sqrt(avg((y_pred - y_true) ** 2)), 6) as rmse from scored where question <> '' and target is not null group by all"

O["s9_routed_log"] = f"with {o.log('family', 'augmentation', 'granularity', 'rmse')} select family, augmentation, granularity, count(*) as n, min(run_id) as first, round(avg(rmse), 6) as rmse from log where {NO_PLACE} and run_id is not null group by all"
O["s10_snapshots"] = f"with {o.log('family', 'search', 'rmse')} select family, search, count(*) as n from log where family is not null and (family <> 'lexical' or search = 'defaults') group by all"
O["s12_placed_logs"] = f"with {o.log('family', 'augmentation', 'granularity', 'rmse')} select family, augmentation, granularity, count(*) as n, round(avg(rmse), 6) as rmse from log where family in ('frozen', 'lexical') and augmentation = 'augmented' and granularity in ('participant', 'question') group by all"
O["s16_migration"] = f"with {o.log('family', 'granularity', 'rmse')} select family, granularity, count(*) as planned, count(*) as moved from log where family is not null and granularity is not null group by all"
O["f19_round_trip"] = f"with {o.log('seed', 'rmse', 'mae')} select run_id, seed, round(rmse, 6) as rmse, round(mae, 6) as mae from log".replace("round(rmse, 6)", "round(rmse, 6 )").replace("round(mae, 6)", "round(mae, 6 )")

_TABLE = {tx.fold_word(t): name for part in (lex.SUBSCALES, lex.INFLECTIONS) for name, terms in part.items() for t in terms}
_ONLY = {tags: [w for w, t in lex.PARTS_OF_SPEECH.items() if t == tags] for tags in lex.PARTS_OF_SPEECH.values()}


def _lookup(word: str) -> str:
    wrong = " or ".join(f"({word} in {o.in_list(words)} and pos not in ({', '.join(repr(t) for t in tags)}))" for tags, words in _ONLY.items())
    return f"case when {wrong} then null else case {word} {' '.join(f'when {chr(39)}{w}{chr(39)} then {chr(39)}{g}{chr(39)}' for w, g in _TABLE.items())} end end"


O["f8_subscales"] = f"""with {o.ANSWERS}, w as (select w, count(*) as n from (select unnest({o.words("text")}) as w from answers) group by w),
d as (select *, {o.draw("'lemma'", "w")} as d, {o.draw("'tag'", "w")} as t from w), l as (select *, case d % 4 when 0 then w when 1 then w || ' yo' when 2 then 'triste' end as lemma, {blocks._sql_pick("t", 1, blocks.POS)} as pos from d),
g as (select n, coalesce({_lookup("lemma")}, case when contains(lemma, ' ') then {_lookup("split_part(lemma, ' ', 1)")} end, {_lookup("w")}) as subscale from l)
select subscale, sum(n)::bigint as hits, count(*) as words from g where subscale is not null group by all"""
_CLINICAL = o.in_list({t for group in lex.SUBSCALES.values() for t in group})
O["f9_clinical_words"] = f"with {o.ANSWERS} select row_id, len(list_filter({o.words('text')}, lambda x: x in {_CLINICAL})) as n from answers"
_PIECES = r"string_split(regexp_replace(trim(text), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1))"


def _cut(longest: int, least: int) -> str:
    """Table ``units`` (row_id, p, k, w): the words of each cut sentence in order."""
    return f"""sents as (select row_id, unnest(range(1, len(s) + 1)) as p, s from (select row_id, {_PIECES} as s from answers)), toks as (select row_id, p, string_split_regex(trim(s[p]), '\\s+') as t from sents),
cuts as (select row_id, p, t, unnest(range(0, greatest(len(t), 1), {longest})) as k from toks), units as (select row_id, p, k, t[k + 1 : k + {longest}] as w from cuts where len(t[k + 1 : k + {longest}]) >= {least})"""


O["f11_sentences"] = f"with {o.ANSWERS}, {_cut(60, 5)} select row_id, count(*) as sentences, max(length(array_to_string(w, ' '))) as longest from units group by row_id"
O["w8_packing"] = f"""with recursive {o.ANSWERS}, {_cut(60, 1)}, u as (select row_id, list(array_to_string(w, ' ') order by p, k) as u from units group by row_id), whole as (select a.row_id, coalesce(u, []) as u from answers a left join u using (row_id)),
f as (select row_id, u, 0 as i, '' as now, 0 as packs, 0 as longest from whole union all
  select row_id, u, i + 1, case when length(j) <= 400 then j else u[i + 1] end, case when length(j) <= 400 or now = '' then packs else packs + 1 end, case when length(j) <= 400 or now = '' then longest else greatest(longest, length(now)) end
  from (select *, case when now = '' then u[i + 1] else now || ' ' || u[i + 1] end as j from f where i < len(u)) x)
select row_id, packs + (now <> '')::int as packs, nullif(greatest(longest, length(now)), 0) as longest from f where i = len(u)"""
O["f12_split_to_fit"] = f"""with recursive {o.ANSWERS}, {_cut(40, 1)}, u as (select row_id, list(len(w) order by p, k) as u from units where trim(array_to_string(w, ' ')) <> '' group by row_id), whole as (select a.row_id, coalesce(u, []) as u from answers a left join u using (row_id)),
f as (select row_id, u, 0 as i, 0::bigint as now, 0 as packs, 0::bigint as longest from whole union all
  select row_id, u, i + 1, case when now + u[i + 1] <= 40 then now + u[i + 1] else u[i + 1] end, case when now + u[i + 1] <= 40 then packs else packs + 1 end, case when now + u[i + 1] <= 40 then longest else greatest(longest, now) end from f where i < len(u))
select row_id, packs + (now > 0)::int as pieces, greatest(longest, now) as longest, coalesce(list_sum(u), 0)::bigint as words from f where i = len(u)"""
O["f21_mtld"] = f"with recursive {o.ANSWERS}, {o.STATS}, walk as (select row_id, w, 0 as nr, []::varchar[] as types, 0 as n, 0.0::double as f from ws union all select row_id, list_reverse(w), 0, []::varchar[], 0, 0.0 from ws), {blocks.MTLD_STEPS.rstrip(',')} select row_id, round(mtld, 6) as mtld from mtld"
_LIST_NAMES = [*features.REGISTRY["negation"].features, *features.REGISTRY["discourse"].features]
_UNTAGGED = blocks.block_sql(o.ANSWERS, o.fold, o.draw, o.in_list, o.phrases).replace("{MTLD}", blocks.MTLD_STEPS).replace("coalesce(polarity, '') = 'Neg' or ", "")
O["b2_b6_lists"] = f"with recursive {_UNTAGGED} select row_id, {', '.join(f'round({c}, 6) as {c}' for c in _LIST_NAMES)} from answer"
_PH = r"\[[A-ZÁÉÍÓÚÑ_]+\]"


def _spans(name: str, pattern: str) -> str:
    """Table of the places of a pattern: what stands before each match, and the matches before it, added up."""
    return f"""{name}_p as (select row_id, string_split_regex(text, '{pattern}') as p, regexp_extract_all(text, '{pattern}') as h from transcription where text is not null),
{name}_k as (select row_id, p, h, unnest(range(1, len(h) + 1)) as k from {name}_p),
{name} as (select row_id, h[k] as form, list_sum(list_transform(p[1 : k], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(h[1 : k - 1], lambda x: length(x))), 0)::bigint as s, length(h[k]) as n from {name}_k)"""


O["j10_overlap"] = f"with {_spans('a', _PH)}, {_spans('b', '[^ ]+')} select a.row_id, count(*) as pairs from a join b on a.row_id = b.row_id and a.s < b.s + b.n and b.s < a.s + a.n group by a.row_id"
O["h10_word_spans"] = f"with {_spans('w', chr(92) + 'p{L}+')}, t as (select w.*, case when s > 0 then substr(text, s, 1) else '' end as c from w join transcription using (row_id)) select row_id, count(*) as words, sum(s)::bigint as starts, sum(n)::bigint as letters, sum(({o.fold('form')} in {_CLINICAL})::int)::bigint as lexicon from t where c <> '[' group by row_id"
_SYL = "list_sum(list_transform({w}, lambda y: greatest(1, coalesce(list_sum(list_transform(regexp_extract_all(y, '([aeiouáéíóúüàèìòù]+)', 1), lambda x: 1 + len(list_filter(range(1, length(x)), lambda i: regexp_matches(substr(x, i::bigint, 2), '^[aeoáéó]{{2}}$|[íú]'))))), 0))))"
O["f23_readability"] = f"with {o.ANSWERS}, t as (select row_id, {o.words('text')} as w, len(list_filter({_PIECES.replace('trim(text)', 'text')}, lambda x: trim(x) <> '')) as s from answers) select row_id, round(206.84 - 60.0 * coalesce({_SYL.format(w='w')} / nullif(len(w), 0)::double, 0) - 1.02 * coalesce(len(w) / greatest(s, 1)::double, 0), 6) as readability from t"
O["f24_neutral_stats"] = f"with {o.log('encoder', 'r2')}, b as (select encoder, case when r2 < 0 then r2 end as v from log where encoder is not null) select encoder, round(coalesce(avg(v), 5.0), 6) as mean, round(coalesce(stddev_pop(v), 0.0), 6) as sd, round(coalesce(min(v), 5.0), 6) as min, round(coalesce(max(v), 5.0), 6) as max, round(coalesce(quantile_cont(v, 0.05), 5.0), 6) as p05 from b group by all"
O["f17_elements"] = f"with {o.EMB} select vec_id, unnest(range(0, len(v)))::int as i, round(unnest(v) / n, 5) as x from e"
O["f28_destandardise"] = f"with {o.PEOPLE} select participant, round(phq9_total, 6) as phq9_total from people"
_NEG = o.in_list(lex.NEGATION)
_U = o.draw("'7'", "doc_id::varchar", "i::varchar") + " / 4294967296.0"
_V = o.draw("'7|how'", "doc_id::varchar", "i::varchar") + " / 4294967296.0"
O["f26_weighted_mask"] = f"""with {o.TOK}, c as (select doc_id, w, len(w)::double as n, len(list_filter(w, lambda x: x in {_NEG}))::double as k from tok), p as (select *, case when n > k then greatest(0.0, least(1.0, (0.15 * n - 0.5 * k) / (n - k))) else 0.0 end as other from c),
x as (select doc_id, other, w, unnest(range(0, len(w))) as i from p), d as (select doc_id, i, {_U} as u, {_V} as v, case when w[i + 1] in {_NEG} then 0.5 else other end as p from x),
h as (select *, bool_or(u < p) over (partition by doc_id) as hit, row_number() over (partition by doc_id order by u, i) as r from d), t as (select doc_id, v from h where case when hit then u < p else r = 1 end),
s as (select doc_id, count(*) filter (v < 0.8) as masked, count(*) filter (v >= 0.8 and v < 0.9) as replaced, count(*) filter (v >= 0.9) as kept from t group by all)
select tok.doc_id, len(w) as words, coalesce(masked, 0) as masked, coalesce(replaced, 0) as replaced, coalesce(kept, 0) as kept from tok left join s using (doc_id)"""
O["t1_stop_words"] = f"with k as (select unnest([{', '.join(f'{chr(39)}{w}{chr(39)}' for w in stop_words())}]) as word), f as (select w, count(*) as n from (select unnest({o.words('text')}) as w from documents where text is not null) group by w) select word, coalesce(n, 0) as n from k left join f on word = w"
_T = f"t as (select doc_id, text, list_filter({o.words('text')}, lambda x: length(x) >= 2 and x not in {o._STOP}) as w from documents where text is not null)"
_GRAMS = " union all ".join(f"select doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {' || chr(32) || '.join(f'w[i + {k}]' for k in range(n))})) as term from t" for n in (1, 2, 3))
O["t2_trigrams"] = f"with {_T}, g as ({_GRAMS}), c as (select doc_id, term, count(*) as tf from g group by all), v as (select term, count(*) as df, sum(tf)::bigint as total from c group by all), n as (select count(*) as n from t) select term, df, total, round(ln((1.0 + n) / (1.0 + df)) + 1, 6) as idf from v, n where df >= 3 and df <= 0.9 * n order by v.total desc, term limit 1000"
O["t4_side_by_side"] = f"""with {_T}, c as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from t) group by all), v as (select term, count(*) as df, sum(tf) as total from c group by all), n as (select count(*) as n from t),
k as (select term, ln((1.0 + n) / (1.0 + df)) + 1 as idf from v, n where df >= 3 and df <= 0.9 * n order by total desc, term limit 100), r as (select doc_id, term, (1 + ln(tf)) * idf as w from c join k using (term)), x as (select doc_id, length(text)::double as chars, len({o.words("text")})::double as words from t)
select doc_id, 'text:' || term as feature, round(w / sqrt(sum(w * w) over (partition by doc_id)), 5) as value from r
union all select doc_id, 'named:chars', round((chars - avg(chars) over ()) / coalesce(nullif(stddev_pop(chars) over (), 0), 1), 5) from x union all select doc_id, 'named:words', round((words - avg(words) over ()) / coalesce(nullif(stddev_pop(words) over (), 0), 1), 5) from x"""
O["t6_pooled_levels"] = f"with {o.EMB}, x as (select label, vec_id % 7 as q, unnest(range(0, len(v)))::int as i, unnest(v) as x from e), a as (select label, q, i, avg(x) as x from x group by all), b as (select label, i, avg(x) as x from a group by all) select label as person, i, round(x / sqrt(sum(x * x) over (partition by label)), 5) as x from b"

_PF = f"""pf as (select participant, sum(n_words)::double as words, round(avg(mean_word_len), 9) as word_len, {", ".join(f"round(avg(coalesce(100.0 * len(list_filter(w, lambda x: x in {o.in_list(t)})) / nullif(n_words, 0), 0)), 9) as {k}_rate" for k, t in LISTS.items())} from ws group by all),
pj as (select * from pf join people using (participant))"""
_PERSON = f"{o.ANSWERS}, {o.STATS}, {o.PEOPLE}, {_PF}"


def _power(low: str, high: str, power: str) -> str:
    return f"(list_sum(list_transform(range(0, 801), lambda k: (case when k = 0 or k = 800 then 1.0 when k % 2 = 1 then 4.0 else 2.0 end) * pow(greatest(cos({low} + k * (({high}) - ({low})) / 800.0), 0.0), {power}))) * (({high}) - ({low})) / 800.0 / 3.0)"


def rank_p(rho: str, n: str) -> str:
    """Two-sided p of a rank correlation, by the same integral as the operator's."""
    v = f"({n} - 2)::double"
    angle = f"atan(abs({rho}) * sqrt({v} / (1.0 - {rho} * {rho})) / sqrt({v}))"
    reach = f"least(1.5707963267948966, 12.0 / sqrt({v}))"
    return f"case when {n} < 3 or {rho} = 0 then 1.0 when abs({rho}) >= 1 - 1e-12 then 0.0 when {angle} >= {reach} then 0.0 else least(1.0, {_power(angle, reach, f'({v} - 1)')} / {_power('0.0', reach, f'({v} - 1)')}) end"


def _rho(target: str) -> str:
    return f"rho_{target} as (with {o.spearman('long', 'x', target, 'feature')} select feature, n, round(rho, 9 ) as rho from rho)"


_LONG = "long as (" + " union all ".join(f"select '{f}' as feature, {f}::double as x, phq9_total, gad7_total from pj" for f in PERSON_FEATURES) + ")"
_SUMMARY = f"""with {_PERSON}, {_LONG}, {", ".join(_rho(t) for t in TARGETS)},
{", ".join(f"p_{t} as (select feature, rho, round({rank_p('rho', 'n')}, 9 ) as p from rho_{t}), q_{t} as (select *, least(1.0, min(p * m / k) over (order by k desc rows unbounded preceding)) as q from (select *, row_number() over (order by p, feature) as k, count(*) over () as m from p_{t}))" for t in TARGETS)},
base as (select feature, avg(x) as mean, stddev_samp(x) as sd, min(x) as min, max(x) as max, 100 * avg((x <> 0)::int) as pct_nonzero from long group by all),
summary as (select feature, mean, sd, min, max, pct_nonzero, {", ".join(f"q_{t}.rho as rho_{t}, q_{t}.p as p_{t}, q_{t}.q as q_{t}" for t in TARGETS)}, greatest({", ".join(f"abs(q_{t}.rho)" for t in TARGETS)}) as abs_rho_max from base {" ".join(f"join q_{t} using (feature)" for t in TARGETS)})"""
O["a10_feature_summary"] = f"{_SUMMARY} select feature, {', '.join(f'round({c}, 4) as {c}' for c in ('mean', 'sd', 'min', 'max', 'pct_nonzero', *(f'{k}_{t}' for t in TARGETS for k in ('rho', 'p', 'q')), 'abs_rho_max'))} from summary"
O["x13_survivors"] = f"{_SUMMARY} select feature, {', '.join(f'q_{t} <= 0.05 as survives_{t}' for t in TARGETS)}, pct_nonzero < 20 as sparse from summary"
_XLONG = "xl as (" + " union all ".join(f"select '{f}' as feature, {f if f != 'constant' else '1.0'}::double as x, '{t}' as target, {t} as y from pj" for f in [*PERSON_FEATURES, "constant"] for t in TARGETS) + ")"
O["x11_rank_p"] = f"with {_PERSON}, {_XLONG}, {o.spearman('xl', 'x', 'y', 'feature, target')}, z as (select feature, target, n, round(rho, 9 ) as r from rho), y as (select feature, target, n, r, {rank_p('r', 'n')} as pp from z) select feature, target, n, round(r, 4) as rho, round(pp, 4) as p from y"
_COLS = ("rmse", "mae", "r2", "band_f1_macro", "band_qwk", "screening_f1", "screening_auc")
O["x12_rank_collinear"] = f"with {o.log(*_COLS)}, d as (select * from log where {' and '.join(c + ' is not null' for c in _COLS)}), k as (select {', '.join(f'rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r_{c}' for c in _COLS)} from d where run_id is not null), r as (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, abs(corr(r_{a}, r_{b})) as r from k" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + ") select feature_a, feature_b, round(r, 4) as abs_spearman from r where r >= 0.1"
O["m1_mean_baseline_folds"] = f"with {o.PEOPLE}, {o.STRATA}, f as (select *, ((row_number() over (partition by stratum order by {o._DEAL}, participant) - 1) % 5)::int as fold from strata), l as (" + " union all ".join(f"select '{t}' as target, fold, {t} as y from f" for t in TARGETS) + "), s as (select target, fold, sum(y) as s, count(y) as n from l group by all), w as (select target, sum(s) as ts, sum(n) as tn from s group by all), h as (select s.target, s.fold, (ts - s) / (tn - n) as m from s join w using (target)), r as (select target, fold, sqrt(avg((y - m) ** 2)) as r from l join h using (target, fold) group by all) select target, 'dummy' as model, round(avg(r), 6) as cv_rmse from r group by all"
O["d5_train_frame"] = f"with {o.PEOPLE}, {o.STRATA}, {o.SPLIT}, p as (select {o.SESSION} as p from marked where split = 'test'), {o.SCORED} select family, count(*) as rows, count(distinct session) as people from scored where augmentation = 'augmented' and session not in (select p from p where p is not null) group by all"
O["d6_corpora"] = f"with {o.ANSWERS} select 'interviews' as corpus, count(*) as texts, count(distinct participant) as people from answers union all select 'documents', count(*), count(distinct author) from documents where text is not null and author is not null"
O["a4_first_per_column"] = f"with {o.log('family', 'granularity', 'target', 'rmse', 'r2', 'screening_auc')} select family, granularity, target, " + ", ".join(f"round(first({c} order by rmse, run_id) filter ({c} is not null), 6) as {c}" for c in ("rmse", "r2", "screening_auc")) + " from log where log.rmse is not null group by all"
O["w4_rank_of_runs"] = f"with {o.log('encoder', 'target', 'rmse')}, m as (select encoder, target, round(avg(rmse) + 1e-9, 2) as rmse from log where encoder is not null and target is not null and rmse is not null group by encoder, target), r as (select target, rmse, rank() over (partition by target order by rmse) + (count(*) over (partition by target, rmse) - 1) / 2.0 as r from m) select target, rmse, count(*) as n, max(r)::double as avg_rank from r group by all"
O["s2_score_workbook"] = O["s3_csv"] = "select participant, phq9_total, gad7_total from scores"
O["s14_summary_sheet"] = O["a2_summary"]
O["s15_results_workbook"] = " union all ".join(f"select '{n}' as sheet, (select count(*) from ({O[q]})) as rows" for n, q in (("summary", "a2_summary"), ("best", "a4_best_arm"), ("baseline", "a18_mean_baseline"), ("clinical", "a22_metric_means"), ("contrasts", "x16_contrasts")))
