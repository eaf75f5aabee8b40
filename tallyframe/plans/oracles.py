"""DuckDB SQL with the same results as ``queries``, written independently against the same tables."""

from __future__ import annotations

from tallyframe.functions import lexicons as lex
from tallyframe.functions.text import _ACCENTED, _PLAIN, fold_word
from tallyframe.operators import features
from tallyframe.operators.tfidf import stop_words
from tallyframe.plans import blocks

ORACLES: dict[str, str] = {}


def fold(x: str) -> str:
    return f"translate(regexp_replace(lower({x}), '\\p{{Mn}}+', '', 'g'), '{_ACCENTED}', '{_PLAIN}')"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '(\\p{{L}}+)', 1)"


def label(x: str) -> str:
    return f"nullif(lower(trim({x})), '')"


def finite(x: str) -> str:
    return f"case when isfinite({x}) then {x} end"


def in_list(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in sorted({fold_word(t) for t in terms})) + ")"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def log(*cols: str) -> str:
    doubles = ("rmse", "mae", "r2", "band_f1_macro", "band_qwk", "screening_f1", "screening_auc")
    made = [f"{label(c)} as {c}" if c in ("encoder", "target") else f"{finite(c)} as {c}" if c in doubles else c for c in cols]
    return f"log as (select distinct run_id, {', '.join(made)} from experiment_log)"


SESSION = r"""case when regexp_extract(participant, '(utb|utc|unl)[\s_\-]*0*([0-9]+)', 2, 'i') <> '' then
  upper(regexp_extract(participant, '(utb|utc|unl)[\s_\-]*0*([0-9]+)', 1, 'i')) || '_' || regexp_extract(participant, '(utb|utc|unl)[\s_\-]*0*([0-9]+)', 2, 'i') end"""
SCORED = f"""scored as (select * from (select {SESSION} as session, {finite("y_true")} as y_true, {finite("y_pred")} as y_pred, {label("encoder")} as encoder, {label("target")} as target,
  seed, search, family, augmentation, granularity from predictions) where session is not null and y_true is not null and y_pred is not null)"""
PEOPLE = """people as (select participant, min(phq9_total) as phq9_total, min(gad7_total) as gad7_total from scores
  where participant is not null and phq9_total is not null and gad7_total is not null group by participant)"""
FLAT = r"trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))"
ANSWERS = f"answers as (select * from (select row_id, participant, question, {FLAT} as text from transcription where text is not null) where text <> '' and upper(text) <> 'OMITIDA')"


def band(x: str) -> str:
    return f"case when round_even({x}, 0) < 5 then 0 when round_even({x}, 0) < 10 then 1 when round_even({x}, 0) < 15 then 2 when {x} is not null then 3 end"


def clip(x: str, t: str = "target") -> str:
    return f"case when {t} = 'phq9_total' then greatest(0.0, least(27.0, {x})) when {t} = 'gad7_total' then greatest(0.0, least(21.0, {x})) end"


STRATA = f"""keyed as (select *, {band("phq9_total")} * 4 + {band("gad7_total")} as k from people),
strata as (select participant, phq9_total, gad7_total, case when count(*) over (partition by k) < 2 then 0 else k end as stratum from keyed)"""
SPLIT = f"""marked as (select *, case when row_number() over (partition by stratum order by {draw("participant", "'42'")}, participant)
  <= round_even(count(*) over (partition by stratum) * 0.3, 0) then 'test' else 'train' end as split from strata)"""
MEAN = "mean as (select encoder, target, session, avg(y_true) as y_true, avg(y_pred) as y_pred from scored group by all)"
CLIPPED = f"clipped as (select * from (select encoder, target, session, round(y_true, 9) as y_true, round({clip('y_pred')}, 9) as y_pred from mean where encoder is not null and target is not null) where y_pred is not null)"
BANDED = f"""{MEAN}, {CLIPPED}, banded as (select *, {band("y_true")} as bt, {band("y_pred")} as bp, (y_true >= 10)::int as st, (y_pred >= 10)::int as sp from clipped)"""
BANDED_FAMILY = BANDED.replace("encoder", "family")
PAIRS = """pairs as (select a.encoder, a.target, a.session, round(abs(a.y_pred - a.y_true), 6) as ea, round(abs(b.y_pred - a.y_true), 6) as eb
  from clipped a join clipped b on a.session = b.session and a.target = b.target where a.encoder <> 'e0_tfidf_base' and b.encoder = 'e0_tfidf_base')"""
BASE = f"with {SCORED}, {MEAN}, {CLIPPED}, {PAIRS}"


def wilcoxon(source: str, keys: str, a: str, b: str) -> str:
    return f"""d as (select {keys}, {a} - {b} as d from {source}),
used as (select *, round(abs(d), 12) as m from d where abs(d) > 1e-12),
ranked as (select *, rank() over (partition by {keys} order by m) + (count(*) over (partition by {keys}, m) - 1) / 2.0 as r, count(*) over (partition by {keys}, m) as t from used),
sums as (select {keys}, count(*) as pairs, coalesce(sum(r) filter (d > 0), 0) as wp, coalesce(sum(r) filter (d < 0), 0) as wm, sum((t::double * t - 1)) as ties from ranked group by all),
z as (select *, (least(wp, wm) - pairs * (pairs + 1) / 4.0) / nullif(sqrt(pairs::double * (pairs + 1) * (2 * pairs + 1) / 24 - ties / 48), 0) as z from sums),
cdf as (select *, 1.0 / (1.0 + 0.2316419 * abs(z)) as k from z),
done as (select *, exp(-z * z / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))) as tail from cdf),
tested as (select g.*, coalesce(pairs, 0) as pairs, coalesce(least(wp, wm), 0.0) as w, coalesce(least(1.0, 2 * case when z >= 0 then 1 - tail else tail end), 1.0) as p
  from (select distinct {keys} from d) g left join done using ({keys}))"""


def spearman(source: str, x: str, y: str, keys: str = "") -> str:
    part = f"partition by {keys}" if keys else ""
    both = f"partition by {keys}, " if keys else "partition by "
    lead = f"{keys}, " if keys else ""
    return f"""ranks as (select {lead}rank() over ({part} order by {x}) + (count(*) over ({both}{x}) - 1) / 2.0 as rx, rank() over ({part} order by {y}) + (count(*) over ({both}{y}) - 1) / 2.0 as ry
  from {source} where {x} is not null and {y} is not null),
rho as (select {lead}count(*) as n, case when var_pop(rx) > 0 and var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) else 0.0 end as rho from ranks {"group by " + keys if keys else ""})"""


def steady(sql: str) -> str:
    """Every final ``round(x, 3..6)`` as ``round(x + 1e-9, ..)``: means that fall on a half then round alike whatever the order of summing."""
    out, at = "", 0
    while (k := sql.find("round(", at)) >= 0:
        depth, comma, end = 0, -1, k + 6
        while depth >= 0:
            c = sql[end]
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                comma = end
            end += 1
        inner, digits = sql[k + 6 : comma], sql[comma + 1 : end - 1].strip()
        out += sql[at:k] + (f"round(({steady(inner)}) + 1e-9, {digits})" if digits in ("3", "4", "5", "6") else f"round({steady(inner)}, {digits})")
        at = end
    return out + sql[at:]


O = ORACLES  # noqa: E741
RUN = "encoder, augmentation, target, seed, search"
O["w1_latest_run"] = f"with {log('encoder', 'augmentation', 'target', 'seed', 'search', 'rmse')} select run_id, {RUN}, round(rmse, 6) as rmse from (select *, row_number() over (partition by {RUN} order by run_id desc) as k from log) where k = 1"
O["w1_latest_trial"] = f"with {log('encoder', 'augmentation', 'target', 'seed', 'search', 'selected_model', 'mae')} select run_id, {RUN}, selected_model, round(mae, 6) as mae from (select *, row_number() over (partition by {RUN}, selected_model order by run_id desc) as k from log) where k = 1"
O["a2_summary"] = f"with {log('family', 'granularity', 'encoder', 'search', 'target', 'rmse')} select family, granularity, encoder, search, target, round(avg(rmse), 3) as mean, round(stddev_samp(rmse), 3) as sd, count(*) as n from log where family is not null and granularity is not null and encoder is not null and search is not null and target is not null and rmse is not null group by all"
O["a3_best_per_seed"] = f"with {log('encoder', 'target', 'seed', 'rmse')} select run_id, encoder, target, seed, round(rmse, 6) as rmse from (select *, row_number() over (partition by encoder, target, seed order by rmse, run_id) as k from log where rmse is not null) where k = 1"
O["a4_best_arm"] = f"with {log('family', 'granularity', 'target', 'encoder', 'rmse', 'mae', 'r2')} select run_id, family, granularity, target, encoder, round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2 from (select *, row_number() over (partition by family, granularity, target order by rmse, run_id) as k from log where rmse is not null) where k = 1"
O["a5_coverage"] = f"with {log('family', 'target', 'encoder', 'seed')} select family, target, count(distinct encoder) as encoders, count(distinct seed) as seeds, count(*) as runs from log group by all"
O["a6_same_people"] = f"with {SCORED}, sets as (select family, target, seed, coalesce(array_to_string(list_sort(list(distinct granularity) filter (granularity is not null)), ','), '') as members from scored group by all) select family, target, count(distinct members) as different_sets, max(members) as last_set from sets group by all"
O["a7_value_counts"] = "select split, fold, count(*) as n from experiment_log group by all"
O["a8_size_any"] = f"with {log('encoder', 'family', 'granularity', 'target', 'r2')} select encoder, family, granularity, target, count(*) as n, bool_or(coalesce(r2 < 0, false)) as any_negative from log group by all"
O["a9_conditional_means"] = f"with {log('family', 'rmse', 'split')} select family, round(avg(rmse), 6) as all_mean, round(100 * avg((rmse > 5)::int), 6) as all_pct, round(avg(rmse) filter (split = 'test'), 6) as test_mean, round(100 * avg((rmse > 5)::int) filter (split = 'test'), 6) as test_pct from log group by all"
_COLS = ("rmse", "mae", "r2", "band_f1_macro", "band_qwk", "screening_f1", "screening_auc")
O["a10_column_summary"] = f"with {log(*_COLS)}, long as (" + " union all ".join(f"select '{c}' as feature, {c} as v from log" for c in _COLS) + ") select feature, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(min(v), 6) as min, round(max(v), 6) as max, round(100 * avg((v <> 0)::int), 6) as pct_nonzero from long group by all"
O["a12_first_not_null"] = f"with {log('encoder', 'encoder_model', 'family')} select encoder, arg_min(encoder_model, run_id) filter (encoder_model is not null) as encoder_model from log group by all"
O["a16_upper_median"] = "select source, min(n)::int as shortest, list_sort(list(n))[len(list(n)) // 2 + 1]::int as upper_median, max(n)::int as longest from (select source, length(text) as n from documents where text is not null) group by all"
O["a17_epoch_budget"] = f"with {log('encoder', 'target', 'fold')} select encoder, target, greatest(1, floor(quantile_cont(fold, 0.5))::int) as epochs from log where fold is not null group by all"
O["a20_cv_score"] = f"with {log('encoder', 'target', 'search', 'split', 'fold', 'rmse')}, f as (select encoder, target, search, fold, avg(rmse) as rmse from log where split = 'cv' and rmse is not null group by all) select encoder, target, search, round(avg(rmse), 6) as cv_rmse, count(*) as folds from f group by all"
O["a22_metric_means"] = f"with {log('family', 'target', 'screening_f1', 'screening_auc', 'band_qwk')} select family, target, round(avg(screening_f1), 6) as screening_f1, round(avg(screening_auc), 6) as screening_auc, round(avg(band_qwk), 6) as band_qwk from log group by all"
O["v2_strict_pivot"] = f"with {log('encoder', 'seed', 'target', 'rmse')}, b as (select *, row_number() over (partition by encoder, seed, target order by rmse, run_id) as k from log where rmse is not null) select encoder, seed, round(max(rmse) filter (target = 'phq9_total'), 6) as phq9_total, round(max(rmse) filter (target = 'gad7_total'), 6) as gad7_total from b where k = 1 and encoder is not null and seed is not null group by all"
O["v3_pivot_mean"] = f"with {log('encoder', 'family', 'split', 'rmse')}, w as (select encoder, family, avg(rmse) filter (split = 'cv') as cv, avg(rmse) filter (split = 'test') as test from log where split in ('cv', 'test') group by all) select encoder, family, round(cv, 6) as cv, round(test, 6) as test, round(cv - test, 6) as cv_minus_holdout from w"
O["proj2_filter_isin"] = "select family, search, count(*) as n from experiment_log where family in ('frozen', 'lexical') and encoder_model like 'checkpoint/%' and encoder_model not like '%base' group by all"
O["proj7_label_map"] = "select case family when 'frozen' then 'Frozen' when 'fine-tuning' then 'Fine-tuned' when 'fine-tuning-cv' then 'Fine-tuned (CV)' when 'lexical' then 'Named features' else family end as label, count(*) as n from experiment_log group by all"
O["proj8_readable_arm"] = f"select case when e like 'e0%' then 'baseline' when e like 'l%' then 'named' when contains(e, '-ft') then 'fine-tuned' else 'frozen' end as kind, split_part(e, '_v', 1) as arm, count(*) as n from (select {label('encoder')} as e from experiment_log) where e is not null group by all"
O["proj10_numbers"] = f"select distinct run_id, try_cast(json_extract_string(config_json, '$.n_iter') as double) as n_iter, round({finite('rmse')}, 3) as rmse from experiment_log where run_id is not null"
O["proj12_labels"] = f"with {log('encoder', 'search', 'granularity')} select upper(regexp_replace(concat_ws('-', encoder, granularity), '[^A-Za-z0-9]+', '_', 'g')) as tag, case when search = 'defaults' then 'D' else 'S' end as kind, count(*) as n from log where encoder is not null group by all"
_CELL = "json_extract_string(screening_confusion_matrix, '$[{}][{}]')::bigint"
O["f19_json"] = f"with {log('screening_confusion_matrix', 'selected_params')} select run_id, {_CELL.format(0, 0)} as tn, {_CELL.format(0, 1)} as fp, {_CELL.format(1, 0)} as fn, {_CELL.format(1, 1)} as tp, round(try_cast(json_extract_string(selected_params, '$.alpha') as double), 6) as alpha from log where screening_confusion_matrix is not null"
O["f20_file_stem"] = f"with {log('encoder', 'target', 'search')} select distinct regexp_replace(concat_ws('__', encoder, target, search), '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') as stem from log where encoder is not null and target is not null and search is not null"
O["o2_top_scores"] = f"with {log('encoder', 'r2')} select run_id, encoder, round(r2, 6) as r2 from log where r2 is not null order by log.r2 desc, run_id limit 20"
O["o3_best_candidate"] = f"with {log('selected_model', 'rmse')} select selected_model, round(avg(rmse), 6) as cv_rmse from log where selected_model is not null and selected_model <> 'Dummy' group by all order by 2, 1 limit 1"
O["o4_union"] = f"with {log('family', 'search')} select family, kind, augmentation, count(*) as n from (select family, search as kind, null as augmentation from log union all select family, null, augmentation from predictions) group by all"
O["o5_intersect"] = f"select {label('encoder')} as encoder from experiment_log intersect select {label('encoder')} from predictions"
O["o6_except"] = f"select {label('encoder')} as encoder from experiment_log except select {label('encoder')} from predictions"
O["o7_ordered_dedupe"] = f"with {log('encoder')} select encoder, min(run_id) as first_run from log where encoder is not null group by all"
O["w11_curve"] = f"with {log('encoder', 'fold', 'rmse')} select encoder, coalesce(fold, 0) as epoch, round(avg(rmse), 6) as rmse from log where encoder is not null group by all"
O["w9_early_stopping"] = f"""with recursive {log("encoder", "target", "rmse")}, c as (select encoder, target, rmse as l, row_number() over (partition by encoder, target order by run_id) as e from log where encoder is not null and target is not null and rmse is not null),
s as (select encoder, target, e, l as best, 1::bigint as best_at, 0 as bad, null::bigint as stop from c where e = 1
  union all select c.encoder, c.target, c.e, case when s.stop is null and c.l < s.best - 0.0001 then c.l else s.best end, case when s.stop is null and c.l < s.best - 0.0001 then c.e else s.best_at end,
    case when s.stop is not null then s.bad when c.l < s.best - 0.0001 then 0 else s.bad + 1 end, case when s.stop is not null then s.stop when c.l >= s.best - 0.0001 and s.bad + 1 >= 3 then c.e end
  from s join c on c.encoder = s.encoder and c.target = s.target and c.e = s.e + 1)
select encoder, target, arg_max(best_at, e)::int as best_epoch, arg_max(coalesce(stop, -1), e)::int as stop_epoch from s group by all"""
O["w9_early_stopping"] = f"select encoder, target, best_epoch, nullif(stop_epoch, -1) as stop_epoch from ({O['w9_early_stopping']})"
O["x16_contrasts"] = f"with {log('encoder', 'target', 'granularity', 'augmentation', 'rmse')}, m as (select encoder, target, granularity, avg(rmse) filter (augmentation = 'augmented') as a, avg(rmse) filter (augmentation = 'no_augmentation') as b from log where encoder is not null and target is not null and rmse is not null group by all) select encoder, target, granularity, round(a - b, 6) as difference, case when round(a - b, 6) < 0 then 'A' else 'B' end as winner from m where a is not null and b is not null"
O["x17_family_difference"] = f"with {log('family', 'target', 'seed', 'rmse')} select target, seed, round(avg(rmse) filter (family = 'fine-tuning-multitask') - avg(rmse) filter (family = 'fine-tuning'), 6) as difference from log where rmse is not null and target is not null and seed is not null group by all having difference is not null"
O["x18_cv_vs_test"] = f"with {log('encoder', 'target', 'split', 'rmse')}, w as (select target, encoder, round(avg(rmse) filter (split = 'cv'), 9) as cv, round(avg(rmse) filter (split = 'test'), 9) as test from log where encoder is not null and rmse is not null group by all), v as (select * from w where cv is not null and test is not null), {spearman('v', 'cv', 'test', 'target')} select target, n, round(rho, 5) as rho from rho where n > 2"

O["a1_mean_per_person"] = f"with {SCORED}, {MEAN} select encoder, target, session, round(y_true, 6) as y_true, round(y_pred, 6) as y_pred from mean"
O["a13_error_by_granularity"] = f"with {SCORED} select granularity, target, count(*) as n, round(sqrt(avg((y_pred - y_true) ** 2)), 6) as rmse from scored group by all"
O["a18_mean_baseline"] = f"with {PEOPLE}, {STRATA}, {SPLIT}, p as (select avg(phq9_total) as p from marked where split = 'train'), t as (select phq9_total as y from marked where split = 'test') select count(*) as n, round(sqrt(avg((p - y) ** 2)), 6) as rmse, round(avg(abs(p - y)), 6) as mae, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) as r2 from t, p"
O["a21_out_of_fold"] = f"with {SCORED}, {MEAN}, {CLIPPED} select encoder, target, count(*) as n, round(sqrt(avg((y_pred - y_true) ** 2)), 6) as rmse from clipped where y_pred is not null group by all"
O["x1_regression"] = f"with {SCORED}, {MEAN}, {CLIPPED} select encoder, target, count(*) as n, round(sqrt(avg((y_pred - y_true) ** 2)), 6) as rmse, round(avg(abs(y_pred - y_true)), 6) as mae, round(1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(*), 0), 5) as r2 from clipped group by all"
O["f13_bands"] = f"select participant, {band('phq9_total')} as phq_band, {band('gad7_total')} as gad_band, (phq9_total >= 10)::int as phq_screen, (gad7_total >= 10)::int as gad_screen from scores"
O["f15_clip"] = f"with {SCORED}, {MEAN}, r as (select target, round(y_pred, 9) as raw from mean), k as (select target, raw, round({clip('raw')}, 9) as kept from r) select target, round(min(kept), 6) as low, round(max(kept), 6) as high, sum((raw <> kept)::int)::bigint as moved from k where kept is not null group by all"
O["f28_standardise"] = f"with {PEOPLE} select participant, round((phq9_total - avg(phq9_total) over ()) / coalesce(nullif(stddev_pop(phq9_total) over (), 0), 1), 6) as z from people"
O["x2_confusion"] = f"with {SCORED}, {BANDED_FAMILY}, g as (select distinct target, family from banded), l as (select unnest([0, 1, 2, 3]) as l) select g.target, g.family, a.l as bt, b.l as bp, (select count(*) from banded x where x.target = g.target and x.family is not distinct from g.family and x.bt = a.l and x.bp = b.l) as n from g, l a, l b"
_LAB = """lab as (select encoder, target, unnest(list_distinct([{t}, {p}])) as label, {t} as t, {p} as p from banded),
f as (select encoder, target, label, sum((t = label and p = label)::int) as tp, sum((t <> label and p = label)::int) as fp, sum((t = label and p <> label)::int) as fn from lab group by all)"""
O["x3_f1_macro"] = f"with {SCORED}, {BANDED}, {_LAB.format(t='bt', p='bp')} select encoder, target, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) as f1_macro from f group by all"
O["x5_f1_screening"] = f"with {SCORED}, {BANDED}, {_LAB.format(t='st', p='sp')} select encoder, target, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from f where label = 1"
O["x4_qwk"] = f"""with {SCORED}, {BANDED}, l as (select encoder, target, unnest(list_distinct(list(bt) || list(bp))) as label from banded group by encoder, target),
pos as (select *, dense_rank() over (partition by encoder, target order by label) as k from l),
b as (select b.encoder, b.target, x.k as kt, y.k as kp from banded b join pos x on x.encoder is not distinct from b.encoder and x.target = b.target and x.label = b.bt join pos y on y.encoder is not distinct from b.encoder and y.target = b.target and y.label = b.bp),
o as (select encoder, target, sum((kt - kp) ** 2) as seen, count(*) as n from b group by all),
mt as (select encoder, target, kt, count(*) as n from b group by all), mp as (select encoder, target, kp, count(*) as n from b group by all),
e as (select mt.encoder, mt.target, sum((kt - kp) ** 2 * mt.n * mp.n) as expected from mt join mp on mt.encoder is not distinct from mp.encoder and mt.target = mp.target group by all)
select o.encoder, o.target, round(1 - seen / nullif(expected / n, 0), 6) as qwk from o join e on o.encoder is not distinct from e.encoder and o.target = e.target"""
O["x6_auc"] = f"with {SCORED}, {BANDED}, r as (select encoder, target, st, rank() over (partition by encoder, target order by y_pred) + (count(*) over (partition by encoder, target, y_pred) - 1) / 2.0 as r from banded), s as (select encoder, target, sum(r) filter (st = 1) as rp, sum(st) as p, sum(1 - st) as n from r group by all) select encoder, target, round((rp - p * (p + 1) / 2.0) / nullif(p * n, 0), 6) as auc from s"
O["j3_paired"] = f"{BASE} select encoder, target, count(*) as n, round(avg(ea ** 2 - eb ** 2), 6) as d_squared, round(avg(ea - eb), 6) as d_absolute from pairs group by all"
O["j4_paired_conditions"] = f"with {SCORED}, m as (select augmentation, target, session, avg(y_true) as y, avg(y_pred) as p from scored where augmentation is not null and target is not null group by all), j as (select a.target, a.y, a.p as pa, b.p as pb from m a join m b on a.target = b.target and a.session = b.session where a.augmentation = 'augmented' and b.augmentation = 'no_augmentation') select target, count(*) as n, round(avg((pa - y) ** 2 - (pb - y) ** 2), 6) as d_squared, round(avg(abs(pa - y) - abs(pb - y)), 6) as d_absolute from j group by all"
O["j5_baseline_join"] = f"with {log('encoder', 'target', 'rmse')}, m as (select encoder, target, avg(rmse) as rmse from log where encoder is not null and target is not null group by all) select a.encoder, a.target, round(a.rmse, 6) as rmse, round(a.rmse - b.rmse, 6) as gain from m a join m b on a.target = b.target where a.encoder <> 'e0_tfidf_base' and b.encoder = 'e0_tfidf_base'"
_W = wilcoxon("pairs", "encoder, target", "ea", "eb")
O["x9_wilcoxon"] = f"{BASE}, {_W} select encoder, target, pairs, round(w, 3) as w, round(p, 5) as p from tested"
O["w3_holm"] = f"{BASE}, {_W}, q as (select encoder, target, round(p, 5) as p, row_number() over (partition by target order by round(p, 5), encoder) as k, count(*) over (partition by target) as m from tested), c as (select *, 0.05 / (m - k + 1) as threshold from q) select encoder, target, p, round(threshold, 9) as threshold, min((p <= threshold)::int) over (partition by target order by k rows unbounded preceding) = 1 as significant from c"
O["w2_bh"] = f"{BASE}, {_W}, q as (select encoder, target, round(p, 5) as p, row_number() over (partition by target order by round(p, 5), encoder) as k, count(*) over (partition by target) as m from tested) select encoder, target, p, round(least(1.0, min(p * m / k) over (partition by target order by k desc rows unbounded preceding)), 6) as q from q"
O["w4_average_rank"] = f"with {PEOPLE}, r as (select phq9_total, rank() over (order by phq9_total) + (count(*) over (partition by phq9_total) - 1) / 2.0 as r from people) select phq9_total, count(*) as n, max(r)::double as avg_rank from r group by all"
STATS = f"""ws as (select row_id, participant, w, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0)::double, 0) as mean_word_len from (select row_id, participant, {words("text")} as w from answers))"""
O["x11_spearman"] = f"with {ANSWERS}, {STATS}, {PEOPLE}, f as (select participant, sum(n_words) as words, round(avg(mean_word_len), 6) as word_len from ws group by all), j as (select * from f join people using (participant)), long as (select 'words' as feature, words::double as x, 'phq9_total' as target, phq9_total as y from j union all select 'words', words::double, 'gad7_total', gad7_total from j union all select 'word_len', word_len, 'phq9_total', phq9_total from j union all select 'word_len', word_len, 'gad7_total', gad7_total from j), {spearman('long', 'x', 'y', 'feature, target')} select feature, target, n, round(rho, 5) as rho from rho"
O["x12_pearson_pairs"] = f"with {log(*_COLS)}, d as (select * from log where run_id is not null and {' and '.join(c + ' is not null' for c in _COLS)}), r as (" + " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, abs(corr({a}, {b})) as r from d" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + ") select feature_a, feature_b, round(r, 5) as r from r where r >= 0.8"
_CON = "c as (select * from (values ('tuned_vs_frozen', 'fine-tuning', 'frozen'), ('named_vs_frozen', 'lexical', 'frozen'), ('cv_vs_tuned', 'fine-tuning-cv', 'fine-tuning'), ('affect_on_lexical', 'l1_lexical', 'l2_lexical__affect')) t(contrast, a, b))"
_CK = "search, granularity, target"
O["x15_contrast_table"] = f"""with {SCORED}, {_CON}, s as (select *, family as side from scored union all select *, split_part(encoder, '_v', 1) from scored),
m as (select {_CK}, side, session, round(avg(y_true), 9) as y, round(avg(y_pred), 9) as p from s where side in (select a from c union select b from c) and target is not null group by all),
dd as (select c.contrast, x.search, x.granularity, x.target, round((x.p - x.y) ** 2, 6) as sa, round((z.p - x.y) ** 2, 6) as sb, round(abs(x.p - x.y), 6) as aa, round(abs(z.p - x.y), 6) as ab
  from c join m x on x.side = a join m z on z.side = b and z.target = x.target and z.session = x.session and z.search = x.search and z.granularity = x.granularity),
{wilcoxon("dd", f"contrast, {_CK}", "sa", "sb")}, n as (select contrast, {_CK}, count(*) as n, round(avg(sa - sb), 6) as d_squared, round(avg(aa - ab), 6) as d_absolute from dd group by all),
q as (select contrast, {_CK}, pairs, round(p, 5) as p, row_number() over (partition by {_CK} order by round(p, 5), contrast) as k, count(*) over (partition by {_CK}) as m from tested)
select contrast, {_CK}, n.n, pairs, d_squared, d_absolute, p, min((p <= 0.05 / (m - k + 1))::int) over (partition by {_CK} order by k rows unbounded preceding) = 1 as significant from q join n using (contrast, {_CK})"""
_KIND = "case split_part(encoder, '_v', 1) " + " ".join(f"when '{a}' then '{b}'" for a, b in {"e0_tfidf_base": "tf-idf", "e1_beto": "beto", "e5_beto-ft": "beto", "e6_beto-cv": "beto", "e2_e5-small": "e5-small", "e2_e5-base": "e5-base", "e2_e5-large": "e5-large", "e5_roberta-ft": "roberta"}.items()) + " else split_part(encoder, '_v', 1) end"
_SIDES = [("granularity", "participant", "question", "family = 'frozen' and augmentation = 'no_augmentation' and granularity = 'participant'", "family = 'frozen' and augmentation = 'no_augmentation' and granularity = 'question'"),
          ("stopping", "holdout", "cross-validation", "family = 'fine-tuning'", "family = 'fine-tuning-cv' and augmentation = 'augmented'"),
          ("fine_tuning", "frozen", "fine-tuned", "family = 'frozen' and augmentation = 'augmented' and granularity = 'question'", "family = 'fine-tuning-cv' and augmentation = 'augmented'")]
O["x16_checkpoint_contrasts"] = f"""with {log("encoder", "target", "family", "granularity", "augmentation", "split", "rmse")}, t as (select *, {_KIND} as arm from log where split = 'test' and encoder is not null and target is not null and rmse is not null),
s as ({" union all ".join(f"select '{c}' as contrast, '{na}' as na, '{nb}' as nb, arm, target, avg(rmse) filter ({fa}) as a, avg(rmse) filter ({fb}) as b from t group by arm, target" for c, na, nb, fa, fb in _SIDES)}),
base as (select target, granularity, avg(rmse) as a from t where augmentation = 'no_augmentation' and split_part(encoder, '_v', 1) = 'e2_e5-small' group by all),
ad as (select encoder, target, granularity, avg(rmse) as b from t where augmentation = 'no_augmentation' and split_part(encoder, '_v', 1) = 'e3_e5-tsdae' group by all),
u as (select contrast, na, nb, arm, target, null as granularity, a, b from s where a is not null and b is not null union all select 'tsdae', 'e5-small', 'e5-small adapted', encoder, target, granularity, a, b from ad join base using (target, granularity)),
r as (select contrast, na, nb, arm, target, granularity, round(a, 6) as a, round(b, 6) as b from u)
select contrast, arm, target, granularity, a, b, round(b - a, 6) as difference, case when a < b then na else nb end as winner from r"""

O["a19_strata"] = f"with {PEOPLE}, {STRATA} select stratum, count(*) as n from strata group by all"
O["d1_split"] = f"with {PEOPLE}, {STRATA}, {SPLIT} select participant, stratum, split from marked"
_DEAL = draw("participant", "'42'")
O["d2_folds"] = f"with {PEOPLE}, {STRATA} select participant, ((row_number() over (partition by stratum order by {_DEAL}, participant) - 1) % 5)::int as fold from strata"
_HELD = draw("source", "author", "'42'")
O["d4_hold_out"] = f"with g as (select distinct source, author from documents where source is not null and author is not null), h as (select *, row_number() over (partition by source order by {_HELD}, author) <= greatest(1, round_even(count(*) over (partition by source) * 0.1, 0)) as v from g) select d.source, count(*) as docs, sum(v::int)::bigint as held_docs, count(distinct case when v then d.author end) as held_authors from documents d join h on d.source = h.source and d.author = h.author group by all"
_FOLD = draw("session", "'42'")
O["a23_fold_audit"] = f"with {SCORED}, g as (select session, count(*) as n, ((row_number() over (order by {_FOLD}, session) - 1) % 5)::int as fold from scored group by session), f as (select unnest(range(0, 5))::int as fold) select f.fold, sum(case when g.fold = f.fold then n else 0 end)::bigint as test_rows, sum(case when g.fold <> f.fold then n else 0 end)::bigint as train_rows, sum((g.fold = f.fold)::int)::bigint as test_groups, sum((g.fold <> f.fold)::int)::bigint as train_groups, 0::bigint as overlap from g, f group by all"
O["j6_leakage_guard"] = f"with {PEOPLE}, {STRATA}, {SPLIT}, p as (select {SESSION} as p from marked where split = 'test'), {SCORED} select session, count(*) as leaking_rows from scored where augmentation = 'augmented' and session in (select p from p) group by all"
O["j7_disjoint"] = "select 0::bigint as shared"

O["j1_inner"] = f"with {ANSWERS}, {PEOPLE} select participant, phq9_total, gad7_total, count(distinct question) as questions from answers join people using (participant) group by all"
O["j2_left_align"] = f"with {ANSWERS}, n as (select participant, count(*) as n from answers group by all) select s.participant, n.n from (select distinct participant from scores) s left join n on s.participant = n.participant"
O["s1_answers"] = f"with {ANSWERS} select question, count(*) as answers, count(distinct participant) as people from answers group by all"
O["s4_first_occurrence"] = f"with {ANSWERS} select participant, question, row_id, md5(text) as text_md5 from (select *, row_number() over (partition by text order by participant, question, row_id) as k from answers) where k = 1"
WIDE = "first as (select participant, question, arg_min(text, row_id) as text from answers group by all)"
O["v1_expand_questions"] = f"with {ANSWERS}, {WIDE}, {PEOPLE} select participant || '__' || question as instance, phq9_total, md5(text) as text_md5 from first join people using (participant) where question in ('Q01', 'Q02', 'Q03', 'Q04')"
O["v5_concat_answers"] = f"with {ANSWERS}, {WIDE} select participant, md5(coalesce(string_agg(text, ' ' order by question) filter (question in ('Q01', 'Q02', 'Q03', 'Q04')), '')) as text_md5 from first group by participant"
O["f1_fold"] = f"select doc_id, md5({fold('text')}) as folded from documents where text is not null"
O["f2_numbers"] = "select doc_id, md5(regexp_replace(text, '[0-9]+', ' NUM ', 'g')) as numbered from documents where text is not null"
_PH = r"\[[A-ZÁÉÍÓÚÑ_]+\]"
O["f3_placeholders"] = f"select row_id, md5(regexp_replace(text, '{_PH}', ' ', 'g')) as stripped, len(regexp_extract_all(text, '{_PH}')) as n from transcription where text is not null"
O["f5_ellipsis"] = r"select row_id, len(regexp_extract_all(text, '\.\.\.|…')) as n from transcription where text is not null"


def phrases(terms) -> str:
    """RE2 knows no letters beyond ASCII in its word boundary, so boundaries are written out; overlapping hits share no blank."""
    return " + ".join(f"(len(regexp_extract_all(f, '(?:^|[^\\p{{L}}\\p{{N}}_]){fold_word(t)}(?:$|[^\\p{{L}}\\p{{N}}_])')))" for t in terms)


O["f6_phrases"] = f"select row_id, {phrases(lex.MARKER_PHRASES)} as markers, {phrases(lex.MODAL_PHRASES)} as modals from (select row_id, {fold('text')} as f from transcription where text is not null)"
_LISTS = {"absolutist": lex.ABSOLUTIST, "negation": lex.NEGATION, "marker": lex.MARKERS, "intensifier": lex.INTENSIFIERS}
O["f7_membership"] = f"select row_id, len(w) as words, {', '.join(f'round(coalesce(100.0 * len(list_filter(w, lambda x: x in {in_list(t)})) / nullif(len(w), 0), 0), 6) as {k}_rate' for k, t in _LISTS.items())} from (select row_id, {words('text')} as w from transcription where text is not null)"
O["f10_syllables"] = """with w as (select given_name as word from given_names union select unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) from transcription where text is not null),
g as (select word, regexp_extract_all(lower(word), '([aeiouáéíóúüàèìòù]+)', 1) as g from w),
c as (select word, list_sum(list_transform(g, lambda x: 1 + len(list_filter(range(1, length(x)), lambda i: regexp_matches(substr(x, i::bigint, 2), '^[aeoáéó]{2}$|[íú]'))))) as n from g)
select word, greatest(coalesce(n, 0), 1)::bigint as syllables from c"""
O["f22_word_stats"] = f"with {ANSWERS}, {STATS}, once as (select row_id, count(*) filter (k = 1) as h from (select row_id, x, count(*) as k from (select row_id, unnest(w) as x from ws) group by all) group by all) select row_id, n_words, round(mean_word_len, 6) as mean_word_len, round(coalesce(h / nullif(n_words, 0)::double, 0), 6) as hapax_rate from ws left join once using (row_id)"
O["w5_repetition"] = f"with {ANSWERS}, {STATS} select row_id, len(list_filter(range(1, n_words), lambda i: w[i] = w[i + 1])) as repeats from ws"
O["w6_mattr"] = f"with {ANSWERS}, {STATS} select row_id, round(case when n_words = 0 then 0 when n_words <= 50 then len(list_distinct(w)) / n_words::double else list_avg(list_transform(range(1, n_words - 48), lambda i: len(list_distinct(w[i : i + 49])) / 50.0)) end, 6) as mattr_50 from ws"
O["a11_entity_features"] = f"with {ANSWERS}, {STATS}, once as (select row_id, count(*) filter (k = 1) as h from (select row_id, x, count(*) as k from (select row_id, unnest(w) as x from ws) group by all) group by all), f as (select participant, n_words::double as n, mean_word_len as m, coalesce(h / nullif(n_words, 0)::double, 0) as h from ws left join once using (row_id)), a as (select participant, avg(m) as mean_word_len, avg(h) as hapax_rate, stddev_pop(h) as hapax_rate_sd, sum(n) as n_words_total, count(*)::double as n_answers, avg(n) as words_per_answer_mean, stddev_pop(n) as words_per_answer_sd from f group by all) select p.participant, " + ", ".join(f"round(coalesce({c}, 0), 6) as {c}" for c in ("mean_word_len", "hapax_rate", "hapax_rate_sd", "n_words_total", "n_answers", "words_per_answer_mean", "words_per_answer_sd")) + " from (select distinct participant from scores where participant is not null) p left join a on a.participant = p.participant"
O["w10_chunks"] = "select doc_id, unnest(range(0, case when n <= 510 then 1 else ceil((n - 510) / 256.0)::bigint * 256 + 1 end, 256)) as start from (select doc_id, length(text) as n from documents where text is not null)"
O["a14_corpus"] = f"select source, count(*) as docs, count(distinct author) as people, sum(coalesce(len({words('text')}), 0))::bigint as words from documents group by all"
TOK = f"tok as (select doc_id, source, {words('text')} as w from documents where text is not null)"
_D = draw("'7'", "doc_id::varchar", "i::varchar") + " / 4294967296.0"
_E = draw("'7|how'", "doc_id::varchar", "i::varchar") + " / 4294967296.0"
O["f25_delete_words"] = f"with {TOK}, x as (select doc_id, len(w) as before, w, unnest(range(0, len(w))) as i from tok), u as (select *, {_D} as u from x), k as (select doc_id, before, count(*) filter (u >= 0.6) as kept, string_agg(w[i + 1], ' ' order by i) filter (u >= 0.6) as s, arg_max(w[i + 1], u) as spare from u group by doc_id, before) select t.doc_id, len(t.w) as before, case when len(t.w) = 0 then 0 when kept = 0 then 1 else kept end as after, md5(case when len(t.w) = 0 then '' when kept = 0 then spare else s end) as kept_md5 from tok t left join k using (doc_id)"
_MASK = f"x as (select doc_id, source, unnest(range(0, len(w))) as i from tok), m as (select doc_id, source, case when {_D} >= 0.15 then 0 when {_E} < 0.8 then 1 when {_E} < 0.9 then 2 else 3 end as m from x)"
O["f26_mask"] = f"with {TOK}, {_MASK}, c as (select doc_id, count(*) filter (m = 1) as masked, count(*) filter (m = 2) as replaced, count(*) filter (m = 3) as kept from m group by all) select t.doc_id, coalesce(masked, 0) as masked, coalesce(replaced, 0) as replaced, coalesce(kept, 0) as kept from tok t left join c using (doc_id)"
O["a15_mask_rates"] = f"with {TOK}, {_MASK} select source, round(avg((m > 0)::int), 6) as rate from m group by all"
O["f27_word_probability"] = f"with {TOK} select doc_id, round(greatest(0.0, least(1.0, coalesce((0.15 * n - 0.5 * k) / nullif(n - k, 0), 0.15))), 6) as p_other from (select doc_id, len(w)::double as n, len(list_filter(w, lambda x: x in {in_list(lex.NEGATION)}))::double as k from tok)"
_TERMS = ", ".join(f"('{fold_word(t)}', '{n}')" for n, terms in lex.SUBSCALES.items() for t in terms)
O["j8_lexicon_lookup"] = f"with l as (select * from (values {_TERMS}) t(term, subscale)), w as (select unnest({words('text')}) as w from transcription where text is not null) select subscale, count(*) as hits, count(distinct w) as terms from w join l on w = term group by all"
_STOP = "(" + ", ".join(f"'{t}'" for t in stop_words()) + ")"
O["t2_tfidf"] = f"""with t as (select doc_id, list_filter({words("text")}, lambda x: length(x) >= 2 and x not in {_STOP}) as w from documents where text is not null),
g as (select doc_id, unnest(w) as term from t union all select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from t), c as (select doc_id, term, count(*) as tf from g group by all),
v as (select term, count(*) as df, sum(tf) as total from c group by all), n as (select count(*) as n from t), k as (select term, ln((1.0 + n) / (1.0 + df)) + 1 as idf from v, n where df >= 3 and df <= 0.9 * n order by total desc, term limit 300),
r as (select doc_id, term, (1 + ln(tf)) * idf as w from c join k using (term)) select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from r"""
_F3 = draw("doc_id::varchar", "'42'") + " % 3"
O["t3_fold_vocabulary"] = f"""with t as (select doc_id, ({_F3})::int as fold, list_filter({words("text")}, lambda x: length(x) >= 2 and x not in {_STOP}) as w from documents where text is not null),
c as (select fold, doc_id, term, count(*) as tf from (select fold, doc_id, unnest(w) as term from t) group by all), n as (select fold, count(*) as n from t group by all),
v as (select fold, term, count(*) as df, sum(tf) as total from c group by all), k as (select v.*, n.n, row_number() over (partition by v.fold order by total desc, term) as k from v join n on v.fold = n.fold where df >= 3 and df <= 0.9 * n.n)
select fold, term, df, round(ln((1.0 + n) / (1.0 + df)) + 1, 6) as idf from k where k <= 200"""

EMB = "e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v, sqrt(list_inner_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))) as n from embeddings)"
_COS = "list_inner_product(a.v, b.v) / (a.n * b.n)"
O["f17_unit"] = f"with {EMB} select vec_id, round(n, 6) as length, round(v[1] / n, 6) as first from e"
O["t6_mean_pool"] = f"with {EMB}, x as (select label, unnest(range(0, len(v)))::int as i, unnest(v) as x from e) select label, i, round(avg(x), 5) as x from x group by all"
O["w7_knn"] = f"with {EMB}, p as (select a.vec_id, b.vec_id as neighbour, round({_COS}, 6) as similarity from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) select * from (select *, row_number() over (partition by vec_id order by similarity desc, neighbour)::int as place from p) where place <= 5"
O["j11_similar"] = f"with {EMB}, p as (select a.vec_id, b.vec_id as neighbour, round({_COS}, 6) as similarity from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) select vec_id, neighbour, similarity from p where similarity >= 0.2"
O["t8_cosine_spread"] = f"with {EMB}, p as (select {_COS} as c from e a join e b on a.vec_id <> b.vec_id) select (select count(*) from e) as n, round(avg(c), 5) as mean, round(stddev_pop(c), 5) as sd from p"
O["t8_cosine_percentiles"] = f"with {EMB}, p as (select round({_COS}, 6) as c from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) select count(*) as pairs, round(quantile_cont(c, 0.05), 5) as p05, round(quantile_cont(c, 0.95), 5) as p95 from p"
O["t9_silhouette"] = f"with {EMB}, p as (select a.vec_id, a.label, b.label as other, avg(1 - {_COS}) as d from e a join e b on a.vec_id <> b.vec_id group by all), s as (select vec_id, max(d) filter (label = other) as a, min(d) filter (label <> other) as b from p group by all) select count(*) as n, round(avg(coalesce((b - a) / greatest(a, b), 0)), 5) as silhouette from s"
O["t10_rank_correlation"] = f"with {EMB}, p as (select round(1 - {_COS}, 6) as d, abs(a.label - b.label)::double as gap from e a join e b on a.vec_id <> b.vec_id where b.vec_id % 100 = 0), {spearman('p', 'd', 'gap')} select n, round(rho, 4) as rho from rho"
O["t5_scaling"] = f"with {EMB}, x as (select vec_id, unnest(range(0, len(v)))::int as i, unnest(v) as x from e) select vec_id, i, round(coalesce((x - avg(x) over (partition by i)) / nullif(stddev_pop(x) over (partition by i), 0), 0), 4) as z from x"
O["m1_knn_regression"] = f"with {EMB}, p as (select a.vec_id, b.label, row_number() over (partition by a.vec_id order by round({_COS}, 6) desc, b.vec_id) as k from e a join e b on a.vec_id % 100 = 0 and b.vec_id % 100 <> 0) select vec_id, round(avg(label), 6) as y_pred from p where k <= 7 group by all"

O["f18_cosine_to_mean"] = f"with {EMB}, x as (select label, unnest(range(0, len(v)))::int as i, unnest(v) as x from e), m as (select label, i, avg(x) as x from x group by all), l as (select label, list(x order by i) as m from m group by label) select vec_id, round(list_inner_product(v, m) / (n * sqrt(list_inner_product(m, m))), 5) as cosine from e join l using (label)"
O["f4_normalise"] = f"""with t as (select row_id, trim(regexp_replace(text, '[\\s\\x{{00A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')) as t from transcription where text is not null),
p as (select row_id, string_split_regex(t, '{_PH}') as p, regexp_extract_all(t, '{_PH}') as h from t)
select row_id, md5(array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(translate(h[i], 'ÁÉÍÓÚ', 'AEIOU'), '')), '')) as normalised from p"""
O["proj3_not_blank"] = f"select case when text is null then 'null' when {FLAT} = '' then 'blank' when upper({FLAT}) = 'OMITIDA' then 'omitted' else 'answer' end as kind, count(*) as n from transcription group by all"
O["x13_sparse_features"] = f"with f as ({O['f7_membership']}), l as (" + " union all ".join(f"select '{k}_rate' as feature, {k}_rate as v from f" for k in _LISTS) + "), s as (select feature, round(100 * avg((v <> 0)::int), 4) as pct_nonzero from l group by all) select feature, pct_nonzero, pct_nonzero < 20 as sparse from s"
O["d3_group_split"] = f"with {SCORED}, g as (select session, count(*) as n from scored group by session), m as (select *, case when row_number() over (order by {_FOLD}, session) <= round_even(count(*) over () * 0.2, 0) then 'test' else 'train' end as split from g) select split, sum(n)::bigint as rows, count(*) as people from m group by all"
O["d6_named_corpora"] = f"with {ANSWERS} select 'interviews' as corpus, count(*) as texts, count(distinct participant) as people, sum(length(text))::bigint as chars from answers union all select 'documents', count(*), count(distinct author), sum(length(text))::bigint from documents where text is not null and author is not null"
O["o1_mixed_sort"] = f"with {log('family', 'target', 'rmse')} select family, target, count(*) as n, round(min(rmse), 6) as best from log where rmse is not null group by all"
O["o8_global_first"] = f"select min(doc_id) as doc_id, count(*) as copies from (select doc_id, {fold(FLAT)} as t from documents where text is not null) group by t having count(*) > 1"
_Q = f"{BASE}, squared as (select encoder, target, round(ea ** 2, 9) as ea, round(eb ** 2, 9) as eb from pairs)"
_W2 = f"with r1 as ({_Q}, {wilcoxon('squared', 'encoder, target', 'ea', 'eb')} select encoder, target, pairs, round(p, 5) as p from tested), r2 as ({BASE}, {wilcoxon('pairs', 'encoder, target', 'ea', 'eb')} select encoder, target, round(p, 5) as p_absolute from tested), m as ({BASE} select encoder, target, round(avg(ea ** 2 - eb ** 2), 6) as d_squared, round(avg(ea - eb), 6) as d_absolute from pairs group by all)"
O["x8_paired_comparison"] = f"{_W2} select encoder, target, pairs, d_squared, p, d_absolute, p_absolute from m join r1 using (encoder, target) join r2 using (encoder, target)"
O["a6_equal_seeds"] = f"with {SCORED}, s as (select encoder, target, list_sort(list(distinct seed) filter (seed is not null)) as seeds from scored where encoder is not null group by all) select encoder, count(distinct seeds) = 1 as same_seeds from s group by all"

_BLOCKS = "with recursive " + blocks.block_sql(ANSWERS, fold, draw, in_list, phrases).replace("{MTLD}", blocks.MTLD_STEPS)


def _columns(names) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in names)


for _q, _b in (("b1_person", "person"), ("b3_clinical", "clinical"), ("b4_morphosyntax", "morphosyntax"), ("b5_richness", "richness")):
    O[_q] = f"{_BLOCKS} select row_id, {_columns(features.REGISTRY[_b].features)} from answer"
O["b7_affect"] = f"{_BLOCKS} select row_id, {_columns(features.feature_names('affect'))} from answer"
O["b9_answer_features"] = f"{_BLOCKS} select row_id, {_columns(features.feature_names('lexical-affect'))} from answer"
_SPREAD = features.SPREAD["lexical"] + features.SPREAD["affect"]
_PER = [*[(f"avg({c})", c) for c in features.feature_names("lexical-affect")], *[(f"stddev_pop({c})", f"{c}_sd") for c in _SPREAD], ("sum(n_words)", "n_words_total"), ("count(*)::double", "n_answers"), ("avg(n_words)", "words_per_answer_mean"), ("stddev_pop(n_words)", "words_per_answer_sd")]
O["b10_participant_features"] = f"{_BLOCKS}, per as (select participant, {', '.join(f'{e} as {c}' for e, c in _PER)} from answer group by participant) select p.participant, {', '.join(f'round(coalesce(per.{c}, 0), 6) as {c}' for _, c in _PER)} from (select distinct participant from scores where participant is not null) p left join per on per.participant = p.participant"

from tallyframe.plans import further_oracles as _further  # noqa: E402, F401

for _name in ORACLES:
    ORACLES[_name] = steady(ORACLES[_name])
