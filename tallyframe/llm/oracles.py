"""DuckDB SQL for those queries that SQL can express on whole tables."""

_TOP = """
with e as (
  select nullif(lower(trim(encoder)), '') as encoder, nullif(lower(trim(target)), '') as target, run_id, rmse, logged_at
  from experiment_log where rmse is not null and isfinite(rmse) and rmse >= 0 and run_id is not null),
once as (
  select *, row_number() over (partition by encoder, target, run_id order by rmse, logged_at nulls last) as k
  from e where encoder is not null and target is not null),
ranked as (
  select encoder, target, run_id, rmse,
         cast(row_number() over (partition by encoder, target order by rmse, logged_at nulls last, run_id) as integer) as place
  from once where k = 1)
"""

ORACLES: dict[str, str] = {
    "p2_found": _TOP + "select encoder, target, run_id from ranked where place <= 5",
    "p2_top_runs": _TOP + "select encoder, target, run_id, rmse, place from ranked where place <= 5",
    "p5_found": "select row_id from transcription where length(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) > 1200",
}


def _facts(*pairs: tuple[str, str]) -> str:
    return " union all ".join(f"select '{what}' as what, ({n})::bigint as n" for what, n in pairs)


_FLAT = "trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))"
ORACLES |= {
    "p1_checks": _facts(("rows", "select (select count(*) from predictions) + (select count(*) from transcription)"), ("persons in two splits", "0"), ("values", "select count(*) from (select participant from predictions where participant is not null union select participant from transcription where participant is not null)")),
    "p3_checks": _facts(
        ("rows with sentences", "select count(*) from transcription where regexp_matches(text, '[\\p{L}\\p{N}]')"), ("letters and digits in sentences", "select sum(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) from transcription"),
        ("overlaps", "0"), ("white space at an end", "0"), ("length unlike places", "0"),
    ),
    "p4_checks": _facts(("rows redacted", "select count(*) from transcription"), ("mentions unlike their places", "0"), ("overlaps", "0"), ("texts without a mention that changed", "0"), ("placeholders as mentions", "0")),
    "p5_checks": _facts(
        ("texts", f"select count(*) from transcription where length({_FLAT}) > 1200"), ("characters", f"select sum(length({_FLAT})) from transcription where length({_FLAT}) > 1200"), ("characters of pieces less overlaps", f"select sum(length({_FLAT})) from transcription where length({_FLAT}) > 1200"),
        ("pieces over 1200", "0"), ("later pieces without overlap", "0"), ("texts not from the start", "0"),
    ),
    "p6_checks": _facts(("documents", "select count(*) from documents"), ("containers over 512", "0"), ("documents with gaps", "0"), ("small documents in pieces", "0"), ("places taken twice", "0")),
    "p7_checks": _facts(("sources", "select count(*) from mix_targets"), ("documents too often", "0"), ("documents of another source", "0"), ("quotas missed by more than half a document", "0"), ("places taken twice", "0")),
    "p8_checks": _facts(("documents with a language", "select count(*) from documents where regexp_matches(text, '\\p{L}')"), ("confidence outside 0 to 1", "0"), ("overlaps", "0"), ("neighbours of one language", "0"), ("unknown languages", "0"), ("segments outside the text", "0")),
}
