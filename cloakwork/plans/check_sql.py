"""Pieces of check SQL (DuckDB): spans by splitting, merging by gaps and islands, redaction by ordered aggregation."""

from __future__ import annotations

from ..functions.catalog import BY_KEY, BY_LABEL, DETECTORS, re2_regex

RANK = "case {} when 'block' then 3 when 'flag' then 1 else 2 end"

KEY_LABELS = "key_labels(pattern, label) as (values " + ", ".join(f"('{d.key}', '{d.label}')" for d in DETECTORS) + ")"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(src: str, key: str, text: str, label: str, regex: str, end: str = "end_") -> str:
    re = _quote(regex)
    return (
        f"select {key}, '{label}' as label, hit, cast(stop - length(hit) as bigint) as start, cast(stop as bigint) as {end} from ("
        f"select {key}, hit, sum(length(gap) + length(hit)) over (partition by {key} order by i) as stop from ("
        f"select {key}, unnest(hits) as hit, unnest(gaps[1:len(hits)]) as gap, generate_subscripts(hits, 1) as i from ("
        f"select {key}, regexp_extract_all({text}, {re}) as hits, regexp_split_to_array({text}, {re}) as gaps "
        f"from {src} where regexp_matches({text}, {re}))))"
    )


def detect_sql(src: str, key: str, text: str, detector: str) -> str:
    d = BY_KEY[detector]
    return (
        f'select {key}, label, start, end_ as "end", hit as value from ({matches(src, key, text, d.label, re2_regex(d))})'
    )


def span_ctes(src: str, key: str, text: str) -> str:
    """CTE `spans`: every match of every label."""
    return "spans as (" + " union all ".join(matches(src, key, text, d.label, re2_regex(d)) for d in BY_LABEL.values()) + ")"


def plan_ctes(policies: str = "policies", force: bool = False) -> str:
    """CTEs `entries` (the policy list) and `plan` (one row per organisation and label)."""
    return (
        f"{KEY_LABELS}, entries as (select org_id, label, {'2' if force else RANK.format('action')} as rank, "
        "row_number() over (partition by org_id order by created_at, policy_id, pos) as ord from ("
        "select org_id, created_at, policy_id, action, unnest(patterns) as pattern, generate_subscripts(patterns, 1) as pos "
        f"from {policies} where enabled) join key_labels using (pattern)), "
        "plan as (select org_id, label, max(rank) as rank, min(ord) as ord from entries group by all)"
    )


def merge_ctes(key: str, raw: str = "raw", name: str = "merged") -> str:
    """CTE `merged`: disjoint spans of CTE `raw` (key, label, start, end_, rank, ord)."""
    order = f"partition by {key} order by start, end_ desc, ord"
    return (
        f"{name}_m as (select *, max(end_) over ({order} rows between unbounded preceding and 1 preceding) as prev from {raw}), "
        f"{name}_i as (select *, sum(case when prev is null or start >= prev then 1 else 0 end) over ({order} rows between unbounded preceding and current row) as isl from {name}_m), "
        f"{name} as (select {key}, isl, first(label order by start, end_ desc, ord) as label, min(start) as start, max(end_) as end_, max(rank) as rank from {name}_i group by {key}, isl)"
    )


def redact_ctes(src: str, key: str, text: str, merged: str = "merged", name: str = "redacted", where: str = "rank = 2") -> str:
    """CTE `redacted` (key, text): `src` texts with the merged spans passing `where` masked."""
    return (
        f"{name}_p as (select *, coalesce(lag(end_) over (partition by {key} order by start), 0) as pe from {merged} where {where}), "
        f"{name}_t as (select {key}, string_agg(substring({text}, pe + 1, start - pe) || '[REDACTED:' || label || ']', '' order by start) "
        f"|| substring(any_value({text}), max(end_) + 1) as masked from {name}_p join {src} using ({key}) group by {key}), "
        f"{name} as (select {key}, coalesce(masked, {text}) as text from {src} left join {name}_t using ({key}))"
    )


def scan_ctes(src: str, key: str, text: str, policies: str = "policies", force: bool = False) -> str:
    """CTEs up to `redacted` and `scanned` (key, text, n_findings, blocked, rendered)."""
    raw = f"raw as (select s.*, p.rank, p.ord from spans s join {src} using ({key}) join plan p using (org_id, label))"
    return ", ".join([plan_ctes(policies, force), span_ctes(src, key, text), raw, scanned_ctes(src, key, text)])


def user_ctes(src: str, key: str, text: str, policies: str, detectors: str) -> str:
    """As `scan_ctes`, with detectors read from a relation: each policy entry runs its expression on the texts of its organisation."""
    asked = (
        f"asked as (select org_id, d.label, d.pattern, d.any_case, {RANK.format('action')} as rank, "
        "row_number() over (partition by org_id order by created_at, policy_id, pos) as ord from ("
        "select org_id, created_at, policy_id, action, unnest(patterns) as key, generate_subscripts(patterns, 1) as pos "
        f"from {policies} where enabled) join {detectors} d using (key)), "
        "rules as (select org_id, label, case when any_case then '(?i)' else '' end || pattern as re, max(rank) as rank, min(ord) as ord from asked group by all)"
    )
    raw = (
        f"raw as (select {key}, label, rank, ord, cast(stop - length(hit) as bigint) as start, cast(stop as bigint) as end_ from ("
        f"select {key}, label, rank, ord, hit, sum(length(gap) + length(hit)) over (partition by {key}, label, re order by i) as stop from ("
        f"select {key}, label, re, rank, ord, unnest(hits) as hit, unnest(gaps[1:len(hits)]) as gap, generate_subscripts(hits, 1) as i from ("
        f"select {key}, label, re, rank, ord, regexp_extract_all({text}, re) as hits, regexp_split_to_array({text}, re) as gaps "
        f"from {src} join rules using (org_id) where regexp_matches({text}, re)))))"
    )
    return ", ".join([asked, raw, scanned_ctes(src, key, text)])


def scanned_ctes(src: str, key: str, text: str) -> str:
    """CTEs from `raw` spans to `scanned`."""
    return ", ".join(
        [
            merge_ctes(key),
            redact_ctes(src, key, text),
            f"blocks as (select {key}, bool_or(rank = 3) as blocked from raw group by {key}), "
            f"counts as (select {key}, count(*) as n, string_agg(label || ':' || start || ':' || end_ || ':' || rank, ';' order by start) as rendered from merged group by {key}), "
            f"scanned as (select r.{key}, r.text, coalesce(n, 0) as n_findings, coalesce(blocked, false) as blocked, coalesce(rendered, '') as findings "
            f"from redacted r left join counts c using ({key}) left join blocks b using ({key}))",
        ]
    )
