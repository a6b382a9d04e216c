"""Registered queries: catalogues and policy resolution. An organisation per customer is the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalog import DEMO_POLICY, INTEGRATIONS, PACKS, STARTER_POLICIES
from ..operators import directory as D
from ..operators import policies as P
from ..sources import catalogs as C
from .check_sql import KEY_LABELS, RANK
from .registry import Inputs, register


def _values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


_PACK_ROWS = _values([(p.pack_id, p.name, p.region, p.description, k, label) for p in PACKS for k, label in p.rules])


@register(
    "rule_pack_catalog",
    f"with packs(pack_id, name, region, description, pattern, rule_label) as {_PACK_ROWS}, on_ as "
    "(select pattern, count(distinct org_id) as orgs from (select org_id, unnest(patterns) as pattern from tenant_policies where enabled) group by pattern) "
    "select p.*, coalesce(orgs, 0) as orgs_enabled from packs p left join on_ using (pattern)",
    "tenant_policies",
)
def rule_pack_catalog(t: Inputs):
    return P.with_adoption(C.rule_packs(t.spark), t("tenant_policies"))


@register(
    "detector_catalog",
    f"with {KEY_LABELS}, d as (select cast(row_number() over () - 1 as bigint) as position, * from key_labels), on_ as "
    "(select pattern, count(distinct org_id) as orgs from (select org_id, unnest(patterns) as pattern from tenant_policies where enabled) group by pattern) "
    "select d.position, d.pattern, d.label, coalesce(orgs, 0) as orgs_enabled from d left join on_ using (pattern)",
    "tenant_policies",
)
def detector_catalog(t: Inputs):
    return P.with_adoption(C.detectors(t.spark), t("tenant_policies"))


_STARTER_ROWS = _values([(i, s.name, s.description, ",".join(s.patterns)) for i, s in enumerate(STARTER_POLICIES)])


@register(
    "default_policies",
    f"with s(seq, name, description, patterns) as {_STARTER_ROWS} select org_id, cast(seq as bigint) as seq, s.name, s.description, patterns, "
    "true as enabled, 'redact' as action, 'cloud' as route from tenants cross join s",
    "tenants",
)
def default_policies(t: Inputs):
    return P.seed_policies(t("tenants")).withColumn("patterns", F.array_join("patterns", ","))


@register(
    "demo_policies",
    f"with s(seq, name, description, patterns) as {_values([(0, DEMO_POLICY.name, DEMO_POLICY.description, ','.join(DEMO_POLICY.patterns))])} "
    "select org_id, cast(seq as bigint) as seq, s.name, s.description, patterns, true as enabled, 'redact' as action, 'cloud' as route from tenants cross join s",
    "tenants",
)
def demo_policies(t: Inputs):
    return P.seed_policies(t("tenants"), (DEMO_POLICY,)).withColumn("patterns", F.array_join("patterns", ","))


_INTEGRATION_ROWS = _values([tuple(i) for i in INTEGRATIONS])


@register(
    "integration_catalog",
    f"with c(slug, name, description, icon, configurable) as {_INTEGRATION_ROWS} select o.org_id, c.*, coalesce(i.installed, false) as installed, "
    "json_extract_string(i.config, '$.url') as webhook_url from tenants o cross join c left join integrations i on i.org_id = o.org_id and i.slug = c.slug",
    "tenants integrations",
)
def integration_catalog(t: Inputs):
    return D.integrations(t("tenants"), t("integrations"))


@register(
    "resolve_policies",
    "select o.org_id, case when bool_or(route = 'selfhosted') then 'selfhosted' else 'cloud' end as route, coalesce(bool_or(deep_scan), false) as deep_scan, "
    "coalesce(bool_or(rag_enabled), false) as rag_enabled, coalesce(string_agg(p.name || '=' || array_to_string(patterns, '+') || '=' || "
    "case action when 'block' then 'block' when 'flag' then 'flag' else 'redact' end, ';' order by created_at, policy_id), '') as policies "
    "from tenants o left join (select * from tenant_policies where enabled) p using (org_id) group by o.org_id",
    "tenants tenant_policies",
)
def resolve_policies(t: Inputs):
    out = P.resolve_policies(t("tenant_policies"), t("tenants"))
    return out.withColumn(
        "policies",
        F.array_join(F.transform("policies", lambda p: F.concat_ws("=", p["name"], F.array_join(p["patterns"], "+"), p["action"])), ";"),
    )


@register(
    "parse_action",
    "select policy_id, case action when 'block' then 'block' when 'flag' then 'flag' else 'redact' end as action from tenant_policies",
    "tenant_policies",
)
def parse_action(t: Inputs):
    return t("tenant_policies").select("policy_id", P.action_col(F.col("action")).alias("action"))


@register(
    "effective_client_policy",
    "with e as (select * from tenant_policies where enabled), k as (select org_id, string_agg(distinct pattern, ',' order by pattern) as patterns "
    "from (select org_id, unnest(patterns) as pattern from e) group by org_id), m as (select org_id, max(case action when 'block' then 3 when 'redact' then 2 else 1 end) as r from e group by org_id) "
    "select o.org_id, coalesce(patterns, '') as patterns, case r when 3 then 'block' when 1 then 'flag' else 'redact' end as mode, patterns is not null as enabled "
    "from tenants o left join k using (org_id) left join m using (org_id)",
    "tenants tenant_policies",
)
def effective_client_policy(t: Inputs):
    out = P.effective_policy(t("tenant_policies"), t("tenants"))
    return out.withColumn("patterns", F.array_join("patterns", ","))


@register(
    "enabled_detectors",
    f"with {KEY_LABELS} select org_id, policy_id, pattern, label, cast({RANK.format('action')} as bigint) as rank from "
    "(select org_id, policy_id, action, unnest(patterns) as pattern from tenant_policies where enabled) join key_labels using (pattern)",
    "tenant_policies",
)
def enabled_detectors(t: Inputs):
    return P.policy_detectors(t("tenant_policies")).select("org_id", "policy_id", "pattern", "label", "rank")


@register(
    "list_policies",
    "select policy_id, org_id, name, enabled, array_to_string(patterns, ',') as patterns, action, deep_scan, route, rag_enabled from tenant_policies",
    "tenant_policies",
)
def list_policies(t: Inputs):
    return P.list_policies(t("tenant_policies")).withColumn("patterns", F.array_join("patterns", ",")).drop("created_at")


@register(
    "has_outbound_redaction",
    "select o.org_id, coalesce(bool_or(enabled and action not in ('block', 'flag') and len(patterns) > 0), false) as has_outbound "
    "from tenants o left join tenant_policies p using (org_id) group by o.org_id",
    "tenants tenant_policies",
)
def has_outbound_redaction(t: Inputs):
    return P.outbound_orgs(t("tenant_policies"), t("tenants"))


# Team names that new users bring: known ones, a market segment of the customer, and blanks.
_ASKED = (
    "asked as (select distinct cast(c_nationkey as bigint) as org_id, case c_custkey % 4 when 0 then 'Sales' when 1 then ' ' when 2 then 'Group ' || c_mktsegment else 'Research' end as name from customer), "
    "missing as (select a.* from asked a where trim(name) <> '' and not exists (select 1 from teams t where t.org_id = a.org_id and t.name = a.name))"
)


@register(
    "create_teams",
    f"with {_ASKED} select team_id, org_id, name, false as fresh from teams union all "
    "select cast('0x' || left(md5(org_id || ':' || name), 15) as bigint), org_id, name, true from missing",
    "teams",
)
def create_teams(t: Inputs):
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, "Sales").when(kind == 1, " ").when(kind == 2, F.concat(F.lit("Group "), "c_mktsegment")).otherwise("Research")
    asked = t("customer").select(F.col("c_nationkey").cast("bigint").alias("org_id"), name.alias("name"))
    after = D.with_asked_teams(t("teams"), asked)
    before = t("teams").select("team_id", F.lit(False).alias("fresh"))
    return after.join(before, "team_id", "left").select("team_id", "org_id", "name", F.coalesce("fresh", F.lit(True)).alias("fresh"))
