"""Registered queries: change-feeds and constraint reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import constraints as K
from ..sources.stored import StoredTable
from .check_sql import scan_ctes
from .registry import QUERIES, STAMP_SQL, Inputs, register, stamp
from .session import fresh_path

_AT = "timestamp '2024-02-01 00:00:00' + to_minutes(cast({} as integer))"


def _at(minutes):
    return F.timestamp_add("MINUTE", minutes.cast("int"), F.lit("2024-02-01 00:00:00").cast("timestamp"))


# Title changes per conversation: every message of a conversation renames it; some come from strangers.
_RENAMES = (
    "ren as (select message_id, conv_id, conv_id % 25 as org_id, (conv_id + case when turn % 3 = 2 then 1 else 0 end) % 150 as user_id, "
    "case when turn % 4 = 3 then '  ' else content || ' jane' || turn || '@acme.co' end as title, turn from messages)"
)


def _renames(t: Inputs):
    n = F.col("turn")
    title = F.when(n % 4 == 3, "  ").otherwise(F.concat("content", F.lit(" jane"), n, F.lit("@acme.co")))
    return t("messages").select(
        "message_id",
        "conv_id",
        (F.col("conv_id") % 25).alias("org_id"),
        ((F.col("conv_id") + F.when(n % 3 == 2, 1).otherwise(0)) % 150).alias("user_id"),
        title.alias("title"),
        _at(n).alias("updated_at"),
    )


_TITLES = (
    f"with {_RENAMES}, " + scan_ctes("ren", "message_id", "title", force=True) + ", titled as (select r.message_id, r.conv_id, r.org_id, r.user_id, turn, "
    "case when zero_retention then 'Conversation' when trim(s.text) = '' then 'New chat' else s.text end as title from ren r join scanned s using (message_id) left join orgs using (org_id)) "
)


@register(
    "upsert_latest",
    _TITLES + ", cur as (select conv_id, org_id, user_id, title from headers where conv_id % 2 = 0), "
    "owner as (select conv_id, coalesce(any_value(c.org_id), arg_min(t.org_id, turn)) as org_id, coalesce(any_value(c.user_id), arg_min(t.user_id, turn)) as user_id "
    "from titled t full join cur c using (conv_id) group by conv_id), "
    "good as (select t.* from titled t join owner using (conv_id, org_id, user_id)) "
    "select o.conv_id, o.org_id, o.user_id, coalesce(g.title, c.title) as title, "
    + STAMP_SQL.format("coalesce(g.at, timestamp '2024-01-31 00:00:00')")
    + " as updated_at from owner o left join (select conv_id, arg_max(title, turn) as title, max(" + _AT.format("turn") + ") as at from good group by conv_id) g using (conv_id) "
    "left join cur c using (conv_id)",
    "messages headers policies orgs",
)
def upsert_latest(t: Inputs):
    current = t("headers").filter("conv_id % 2 = 0").drop("turns").withColumn("updated_at", F.lit("2024-01-31").cast("timestamp"))
    changes = C.conversation_titles(_renames(t), t("orgs"), t("policies"))
    out = C.upsert_latest(current, changes, ["conv_id"], ["updated_at", "message_id"], ["org_id", "user_id"])
    return out.withColumn("updated_at", stamp("updated_at"))


def stored_size(df: DataFrame, rows_per_bucket: int = 1_000_000) -> int:
    """Buckets for a table that starts with `df`."""
    return max(8, df.count() // rows_per_bucket)


@register("stored_upsert", QUERIES["upsert_latest"].sql)
def stored_upsert(t: Inputs):
    """The same changes against a stored table, in two merges: an earlier half of the turns and a later one."""
    current = t("headers").filter("conv_id % 2 = 0").drop("turns").withColumn("updated_at", F.lit("2024-01-31").cast("timestamp")).withColumn("message_id", F.lit(None).cast("bigint"))
    table = StoredTable.create(current, fresh_path(t.spark, "conversations"), ["conv_id"], stored_size(current))
    changes = C.conversation_titles(_renames(t), t("orgs"), t("policies"))
    noon = _at(F.lit(3))
    for part in (changes.filter(F.col("updated_at") <= noon), changes.filter(F.col("updated_at") > noon)):
        table = table.merge(part, lambda cur, chg: C.upsert_latest(cur, chg, ["conv_id"], ["updated_at", "message_id"], ["org_id", "user_id"]))
    return table.read().drop("message_id").withColumn("updated_at", stamp("updated_at"))


@register(
    "insert_if_absent",
    "with cur as (select event_id, user_id, value from events where event_id % 2 = 0), chg as (select event_id // 3 * 2 as event_id, user_id, value, event_id as seq from events) "
    "select * from cur union all select event_id, arg_min(user_id, seq), arg_min(value, seq) from chg where event_id not in (select event_id from cur) group by event_id",
)
def insert_if_absent(t: Inputs):
    current = t("events").filter("event_id % 2 = 0").select("event_id", "user_id", "value")
    changes = t("events").select(
        (F.floor(F.col("event_id") / 3) * 2).alias("event_id"), "user_id", "value", F.col("event_id").alias("seq")
    )
    return C.insert_if_absent(current, changes, ["event_id"], ["seq"])


@register(
    "patch_rows",
    "with p as (select user_id as policy_id, cast(ts as timestamp) as patched, event_id, case when event_type = 'click' then 'name ' || event_id end as name, "
    "case when event_type = 'view' then event_id % 2 = 0 end as enabled, case when event_type = 'error' then 'block' end as action from events), "
    "l as (select policy_id, arg_max(name, event_id) filter (where name is not null) as n, arg_max(enabled, event_id) filter (where enabled is not null) as e, "
    "arg_max(action, event_id) filter (where action is not null) as a, max(patched) as patched from p group by policy_id) "
    "select t.policy_id, coalesce(l.n, t.name) as name, coalesce(l.e, t.enabled) as enabled, coalesce(l.a, t.action) as action, "
    + STAMP_SQL.format("coalesce(l.patched, t.created_at)")
    + " as updated_at from tenant_policies t left join l using (policy_id)",
    "tenant_policies",
)
def patch_rows(t: Inputs):
    current = t("tenant_policies").select("policy_id", "name", "enabled", "action", F.col("created_at").alias("updated_at"))
    kind = F.col("event_type")
    patches = t("events").select(
        F.col("user_id").alias("policy_id"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_id",
        F.when(kind == "click", F.concat(F.lit("name "), "event_id")).alias("name"),
        F.when(kind == "view", F.col("event_id") % 2 == 0).alias("enabled"),
        F.when(kind == "error", "block").alias("action"),
    )
    out = C.patch_rows(current, patches, ["policy_id"], ["at", "event_id"], stamp_col="updated_at")
    return out.withColumn("updated_at", stamp("updated_at"))


@register(
    "merge_json_config",
    "with p as (select user_id as org_id, case when event_id % 2 = 0 then 'slack' else 'teams' end as slug, "
    "trim(case when event_type = 'error' then 'ftp://no' else ' https://h.example/' || event_id || ' ' end) as url, event_id from events), "
    "l as (select org_id, slug, arg_max(url, event_id) as url from p where url like 'http://%' or url like 'https://%' group by org_id, slug) "
    "select coalesce(i.org_id, l.org_id) as org_id, coalesce(i.slug, l.slug) as slug, l.url is not null or coalesce(i.installed, false) as installed, "
    "coalesce(l.url, json_extract_string(i.config, '$.url')) as url, json_extract_string(i.config, '$.depth') as depth "
    "from integrations i full join l on l.org_id = i.org_id and l.slug = i.slug",
    "integrations",
)
def merge_json_config(t: Inputs):
    url = F.when(F.col("event_type") == "error", "ftp://no").otherwise(F.concat(F.lit(" https://h.example/"), "event_id", F.lit(" ")))
    patches = t("events").select(
        F.col("user_id").alias("org_id"), F.when(F.col("event_id") % 2 == 0, "slack").otherwise("teams").alias("slug"), url.alias("url"), "event_id"
    )
    out = C.merge_json_config(t("integrations"), patches, ["event_id"])
    return out.select(
        "org_id", "slug", "installed", F.get_json_object("config", "$.url").alias("url"), F.get_json_object("config", "$.depth").alias("depth")
    )


@register(
    "set_installed",
    "with c as (select user_id as org_id, case event_id % 3 when 0 then 'slack' when 1 then 'webhooks' else 'unlisted' end as slug, event_type <> 'error' as turn_on, event_id from events), "
    "l as (select org_id, slug, arg_max(turn_on, event_id) as latest, bool_or(turn_on) as ever from c where slug <> 'unlisted' group by org_id, slug) "
    "select coalesce(i.org_id, l.org_id) as org_id, coalesce(i.slug, l.slug) as slug, coalesce(l.latest, i.installed) as installed "
    "from integrations i full join l on l.org_id = i.org_id and l.slug = i.slug where i.org_id is not null or l.ever",
    "integrations",
)
def set_installed(t: Inputs):
    slug = F.when(F.col("event_id") % 3 == 0, "slack").when(F.col("event_id") % 3 == 1, "webhooks").otherwise("unlisted")
    changes = t("events").select(
        F.col("user_id").alias("org_id"), slug.alias("slug"), (F.col("event_type") != "error").alias("installed"), "event_id"
    )
    return C.set_installed(t("integrations"), changes, ["event_id"]).select("org_id", "slug", "installed")


@register(
    "cascade_delete",
    "select 'parent' as kind, document_id as id from rag_documents where document_id % 3 <> 1 union all "
    "select 'child', chunk_id from rag_chunks where document_id not in (select document_id from rag_documents where document_id % 3 = 1)",
    "rag_documents rag_chunks",
)
def cascade_delete(t: Inputs):
    docs = t("rag_documents")
    parents, children = C.cascade_delete(docs, t("rag_chunks"), "document_id", docs.filter("document_id % 3 = 1"), also=["org_id"])
    return parents.select(F.lit("parent").alias("kind"), F.col("document_id").alias("id")).unionByName(
        children.select(F.lit("child").alias("kind"), F.col("chunk_id").alias("id"))
    )


@register("stored_delete", QUERIES["cascade_delete"].sql)
def stored_delete(t: Inputs):
    """The cascade on stored tables: documents by their id, chunks by the id of their document, so that both are found
    in the buckets that the deleted ids fall into."""
    docs = t("rag_documents")
    ids = docs.filter("document_id % 3 = 1").select("document_id", "org_id")
    parents = StoredTable.create(docs, fresh_path(t.spark, "documents"), ["document_id"], stored_size(docs))
    children = StoredTable.create(t("rag_chunks"), fresh_path(t.spark, "chunks"), ["document_id"], stored_size(t("rag_chunks")))
    gone = parents.lookup(ids).join(ids, ["document_id", "org_id"], "left_semi").select("document_id")
    children = children.merge(gone, lambda cur, i: cur.join(i, "document_id", "left_anti"))
    parents = parents.merge(gone, lambda cur, i: cur.join(i, "document_id", "left_anti"))
    return parents.read().select(F.lit("parent").alias("kind"), F.col("document_id").alias("id")).unionByName(
        children.read().select(F.lit("child").alias("kind"), F.col("chunk_id").alias("id"))
    )


@register("detach_children", "select user_id, org_id, name, case when team_id % 10 = 3 then null else team_id end as team_id from users", "users teams")
def detach_children(t: Inputs):
    return C.detach_children(t("users"), "team_id", t("teams").filter("team_id % 10 = 3")).select("user_id", "org_id", "name", "team_id")


@register(
    "replace_pending",
    "with new as (select event_id + 1000000 as invite_id, user_id, cast(ts as timestamp) as issued_at from events where event_type = 'signup'), "
    "last as (select user_id, arg_max(invite_id, (issued_at, invite_id)) as invite_id, max(issued_at) as issued_at from new group by user_id) "
    "select invite_id, user_id, " + STAMP_SQL.format("expires_at") + " as expires_at, accepted_at is not null as accepted from invites i "
    "where accepted_at is not null or user_id not in (select user_id from last) union all "
    "select invite_id, user_id, " + STAMP_SQL.format("issued_at + interval 7 days") + ", false from last",
    "invites",
)
def replace_pending(t: Inputs):
    issued = t("events").filter("event_type = 'signup'").select(
        (F.col("event_id") + 1000000).alias("invite_id"), "user_id", F.lit(1).cast("bigint").alias("org_id"), F.col("ts").cast("timestamp").alias("issued_at")
    )
    out = C.replace_pending(t("invites"), issued)
    return out.select("invite_id", "user_id", stamp("expires_at").alias("expires_at"), F.col("accepted_at").isNotNull().alias("accepted"))


@register(
    "revoke_keys",
    "with r as (select distinct user_id + 1 as key_id, event_id % 2 = 0 as personal, user_id + event_id % 3 as who, c_nationkey + event_id % 2 as org from events join customer on c_custkey = user_id) "
    "select key_id, revoked or exists (select 1 from r where r.key_id = k.key_id and ((personal and k.scope = 'personal' and k.user_id = who) or (not personal and k.org_id = org))) as revoked from api_keys k",
    "api_keys",
)
def revoke_keys(t: Inputs):
    orgs = t("customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    asked = t("events").join(orgs, "user_id").select(
        (F.col("user_id") + 1).alias("key_id"),
        (F.col("c_nationkey") + F.col("event_id") % 2).alias("org_id"),
        (F.col("user_id") + F.col("event_id") % 3).alias("user_id"),
        (F.col("event_id") % 2 == 0).alias("personal"),
    )
    return C.revoke_keys(t("api_keys"), asked).select("key_id", "revoked")


_INCOMING = (
    "inc as (select message_id, conv_id, conv_id % 25 as org_id, (conv_id + case when turn = 2 then 1 else 0 end) % 150 as user_id, "
    "case when turn % 5 = 4 then 'tool' else role end as role, content, turn from messages)"
)
_ACCEPT = (
    f"with {_INCOMING}, cur_m as (select message_id, conv_id, role, content from messages where turn = 0 and conv_id % 4 = 0), "
    "cur_c as (select conv_id, org_id, user_id from headers where conv_id % 2 = 0), "
    "ok as (select i.* from inc i left join orgs using (org_id) where role in ('user', 'assistant', 'system') and not coalesce(zero_retention, false)), "
    "owner as (select conv_id, org_id, user_id, true as old from cur_c union all select conv_id, arg_min(org_id, turn), arg_min(user_id, turn), false from ok where conv_id not in (select conv_id from cur_c) group by conv_id), "
    "own as (select ok.* from ok join owner using (conv_id, org_id, user_id)), "
    + scan_ctes("own", "message_id", "content", force=True)
)


def _accepted(t: Inputs):
    n = F.col("turn")
    incoming = t("messages").select(
        "message_id",
        "conv_id",
        (F.col("conv_id") % 25).alias("org_id"),
        ((F.col("conv_id") + F.when(n == 2, 1).otherwise(0)) % 150).alias("user_id"),
        F.when(n % 5 == 4, "tool").otherwise(F.col("role")).alias("role"),
        "content",
        _at(n).alias("at"),
    )
    stored = t("messages").filter("turn = 0 and conv_id % 4 = 0").select("message_id", "conv_id", "role", "content")
    convs = t("headers").filter("conv_id % 2 = 0").select(
        "conv_id", "org_id", "user_id", "title", F.lit("2024-01-31").cast("timestamp").alias("updated_at")
    )
    return C.accept_messages(incoming, stored, convs, t("orgs"), t("policies"))


@register(
    "accept_messages",
    _ACCEPT + " select message_id, conv_id, role, content from cur_m union all select message_id, o.conv_id, o.role, s.text from own o join scanned s using (message_id) "
    "where message_id not in (select message_id from cur_m)",
    "messages headers orgs policies",
)
def accept_messages(t: Inputs):
    return _accepted(t)[0]


@register(
    "touched_conversations",
    _ACCEPT + " select o.conv_id, o.org_id, o.user_id, " + STAMP_SQL.format("coalesce(max(" + _AT.format("w.turn") + "), timestamp '2024-01-31 00:00:00')")
    + " as updated_at from owner o left join own w using (conv_id) group by o.conv_id, o.org_id, o.user_id",
    "messages headers orgs policies",
)
def touched_conversations(t: Inputs):
    return _accepted(t)[1].select("conv_id", "org_id", "user_id", stamp("updated_at").alias("updated_at"))


@register(
    "constraint_violations",
    "select 'user_role' as rule, cast(user_id as varchar) as id from users where role not in ('Admin', 'User') "
    "union all select 'user_status', cast(user_id as varchar) from users where status not in ('active', 'inactive') "
    "union all select 'team_set', cast(user_id as varchar) from users where team_id is null "
    "union all select 'org_name', cast(user_id as varchar) from users u where (select count(*) from users v where v.org_id = u.org_id and v.name = u.name) > 1 "
    "union all select 'one_admin', cast(user_id as varchar) from users u where role = 'Admin' and (select count(*) from users v where v.org_id = u.org_id and v.role = 'Admin') > 1 "
    "union all select 'team_fk', cast(user_id as varchar) from users where team_id is not null and team_id not in (select team_id from teams where team_id % 10 < 4)"
    "union all select 'embedding_dim', cast(chunk_id as varchar) from rag_chunks where len(embedding) <> 64 or chunk_id % 100 = 0",
    "users teams rag_chunks",
)
def constraint_violations(t: Inputs):
    rules = [
        K.one_of("user_role", "role", ("Admin", "User")),
        K.one_of("user_status", "status", ("active", "inactive")),
        K.NotNull("team_set", ("team_id",)),
        K.Unique("org_name", ("org_id", "name")),
        K.Unique("one_admin", ("org_id",), F.col("role") == "Admin"),
        K.Foreign("team_fk", "team_id", t("teams").filter("team_id % 10 < 4"), "team_id"),
    ]
    people = K.violations(t("users"), "user_id", rules)
    # every hundredth vector is cut short, so that the length rule has something to find
    cut = t("rag_chunks").withColumn("embedding", F.when(F.col("chunk_id") % 100 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return people.unionByName(K.violations(cut, "chunk_id", [K.vector_length(dim=64)]))


# Rows that break the data model's rules, planted by one SQL text that both engines run: table → (id, planted rows).
_PLANTED = {
    "orgs": ("org_id", "select org_id, case when org_id % 9 = 4 then null else name end as name, case when org_id % 8 = 3 then 'trial' else plan end as plan from orgs"),
    "teams": ("team_id", "select team_id, case when org_id % 6 = 1 then org_id + 1000 else org_id end as org_id, case when team_id % 10 = 1 and org_id % 4 = 0 then 'Platform' else name end as name from teams"),
    "users": (
        "user_id",
        "select user_id, org_id, case when user_id % 31 = 5 then -1 else team_id end as team_id, case when user_id % 40 = 7 then 'Owner' else role end as role, "
        "case when user_id % 50 = 9 then 'gone' else status end as status, case when user_id % 30 < 2 then 'twice@example.com' else email end as email from users",
    ),
    "api_keys": (
        "key_id",
        "select key_id, org_id, case when key_id % 20 = 3 then user_id + 1000000 else user_id end as user_id, case when key_id % 25 = 1 then 'team' else scope end as scope, "
        "case when key_id % 10 = 0 then 'same' else secret end as key_hash from api_keys",
    ),
    "policies": ("policy_id", "select policy_id, org_id, action, case when policy_id % 4 = 1 then 'edge' else route end as route from policies"),
    "usage_logs": ("log_id", "select log_id, org_id, case when log_id % 100 = 7 then -1 else user_id end as user_id, case when log_id % 50 = 3 then 'edge' else route end as route from usage_logs"),
    "risk_alerts": (
        "alert_id",
        "select alert_id, org_id, case when alert_id % 90 = 2 then -5 else team_id end as team_id, case when alert_id % 60 = 1 then 'urgent' else severity end as severity, "
        "case when alert_id % 70 = 1 then 'closed' else status end as status from risk_alerts",
    ),
    "activity": ("activity_id", "select activity_id, case when activity_id % 80 = 3 then 999 else org_id end as org_id, case when activity_id % 75 = 2 then null else actor end as actor from activity"),
    "conversations": ("conv_id", "select conv_id, org_id, case when conv_id % 12 = 1 then -1 else user_id + 1 end as user_id from headers"),
    "messages": ("message_id", "select message_id, case when message_id % 35 = 2 then -1 else conv_id end as conv_id, case when message_id % 45 = 1 then 'tool' else role end as role from messages"),
    "integrations": ("org_id", "select org_id, case when org_id % 3 = 1 then 'slack' else slug end as slug from integrations"),
    "rag_documents": ("document_id", "select document_id, org_id, case when document_id % 33 = 0 then null else title end as title from rag_documents"),
    "rag_chunks": ("chunk_id", "select chunk_id, case when chunk_id % 40 = 1 then -1 else document_id end as document_id, embedding from rag_chunks"),
    "shadow_events": ("event_id", "select event_id, org_id, case when event_id % 55 = 4 then 'drop' else outcome end as outcome from shadow_events"),
    "invites": ("invite_id", "select invite_id, case when invite_id % 10 = 6 then user_id - 1 when invite_id % 28 = 3 then -1 else user_id end as user_id, accepted_at from invites"),
}
_DIM = 64


def _schema_parts(tables: list[str], mark: str = "p_", parent: str = "") -> str:
    """Each rule of these tables spelt out, apart from the rule objects of the operator; `mark` stands before the names of
    the tables, `parent` before those that foreign keys point to."""
    lists = [
        ("orgs", "plan", "'free', 'team', 'enterprise'"), ("users", "role", "'Admin', 'Manager', 'User'"), ("users", "status", "'active', 'inactive', 'invited'"),
        ("api_keys", "scope", "'org', 'personal'"), ("policies", "action", "'redact', 'block', 'flag'"), ("policies", "route", "'cloud', 'selfhosted'"),
        ("usage_logs", "route", "'cloud', 'selfhosted'"), ("risk_alerts", "severity", "'low', 'medium', 'high', 'critical'"), ("risk_alerts", "status", "'open', 'investigating', 'resolved'"),
        ("messages", "role", "'user', 'assistant', 'system'"), ("shadow_events", "outcome", "'redact', 'block', 'flag'"),
    ]
    parents = [
        ("teams", "org_id", "orgs"), ("users", "org_id", "orgs"), ("users", "team_id", "teams"), ("api_keys", "org_id", "orgs"), ("api_keys", "user_id", "users"), ("policies", "org_id", "orgs"),
        ("usage_logs", "org_id", "orgs"), ("usage_logs", "user_id", "users"), ("risk_alerts", "org_id", "orgs"), ("risk_alerts", "team_id", "teams"), ("activity", "org_id", "orgs"),
        ("conversations", "org_id", "orgs"), ("conversations", "user_id", "users"), ("messages", "conv_id", "headers"), ("integrations", "org_id", "orgs"), ("rag_documents", "org_id", "orgs"),
        ("rag_chunks", "document_id", "rag_documents"), ("shadow_events", "org_id", "orgs"), ("invites", "user_id", "users"),
    ]
    nulls = [("orgs", "name"), ("activity", "actor"), ("rag_documents", "title")]
    once = [("teams", "org_id,name", "true"), ("users", "org_id,email", "true"), ("api_keys", "key_hash", "true"), ("integrations", "org_id,slug", "true"), ("invites", "user_id", "accepted_at is null")]
    lists, nulls, parents, once = ([rule for rule in rules if rule[0] in tables] for rules in (lists, nulls, parents, once))
    parts = [f"select '{t}.{c}' as rule, cast({_PLANTED[t][0]} as varchar) as id from {mark}{t} where {c} not in ({v})" for t, c, v in lists]
    parts += [f"select '{t}.{c}', cast({_PLANTED[t][0]} as varchar) from {mark}{t} where {c} is null" for t, c in nulls]
    parts += [f"select '{t}.{c}', cast({_PLANTED[t][0]} as varchar) from {mark}{t} where {c} is not null and {c} not in (select {c} from {parent}{p})" for t, c, p in parents]
    parts += [f"select '{t}({c})', cast({_PLANTED[t][0]} as varchar) from (select *, count(*) over (partition by {c}) as n from {mark}{t} where {w}) where n > 1" for t, c, w in once]
    if "rag_chunks" in tables:
        parts.append(f"select 'embedding_dim', cast(chunk_id as varchar) from {mark}rag_chunks where len(embedding) <> {_DIM}")
    return " union all ".join(parts)


def _schema_sql() -> str:
    return f"with {', '.join(f'p_{t} as ({sql})' for t, (_, sql) in _PLANTED.items())} " + _schema_parts(list(_PLANTED))


@register("schema_violations", _schema_sql(), " ".join(["headers" if t == "conversations" else t for t in _PLANTED]))
def schema_violations(t: Inputs):
    """Every rule of the data model on its table, each with rows planted that break it."""
    known = {n: t("headers" if n == "conversations" else n) for n in _PLANTED}
    parts = []
    for name, (ident, sql) in _PLANTED.items():
        source = "headers" if name == "conversations" else name
        known[name].createOrReplaceTempView(f"rules_{source}")
        planted = t.spark.sql(sql.replace(f" from {source}", f" from rules_{source}"))
        parts.append(K.violations(planted, ident, K.schema_rules(name, known, _DIM)))
    return reduce(DataFrame.unionByName, parts)


# A change set per table: rows as they are with the planted ones in their place, some that come and some that go. The
# columns of the rows as they are:
_AS_THEY_ARE = {
    "orgs": "org_id, name, plan",
    "teams": "team_id, org_id, name",
    "users": "user_id, org_id, team_id, role, status, email",
    "api_keys": "key_id, org_id, user_id, scope, secret as key_hash",
    "headers": "conv_id, org_id, user_id + 1 as user_id",
    "messages": "message_id, conv_id, role",
    "invites": "invite_id, user_id, accepted_at",
}


def _twice() -> dict[str, tuple[str, str, str]]:
    """Table → (id, rows before, rows after), as SQL both engines run."""
    made = {}
    for name, columns in _AS_THEY_ARE.items():
        ident, planted = _PLANTED["conversations" if name == "headers" else name]
        made[name] = (ident, f"select {columns} from {name} where {ident} % 23 <> 1", f"select * from ({planted}) as planted where {ident} % 19 <> 2")
    return made


def _schema_changes_sql() -> str:
    """The difference of two full runs."""
    tables = ["conversations" if n == "headers" else n for n in _AS_THEY_ARE]
    both = [f"{m}_{n} as ({sql})" for n, (_, was, now) in _twice().items() for m, sql in (("b", was), ("a", now))]
    both += [f"{m}_conversations as (select * from {m}_headers)" for m in "ba"]
    full = [f"{m} as ({_schema_parts(tables, f'{m}_', f'{m}_')})" for m in "ba"]
    return (
        f"with {', '.join(both)}, {', '.join(full)} select rule, id, cast(sum(change) as bigint) as change from "
        "(select rule, id, 1 as change from a union all select rule, id, -1 from b) group by rule, id having sum(change) <> 0"
    )


@register("schema_violation_changes", _schema_changes_sql(), " ".join(_AS_THEY_ARE))
def schema_violation_changes(t: Inputs):
    """What change sets of tables and their parents add to the report of broken rules, and take from it. Tables and change
    sets are written first, as they lie when changes arrive."""

    def put(df: DataFrame) -> DataFrame:
        path = fresh_path(t.spark, "rules")
        df.write.parquet(path)
        return t.spark.read.schema(df.schema).parquet(path)

    sets, known = {}, {}
    for name, (ident, was, now) in _twice().items():
        base = put(t(name))
        before, after = (put(t.spark.sql(sql.replace(f" from {name}", " from {base}"), base=base)) for sql in (was, now))
        table = "conversations" if name == "headers" else name
        sets[table] = K.changed(before, ident, put(after.exceptAll(before)), put(before.select(ident).join(after, ident, "left_anti")))
        known[table] = before
    parts = []
    for name, change in sets.items():
        rules = K.schema_rules(name, known)
        parents = {r.name: sets[parent] for r in rules if isinstance(r, K.Foreign) for parent in sets if known[parent] is r.parent}
        parts.append(K.violation_changes(change, rules, parents))
    return reduce(DataFrame.unionByName, parts)
