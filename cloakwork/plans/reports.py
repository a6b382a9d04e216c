"""Registered queries: dashboard reports, feeds, quotas and scalar idioms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..operators import directory as D
from ..operators import kept as K
from ..operators import quota as Q
from ..operators import reports as R
from .registry import STAMP_SQL, Inputs, register
from .session import fresh_path

AS_OF = "2024-01-30 12:00:00"
_TS = f"timestamp '{AS_OF}'"


def _events(t: Inputs):
    labels = F.filter(F.split("labels_csv", ","), lambda x: x != "")
    return t("shadow_events").withColumn("labels", labels).drop("labels_csv")


def _messages(t: Inputs):
    at = F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit("2024-01-10 23:50:00").cast("timestamp"))
    return t("messages").withColumn("created_at", at)


def _conversations(t: Inputs):
    last = F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"))
    return t("headers").withColumn("updated_at", last.cast("timestamp"))


@register(
    "org_kpis",
    f"select o.org_id, (select count(*) from users u where u.org_id = o.org_id and status = 'active') as active_users, "
    f"(select count(*) from usage_logs l where l.org_id = o.org_id and created_at::date = {_TS}::date) as queries_today, "
    "(select count(*) from risk_alerts a where a.org_id = o.org_id and status in ('open', 'investigating')) as risk_incidents, "
    "(select coalesce(cast(round(100.0 * (1 - count(*) filter (where blocked)::decimal(20,0) / nullif(count(*), 0)::decimal(20,0))) as bigint), 100) "
    f"from usage_logs l where l.org_id = o.org_id and created_at > {_TS} - interval 7 days) as compliance_score from orgs o",
    "orgs users usage_logs risk_alerts",
)
def org_kpis(t: Inputs):
    return R.org_kpis(t("users"), t("usage_logs"), t("risk_alerts"), t("orgs"), AS_OF)


_DAYS = f"days as (select org_id, cast(unnest(generate_series(({_TS}::date - 9)::timestamp, {_TS}::date::timestamp, interval 1 day)) as date) as day from orgs)"


@register("day_series", f"with {_DAYS} select org_id, strftime(day, '%Y-%m-%d') as day, coalesce(n, 0) as active from days "
          "left join (select org_id, created_at::date as day, count(distinct user_id) as n from usage_logs group by all) using (org_id, day)", "orgs usage_logs")
def day_series(t: Inputs):
    users = t("usage_logs").groupBy("org_id", F.to_date("created_at").alias("day")).agg(F.count_distinct("user_id").alias("n"))
    series = R.day_series(t("orgs"), AS_OF).join(users, ["org_id", "day"], "left")
    return series.select("org_id", F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0).cast("bigint")).alias("active"))


_DAILY = (
    f"with {_DAYS} select org_id, strftime(day, '%Y-%m-%d') as day, strftime(day, '%b %d') as date, coalesce(q.n, 0) as queries, coalesce(a.n, 0) as incidents "
    "from days left join (select org_id, created_at::date as day, count(*) as n from usage_logs group by all) q using (org_id, day) "
    "left join (select org_id, created_at::date as day, count(*) as n from risk_alerts group by all) a using (org_id, day)"
)


@register("daily_usage", _DAILY, "orgs usage_logs risk_alerts")
def daily_usage(t: Inputs):
    out = R.daily_usage(t("usage_logs"), t("risk_alerts"), t("orgs"), AS_OF)
    return out.withColumn("day", F.col("day").cast("string"))


def _history(rows: DataFrame, ident: str) -> tuple[DataFrame, list[DataFrame]]:
    """A table as it was once, and the two feeds that made it what it is: a third of its rows came later, a fifth were
    moved from another organisation and the day before, and some that were there are gone."""
    old = rows.filter(F.col(ident) % 3 != 0)
    moved = F.col(ident) % 5 == 0
    then = old.withColumn("org_id", F.when(moved, (F.col("org_id") + 1) % 25).otherwise(F.col("org_id"))).withColumn(
        "created_at", F.when(moved, F.col("created_at") - F.expr("interval 1 day")).otherwise(F.col("created_at"))
    )
    gone = rows.filter(F.col(ident) % 7 == 0).withColumn(ident, -F.col(ident) - 1)

    def change(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumn(K.CHANGE, F.lit(kind))

    first = change(rows.filter(F.col(ident) % 3 == 0), "insert").unionByName(change(gone, "delete"))
    second = change(then.filter(moved), "update_preimage").unionByName(change(old.filter(moved), "update_postimage"))
    return then.unionByName(gone), [first, second]


def _brought_up(t: Inputs, parts: K.Partials, rows: DataFrame, ident: str) -> DataFrame:
    """The partials of a table kept through its history. Organisations and days are few against a bucket of a million."""
    before, feeds = _history(rows, ident)
    path = fresh_path(t.spark, "partials")
    table = parts.store(before, path, 8)
    for feed in feeds:
        table = parts.apply(t.spark, path, feed, table.version)
    return table.read()


@register("kept_daily_usage", _DAILY, "orgs usage_logs risk_alerts")
def kept_daily_usage(t: Inputs):
    queries = _brought_up(t, K.per_day(), t("usage_logs"), "log_id").withColumnRenamed("n_rows", "queries")
    incidents = _brought_up(t, K.per_day(), t("risk_alerts"), "alert_id").withColumnRenamed("n_rows", "incidents")
    return R.usage_series(queries, incidents, t("orgs"), AS_OF).withColumn("day", F.col("day").cast("string"))


@register(
    "daily_series_join",
    f"with {_DAYS} select d.org_id, strftime(day, '%Y-%m-%d') as day, count(l.log_id) as queries from days d "
    "left join usage_logs l on l.org_id = d.org_id and l.created_at::date = d.day group by all",
    "orgs usage_logs",
)
def daily_series_join(t: Inputs):
    counts = R.per_day(t("usage_logs"), "queries", AS_OF, 10)
    out = R.day_series(t("orgs"), AS_OF).join(counts, ["org_id", "day"], "left")
    return out.select("org_id", F.col("day").cast("string").alias("day"), F.coalesce("queries", F.lit(0).cast("bigint")).alias("queries"))


def _top(src: str, part: str, ident: str, k: int) -> str:
    return f"(select * from {src} qualify row_number() over (partition by {part} order by created_at desc, {ident}) <= {k})"


@register("latest_k_per_org", f"select org_id, log_id from {_top('usage_logs', 'org_id', 'log_id', 50)}", "usage_logs")
def latest_k_per_org(t: Inputs):
    return R.latest_k(t("usage_logs"), "org_id", R.newest("log_id"), 50).select("org_id", "log_id")


@register(
    "alerts_feed",
    "select r.org_id, alert_id, strftime(created_at, '%I:%M %p') as timestamp, coalesce(m.name, 'Org-wide') as team, severity, message, status "
    f"from {_top('risk_alerts', 'org_id', 'alert_id', 50)} r left join teams m on m.team_id = r.team_id",
    "risk_alerts teams",
)
def alerts_feed(t: Inputs):
    return R.alerts_feed(t("risk_alerts"), t("teams"))


@register(
    "activity_feed",
    "select org_id, activity_id, strftime(created_at, '%I:%M %p') as timestamp, actor as user, action, target "
    f"from {_top('activity', 'org_id', 'activity_id', 20)}",
    "activity",
)
def activity_feed(t: Inputs):
    return R.activity_feed(t("activity"))


@register(
    "events_feed",
    f"select org_id, event_id, site, host, action, outcome, labels_csv as labels, count, {STAMP_SQL.format('created_at')} as at "
    f"from {_top('shadow_events', 'org_id', 'event_id', 100)}",
    "shadow_events",
)
def events_feed(t: Inputs):
    return R.events_feed(_events(t)).withColumn("labels", F.array_join("labels", ","))


@register(
    "personal_activity",
    "select user_id, activity_id, action, target, strftime(created_at, '%Y-%m-%d %H:%M') as created_at "
    f"from {_top('activity', 'org_id, actor', 'activity_id', 50)} a join users u on u.org_id = a.org_id and u.name = a.actor",
    "activity users",
)
def personal_activity(t: Inputs):
    return R.personal_activity(t("activity"), t("users"))


@register(
    "site_discovery",
    "select org_id, site, count(*) as events, cast(coalesce(sum(count), 0) as bigint) as items_caught, count(*) filter (where outcome = 'block') as blocked, "
    "count(*) filter (where outcome = 'redact') as redacted, strftime(max(created_at), '%Y-%m-%d %H:%M') as last_seen from shadow_events group by org_id, site",
    "shadow_events",
)
def site_discovery(t: Inputs):
    return R.site_discovery(_events(t))


@register(
    "label_counts",
    "select org_id, label, count(*) as count from (select org_id, unnest(string_split(labels_csv, ',')) as label from shadow_events) where label <> '' group by org_id, label",
    "shadow_events",
)
def label_counts(t: Inputs):
    return R.label_counts(_events(t))


@register(
    "kept_label_counts",
    "select org_id, label, count(*) as count from (select org_id, unnest(string_split(labels_csv, ',')) as label from shadow_events) where label <> '' group by org_id, label",
    "shadow_events",
)
def kept_label_counts(t: Inputs):
    return _brought_up(t, K.per_label(), _events(t), "event_id").withColumnRenamed("n_rows", "count")


_PAGE = (
    "select log_id, provider, model, route, prompt_tokens, output_tokens, latency_ms, redactions, blocked, "
    + STAMP_SQL.format("created_at")
    + " as timestamp from usage_logs where org_id = 7 "
)


@register("usage_log_page", _PAGE + "and provider = 'openai' order by created_at desc, log_id limit 50 offset 20", "usage_logs")
def usage_log_page(t: Inputs):
    return R.usage_log_page(t("usage_logs"), 7, "openai", 50, 20).drop("org_id", "user_id")


@register("page", _PAGE + "order by created_at desc, log_id limit 500", "usage_logs")
def page(t: Inputs):
    return R.usage_log_page(t("usage_logs"), 7, None, 9999, -5).drop("org_id", "user_id")


@register(
    "personal_stats",
    "select org_id, user_id, count(*) as total_prompts, cast(coalesce(sum(redactions), 0) as bigint) as total_redactions, "
    "count(*) filter (where blocked) as total_blocks from usage_logs group by org_id, user_id",
    "usage_logs",
)
def personal_stats(t: Inputs):
    return R.personal_stats(t("usage_logs"))


@register(
    "users_with_team",
    "select user_id, u.org_id, u.name, role, status, coalesce(m.name, '') as team from users u left join teams m on m.team_id = u.team_id",
    "users teams",
)
def users_with_team(t: Inputs):
    return D.users_with_team(t("users"), t("teams")).select("user_id", "org_id", "name", "role", "status", "team")


@register(
    "team_member_counts",
    "select m.team_id, m.org_id, m.name, count(u.user_id) as member_count from teams m left join users u on u.team_id = m.team_id group by all",
    "users teams",
)
def team_member_counts(t: Inputs):
    return D.team_member_counts(t("teams"), t("users"))


@register("has_bootstrap_admin", "select org_id, name from orgs o where exists (select 1 from users u where u.org_id = o.org_id and role = 'Admin')", "orgs users")
def has_bootstrap_admin(t: Inputs):
    return D.orgs_with_admin(t("users"), t("orgs")).select("org_id", "name")


@register(
    "conversation_list",
    "select conv_id, org_id, user_id, title, strftime(date '2024-01-01' + cast(conv_id % 28 as integer), '%Y-%m-%d') as date, "
    "coalesce((select substring(content, 1, 80) from messages m where m.conv_id = h.conv_id order by turn desc limit 1), '') as preview from headers h",
    "headers messages",
)
def conversation_list(t: Inputs):
    return R.conversation_list(_conversations(t), _messages(t))


@register(
    "messages_of_conversation",
    "select org_id, conv_id, message_id, role, content, strftime(timestamp '2024-01-10 23:50:00' + to_minutes(turn), '%I:%M %p') as timestamp "
    "from messages join headers using (conv_id)",
    "headers messages",
)
def messages_of_conversation(t: Inputs):
    return R.messages_of(_messages(t), t("headers"))


@register(
    "owned_conversations",
    "select message_id, exists (select 1 from headers h where h.conv_id = m.conv_id and h.org_id = m.conv_id % 25 and h.user_id = (m.conv_id + turn % 2) % 150) as owned from messages m",
    "headers messages",
)
def owned_conversations(t: Inputs):
    writes = t("messages").select(
        "message_id", "conv_id", (F.col("conv_id") % 25).alias("org_id"), ((F.col("conv_id") + F.col("turn") % 2) % 150).alias("user_id")
    )
    return R.flag_owned(writes, t("headers")).select("message_id", "owned")


_KEYS_SQL = (
    "select key_id, org_id, user_id, name, substring(secret, 1, 11) || '…' as prefix, strftime(created_at, '%Y-%m-%d') as created_at, "
    "strftime(last_used, '%Y-%m-%d %H:%M') as last_used, revoked from api_keys left join (select user_id, max(created_at) as last_used from usage_logs group by user_id) using (user_id) "
)


def _keys(t: Inputs):
    used = t("usage_logs").groupBy("user_id").agg(F.max("created_at").alias("last_used"))
    return t("api_keys").withColumn("prefix", SC.key_prefix(F.col("secret"))).join(used, "user_id", "left")


@register("personal_keys", _KEYS_SQL + "where scope = 'personal'", "api_keys usage_logs")
def personal_keys(t: Inputs):
    return D.personal_keys(_keys(t))


@register("org_keys", _KEYS_SQL, "api_keys usage_logs")
def org_keys(t: Inputs):
    return D.org_keys(_keys(t))


@register("org_settings", "select org_id, name as org_name, plan, zero_retention, settings from tenants", "tenants")
def org_settings(t: Inputs):
    return D.org_settings(t("tenants"))


@register(
    "delivery_targets",
    "select org_id, slug, json_extract_string(config, '$.url') as url from integrations where installed and slug in ('slack', 'teams', 'webhooks') "
    "and coalesce(json_extract_string(config, '$.url'), '') <> ''",
    "integrations",
)
def delivery_targets(t: Inputs):
    return D.delivery_targets(t("integrations"))


@register(
    "pending_invites",
    "select invite_id, user_id, u.org_id, u.name, email, role, o.name as org_name from invites i join users u using (user_id) join orgs o on o.org_id = i.org_id "
    "where accepted_at is null and expires_at > timestamp '2024-02-10 00:00:00'",
    "invites users orgs",
)
def pending_invites(t: Inputs):
    return D.pending_invites(t("invites"), t("users"), t("orgs"), "2024-02-10 00:00:00")


_LIMIT = "case plan when 'free' then 200 when 'team' then 20000 end"
_RANKED = "(select log_id, org_id, created_at::date as day, row_number() over (partition by org_id, created_at::date order by created_at, log_id) as n from usage_logs)"


@register("rank_within_day", f"select log_id, org_id, strftime(day, '%Y-%m-%d') as day, n from {_RANKED}", "usage_logs")
def rank_within_day(t: Inputs):
    return Q.rank_within_day(t("usage_logs")).select("log_id", "org_id", F.col("day").cast("string").alias("day"), "n")


# Most of the traffic goes to one organisation on the free plan, which allows 200 a day.
_HOT = "case when org_id < 20 then 0 else org_id end"
_BUSY = (
    f"(select log_id, {_HOT} as org_id, created_at::date as day, row_number() over "
    f"(partition by {_HOT}, created_at::date order by created_at, log_id) as n from usage_logs)"
)


def _busy(t: Inputs):
    return t("usage_logs").withColumn("org_id", F.when(F.col("org_id") < 20, 0).otherwise(F.col("org_id")).cast("bigint"))


@register(
    "quota_decisions",
    f"select log_id, r.org_id, cast({_LIMIT} as bigint) as \"limit\", {_LIMIT} is null or n <= {_LIMIT} as admitted, cast(least(n, {_LIMIT}) as bigint) as used "
    f"from {_BUSY} r left join orgs o using (org_id)",
    "usage_logs orgs",
)
def quota_decisions(t: Inputs):
    return Q.quota_decisions(_busy(t), t("orgs")).select("log_id", "org_id", "limit", "admitted", "used")


@register(
    "quota_used",
    f"select org_id, strftime(day, '%Y-%m-%d') as day, requests, cast(least(requests, {_LIMIT}) as bigint) as used from "
    f"(select {_HOT} as org_id, created_at::date as day, count(*) as requests from usage_logs group by all) left join orgs using (org_id)",
    "usage_logs orgs",
)
def quota_used(t: Inputs):
    return Q.quota_used(_busy(t), t("orgs")).withColumn("day", F.col("day").cast("string"))


@register("daily_request_limit", f"select org_id, plan, cast({_LIMIT} as bigint) as daily_limit from tenants", "tenants")
def daily_request_limit(t: Inputs):
    return t("tenants").select("org_id", "plan", Q.plan_limit(F.col("plan")).alias("daily_limit"))


@register(
    "quota_status",
    f"select org_id, plan, cast({_LIMIT} as bigint) as \"limit\", cast(least(coalesce(n, 0), {_LIMIT}) as bigint) as used, "
    f"cast(greatest({_LIMIT} - least(coalesce(n, 0), {_LIMIT}), 0) as bigint) as remaining, cast(epoch(({_TS}::date + 1)::timestamp) as bigint) as resets_at "
    f"from orgs left join (select org_id, count(*) as n from usage_logs where created_at::date = {_TS}::date and created_at <= {_TS} group by org_id) using (org_id)",
    "orgs usage_logs",
)
def quota_status(t: Inputs):
    return Q.quota_status(t("usage_logs"), t("orgs"), AS_OF)


@register(
    "scalar_functions",
    "select event_id, strftime(ts, '%Y-%m-%d') as d, strftime(ts, '%Y-%m-%d %H:%M') as m, strftime(ts, '%Y-%m-%d %H:%M:%S') as s, strftime(ts, '%I:%M %p') as c, "
    "strftime(ts, '%b %d') as md, strftime(ts, '%Y%m%d') as dk, cast((epoch(ts)::bigint // 86400 + 1) * 86400 as bigint) as reset, "
    "cast(least(greatest(user_id, 5), 20) as bigint) as clamped, sha256(event_type) as h, substring(sha256(event_type), 1, 11) || '…' as prefix, "
    "trim('  ' || event_type || ' ') as trimmed, starts_with(case when event_id % 2 = 0 then 'https://a' else 'ftp://a' end, 'http') as web, upper(event_type) as u, "
    "cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(nullif(event_type, 'view'), 'none') as nn, concat_ws(', ', event_type, 'x') as joined, "
    "cast(least(greatest(coalesce(case when user_id % 4 = 0 then null else user_id end, 5), 1), 20) as bigint) as top_k from events",
)
def scalar_functions(t: Inputs):
    ts = F.col("ts").cast("timestamp")
    url = F.when(F.col("event_id") % 2 == 0, "https://a").otherwise("ftp://a")
    return t("events").select(
        "event_id",
        SC.date_text(ts).alias("d"),
        SC.minute_text(ts).alias("m"),
        SC.second_text(ts).alias("s"),
        SC.clock_text(ts).alias("c"),
        SC.day_text(ts).alias("md"),
        SC.day_key(ts).alias("dk"),
        SC.next_utc_midnight(ts).cast("bigint").alias("reset"),
        SC.clamp(F.col("user_id"), 5, 20).alias("clamped"),
        SC.hash_key(F.col("event_type")).alias("h"),
        SC.key_prefix(SC.hash_key(F.col("event_type"))).alias("prefix"),
        SC.trim_space(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("trimmed"),
        SC.is_web_url(url).alias("web"),
        F.upper("event_type").alias("u"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("none")).alias("nn"),
        F.array_join(F.array("event_type", F.lit("x")), ", ").alias("joined"),
        R.top_k_limit(F.when(F.col("user_id") % 4 != 0, F.col("user_id"))).alias("top_k"),
    )


