"""Registered queries: scans of tables, request parsing and the audit pipeline."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources import requests as R
from ..sources import tables as TB
from .check_sql import scan_ctes
from .registry import STAMP_SQL, Inputs, register, stamp
from .session import fresh_path, spread


@register("scan_table", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey from customer where c_nationkey = 7")
def scan_table(t: Inputs):
    path = os.path.join(t.sf_dir, "customer.parquet")
    rows = TB.read_table(t.spark, path, ["c_custkey", "c_name", "c_nationkey"])
    return rows.filter("c_nationkey = 7")


@register(
    "read_org_log",
    "select log_id, org_id, redactions, strftime(created_at, '%Y-%m-%d') as day from usage_logs where org_id = 7",
    "usage_logs",
)
def read_org_log(t: Inputs):
    """The whole log in the layout of stored tables, and one organisation read from it."""
    path = fresh_path(t.spark, "usage_logs")
    TB.append(t("usage_logs").withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), path, ids=("log_id",))
    rows = TB.read_table(t.spark, path, ["log_id", "org_id", "redactions", "day"], org=7)
    return rows.withColumn("day", F.col("day").cast("string"))


def _turns(t: Inputs):
    """Requests with their messages in order; a conversation's turns are gathered once, at the source."""
    turns = t("messages").groupBy(F.col("conv_id").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m")
    )
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return t("request_headers").join(turns, "request_id").withColumn("messages", messages).drop("m")


def _responses(t: Inputs):
    gathered = t("choices").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content"))).alias("choices"))
    return gathered.select(
        "*",
        F.concat(F.lit("answer-"), F.col("request_id") % 5).alias("model"),
        F.when(F.col("request_id") % 4 != 0, F.col("request_id") + 100).alias("prompt_tokens"),
        F.when(F.col("request_id") % 4 != 0, F.col("request_id") + 200).alias("completion_tokens"),
    )


def _answers(t: Inputs):
    return t("request_headers").select("request_id", "org_id").join(_responses(t), "request_id")


@register(
    "parse_chat_requests",
    "select request_id, model, stream, cast(null as double) is null as no_temp, cast(256 as bigint) as max_tokens, 'u-' || user_id as extra_user, "
    "'{\"a\":[1,2]}' as extra_tags, n, first, ok as valid from request_headers join (select conv_id as request_id, count(*) as n, "
    "arg_min(content, turn) as first, true as ok from messages group by conv_id) using (request_id)",
    "request_headers messages",
)
def parse_chat_requests(t: Inputs):
    req = _turns(t)
    body = F.to_json(
        F.struct(
            "model",
            "messages",
            F.when(F.col("stream"), True).alias("stream"),  # left out when false
            F.lit(256).alias("max_tokens"),
            F.concat(F.lit("u-"), F.col("user_id")).alias("user"),
            F.struct(F.array(F.lit(1), F.lit(2)).alias("a")).alias("tags"),
        )
    )
    out = R.parse_requests(req.select("request_id", body.alias("body")), "body")
    return out.select(
        "request_id",
        "model",
        "stream",
        F.col("temperature").isNull().alias("no_temp"),
        "max_tokens",
        F.col("extra")["user"].alias("extra_user"),
        F.col("extra")["tags"].alias("extra_tags"),
        F.size("messages").alias("n"),
        F.col("messages")[0]["content"].alias("first"),
        "valid",
    )


# Every text of the pipeline in one relation: inbound messages, and answers under ids of their own.
_PIPELINE = (
    "with msgs as (select message_id, conv_id, turn, role, conv_id % 25 as org_id, content from messages), "
    "texts as (select message_id, org_id, content from msgs where role <> 'assistant' union all "
    "select 1000000000000 + message_id, request_id % 25, content from choices), "
    + scan_ctes("texts", "message_id", "content")
    + ", per as (select m.conv_id, m.turn, coalesce(s.text, m.content) as text, coalesce(s.n_findings, 0) as n, coalesce(s.blocked, false) as b "
    "from msgs m left join scanned s using (message_id)), "
    "inb as (select conv_id as request_id, bool_or(b) as blocked, cast(case when bool_or(b) then arg_min(n, turn) filter (where b) else sum(n) end as bigint) as redactions, "
    "string_agg(text, chr(10) order by turn) as snapshot from per group by conv_id), "
    "outb as (select c.request_id, cast(sum(s.n_findings) as bigint) as redactions, string_agg(s.text, '' order by idx) as response_text "
    "from choices c join scanned s on s.message_id = 1000000000000 + c.message_id group by c.request_id), "
    "rte as (select org_id, bool_or(route = 'selfhosted') as sh from policies where enabled group by org_id), "
    "base as (select h.request_id as log_id, h.org_id, h.user_id, h.day, h.latency_ms, case when coalesce(sh, false) then 'selfhosted' else 'cloud' end as route, i.blocked, "
    "h.stream and not i.blocked as streamed, not i.blocked and not h.stream as answered, h.model as asked_model, i.redactions as r_in, i.snapshot, "
    "o.redactions as r_out, o.response_text, o.request_id is not null as has_answer, h.request_id % 4 <> 0 as has_usage, zero_retention "
    "from request_headers h join inb i using (request_id) left join outb o using (request_id) left join rte using (org_id) left join orgs g using (org_id)), "
    "usage_rows as (select log_id, org_id, user_id, day, latency_ms, route, case route when 'cloud' then 'openai' else 'ollama' end as provider, "
    "case when answered and has_answer then 'answer-' || (log_id % 5) else asked_model end as model, "
    "case when answered and has_answer and has_usage then log_id + 100 else 0 end as prompt_tokens, "
    "case when answered and has_answer and has_usage then log_id + 200 else 0 end as output_tokens, "
    "r_in + case when answered then coalesce(r_out, 0) else 0 end as redactions, blocked, streamed, "
    "case when not blocked and not coalesce(zero_retention, false) then snapshot end as prompt_body, "
    "case when answered and not coalesce(zero_retention, false) then response_text end as response_body from base), "
    "alert_rows as (select org_id, case when blocked then log_id end as log_id, case when blocked then 'high' else 'medium' end as severity, "
    "case when blocked then 'Request blocked by DLP policy' else redactions || ' sensitive field(s) redacted' end as message, 'open' as status, day "
    "from usage_rows where blocked or (redactions > 0 and not streamed)) "
)
_READS = "messages choices request_headers policies orgs"


@register("scan_inbound", _PIPELINE + "select request_id, blocked, redactions from inb", _READS)
def scan_inbound(t: Inputs):
    messages = spread(t("messages")).withColumn("org_id", F.col("conv_id") % 25)
    return A.scan_inbound_rows(messages.withColumnRenamed("conv_id", "request_id"), t("policies"), "request_id", "turn")


@register("scan_inbound_arrays", _PIPELINE + "select request_id, blocked, redactions from inb", _READS)
def scan_inbound_arrays(t: Inputs):
    return A.scan_inbound(_turns(t), t("policies")).select("request_id", "blocked", "redactions")


@register("prompt_snapshot", _PIPELINE + "select request_id, case when not blocked then snapshot end as snapshot from inb", _READS)
def prompt_snapshot(t: Inputs):
    # a filter on `blocked` would be pushed below the scan and repeat it; a condition in the projection is not
    done = A.scan_inbound(_turns(t), t("policies"))
    return done.select("request_id", F.when(~F.col("blocked"), A.prompt_snapshot(F.col("messages"))).alias("snapshot"))


_ALL_TURNS = (
    "with msgs as (select message_id, conv_id, turn, role, conv_id % 25 as org_id, content from messages), "
    + scan_ctes("msgs", "message_id", "content")
    + " select conv_id as request_id, case when not bool_or(s.blocked and role <> 'assistant') then string_agg(s.text, chr(10) order by turn) end as snapshot "
    "from msgs join scanned s using (message_id) where conv_id in (select request_id from request_headers) group by conv_id"
)


@register("prompt_snapshot_scanned", _ALL_TURNS, "messages request_headers policies")
def prompt_snapshot_scanned(t: Inputs):
    done = A.scan_inbound(_turns(t), t("policies"))
    return done.select("request_id", F.when(~F.col("blocked"), A.prompt_snapshot_scanned(F.col("messages"), F.col("plan"))).alias("snapshot"))


@register("scan_outbound", _PIPELINE + "select * from outb", _READS)
def scan_outbound(t: Inputs):
    done = A.scan_outbound(_answers(t), t("policies"))
    return done.select("request_id", F.col("out_redactions").alias("redactions"), "response_text")


def _usage(t: Inputs):
    return A.usage_rows(_turns(t), _responses(t), t("policies"), t("orgs"))


@register("usage_log_rows", _PIPELINE + "select * from usage_rows", _READS)
def usage_log_rows(t: Inputs):
    return _usage(t)


@register("zero_retention_bodies", _PIPELINE + "select log_id, prompt_body is null as no_prompt, response_body is null as no_response, redactions from usage_rows", _READS)
def zero_retention_bodies(t: Inputs):
    return _usage(t).select("log_id", F.col("prompt_body").isNull().alias("no_prompt"), F.col("response_body").isNull().alias("no_response"), "redactions")


@register("request_alerts", _PIPELINE + "select * from alert_rows", _READS)
def request_alerts(t: Inputs):
    return A.request_alerts(_usage(t))


@register("write_usage_log", _PIPELINE + "select log_id, org_id, day, model, redactions, blocked, response_body from usage_rows", _READS)
def write_usage_log(t: Inputs):
    path = fresh_path(t.spark, "usage_logs")
    TB.append(_usage(t), path, ids=("log_id",))
    cols = ["log_id", "org_id", "day", "model", "redactions", "blocked", "response_body"]
    return TB.read_table(t.spark, path, cols).withColumn("day", F.col("day").cast("string"))


@register("write_alerts", _PIPELINE + "select * from alert_rows", _READS)
def write_alerts(t: Inputs):
    path = fresh_path(t.spark, "risk_alerts")
    TB.append(A.request_alerts(_usage(t)), path)
    rows = TB.read_table(t.spark, path, ["org_id", "log_id", "severity", "message", "status", "day"])
    return rows.withColumn("day", F.col("day").cast("string"))


_ACTIVITY_SQL = (
    "select e.event_id, coalesce(u.name, 'Someone') as actor, e.event_type as action, 'k' || (e.event_id % 9) as target, strftime(e.ts, '%Y-%m-%d') as day "
    "from events e left join users u on u.user_id = e.user_id + 7"
)


@register("write_activity", _ACTIVITY_SQL, "events users")
def write_activity(t: Inputs):
    events = t("events").select(
        "event_id",
        (F.col("user_id") + 7).alias("actor_id"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("k"), F.col("event_id") % 9).alias("target"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    path = fresh_path(t.spark, "activity")
    TB.append(A.activity_rows(events, t("users")), path)
    rows = TB.read_table(t.spark, path, ["event_id", "actor", "action", "target", "day"])
    return rows.withColumn("day", F.col("day").cast("string"))


@register("provider_of_route", "select log_id, case route when 'cloud' then 'openai' else 'ollama' end as provider from usage_logs", "usage_logs")
def provider_of_route(t: Inputs):
    return t("usage_logs").select("log_id", A.provider(F.col("route")).alias("provider"))


_KEYED = (
    "with k as (select *, sha256(secret) as key_hash from api_keys), r as (select event_id, cast(ts as timestamp) as ts, "
    "case when event_id % 10 = 9 then 'ck_unknown' else 'ck_' || lpad(cast(user_id as varchar), 12, '0') end as presented from events), "
    "att as (select event_id, ts, key_id, k.org_id, k.user_id, plan, zero_retention from r join k on k.key_hash = sha256(presented) join orgs o on o.org_id = k.org_id where not revoked) "
)


def _attributed(t: Inputs):
    presented = F.when(F.col("event_id") % 10 == 9, "ck_unknown").otherwise(
        F.concat(F.lit("ck_"), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    )
    requests = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), presented.alias("presented_key"))
    return A.attribute(requests, t("api_keys").withColumn("key_hash", F.sha2("secret", 256)), t("orgs"))


@register("attribute_keys", _KEYED + "select event_id, key_id, org_id, user_id, plan, zero_retention from att", "api_keys events orgs")
def attribute_keys(t: Inputs):
    return _attributed(t).select("event_id", "key_id", "org_id", "user_id", "plan", "zero_retention")


@register(
    "last_seen",
    _KEYED + f"select 'key ' || key_id as what, {STAMP_SQL.format('max(ts)')} as last_seen from att group by key_id union all "
    f"select 'site ' || org_id || ' ' || site, {STAMP_SQL.format('max(created_at)')} from shadow_events group by org_id, site",
    "api_keys events orgs shadow_events",
)
def last_seen(t: Inputs):
    keys = A.key_last_used(_attributed(t)).select(F.concat(F.lit("key "), "key_id").alias("what"), stamp("last_used").alias("last_seen"))
    sites = t("shadow_events").groupBy("org_id", "site").agg(F.max("created_at").alias("at"))
    return keys.unionByName(sites.select(F.concat(F.lit("site "), "org_id", F.lit(" "), "site").alias("what"), stamp("at").alias("last_seen")))


