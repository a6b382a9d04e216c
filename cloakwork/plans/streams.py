"""Registered queries: events, answer streams, notifications, and the streaming operators run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import notify as N
from ..sources import frames as FR
from ..sources.events import accepted, parse_events, rejected
from ..streaming import answers as SA
from ..streaming import counters as SC
from .check_sql import redact_ctes, scan_ctes
from .registry import STAMP_SQL, Inputs, register, stamp
from .reports import _BUSY, _LIMIT, _events
from .session import fresh_path, spread

SOURCE = "Cloakwork"


def finish(t: Inputs, writer: DataStreamWriter) -> None:
    """Run a stream over everything there is, and wait for it."""
    query = writer.option("checkpointLocation", fresh_path(t.spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()


# --- events ---------------------------------------------------------------------------------------------------


def _payloads(events: DataFrame) -> DataFrame:
    """Events as the JSON a browser would send: defaults are left out."""
    body = F.to_json(
        F.struct(
            "site",
            "host",
            "action",
            F.when(F.col("labels_csv") != "", F.split("labels_csv", ",")).alias("labels"),
            F.when(F.col("count") > 0, F.col("count")).alias("count"),
            F.when(F.col("outcome") != "flag", F.col("outcome")).alias("outcome"),
        )
    )
    return events.select("event_id", "org_id", "created_at", body.alias("body"))


#: What a broken or hostile client sends instead of an event.
_GARBAGE = (
    "{oops",
    "[1]",
    '{"site":"a"}',
    '{"site":1,"host":"h","action":"paste"}',
    '{"site":"a","host":"h","action":"paste","labels":"EMAIL"}',
    '{"site":"a","host":"h","action":"paste","labels":null}',
    '{"site":"a","host":"h","action":"paste","labels":["EMAIL",null]}',
    '{"site":"a","host":"h","action":"paste","outcome":null}',
    '{"site":"a","host":"h","action":"paste","count":null}',
    '{"site":"a","host":"h","action":"paste","count":3000000000}',
    '{"site":"a","host":"h","action":"paste","count":1.5}',
)


def _with_garbage(payloads: DataFrame) -> DataFrame:
    """The payloads, and after every seventh event one that is to be refused."""
    bad = F.get(F.array(*[F.lit(g) for g in _GARBAGE]), (F.col("event_id") % len(_GARBAGE)).cast("int"))
    return payloads.unionByName(payloads.filter("event_id % 7 = 0").withColumn("body", bad))


_EVENT_SQL = "select event_id, org_id, site, host, action, labels_csv as labels, count, outcome from shadow_events"
_ALERT_SQL = "select alert_id as event_id, org_id, severity, message, 'open' as status, " + STAMP_SQL.format("created_at") + " as created_at from risk_alerts"


@register("parse_events", _EVENT_SQL, "shadow_events")
def parse(t: Inputs):
    out = accepted(parse_events(_with_garbage(_payloads(t("shadow_events"))), "body"))
    return out.drop("created_at").withColumn("labels", F.array_join("labels", ","))


@register("rejected_events", f"select event_id, case event_id % {len(_GARBAGE)} " + " ".join(f"when {i} then '{g}'" for i, g in enumerate(_GARBAGE)) + " end as body from shadow_events where event_id % 7 = 0", "shadow_events")
def rejected_events(t: Inputs):
    return rejected(_with_garbage(_payloads(t("shadow_events"))), "body").select("event_id", "body")


@register("event_alerts", _ALERT_SQL, "risk_alerts")
def event_alerts(t: Inputs):
    return N.event_alerts(_events(t)).withColumn("created_at", stamp("created_at"))


@register(
    "stream_ingest_events",
    f"select 'event' as kind, event_id, site || ':' || labels || ':' || count || ':' || outcome as what from ({_EVENT_SQL}) "
    f"union all select 'alert', event_id, severity || ':' || message from ({_ALERT_SQL})",
    "shadow_events risk_alerts",
)
def stream_ingest_events(t: Inputs):
    events, alerts = fresh_path(t.spark, "shadow_events"), fresh_path(t.spark, "risk_alerts")
    finish(t, SC.ingest(accepted(parse_events(_payloads(t.stream("shadow_events", "events")), "body")), events, alerts))
    stored = t.spark.read.parquet(events)
    what = F.concat_ws(":", "site", F.array_join("labels", ","), F.col("count").cast("string"), "outcome")
    return stored.select(F.lit("event").alias("kind"), "event_id", what.alias("what")).unionByName(
        t.spark.read.parquet(alerts).select(F.lit("alert").alias("kind"), "event_id", F.concat_ws(":", "severity", "message").alias("what"))
    )


# --- notifications --------------------------------------------------------------------------------------------

_TARGETS = (
    "targets as (select org_id, slug, json_extract_string(config, '$.url') as url from integrations where installed and slug in ('slack', 'teams', 'webhooks') "
    "and coalesce(json_extract_string(config, '$.url'), '') <> '')"
)
_PAYLOAD = (
    "case when slug in ('slack', 'teams') then to_json({{'text': '*{s}* [' || upper(severity) || '] ' || message}}) else "
    "to_json({{'source': '{l}', 'kind': 'risk_alert', 'severity': severity, 'message': message, 'orgId': cast(org_id as varchar), "
    "'at': strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')}}) end"
).format(s=SOURCE, l=SOURCE.lower())
_OUTBOX = f"with {_TARGETS} select alert_id, org_id, slug, url, cast({_PAYLOAD} as varchar) as payload from risk_alerts join targets using (org_id)"


@register("alert_fan_out", _OUTBOX.replace(f", cast({_PAYLOAD} as varchar) as payload", ""), "risk_alerts integrations")
def alert_fan_out(t: Inputs):
    return N.alert_fan_out(t("risk_alerts"), t("integrations"), SOURCE).select("alert_id", "org_id", "slug", "url")


@register("render_payload", _OUTBOX.replace("alert_id, org_id, slug, url", "alert_id, slug"), "risk_alerts integrations")
def render_payload(t: Inputs):
    return N.alert_fan_out(t("risk_alerts"), t("integrations"), SOURCE).select("alert_id", "slug", "payload")


@register("stream_fan_out", _OUTBOX, "risk_alerts integrations")
def stream_fan_out(t: Inputs):
    path = fresh_path(t.spark, "outbox")
    alerts = t.stream("risk_alerts", "events")
    finish(t, N.alert_fan_out(alerts, t("integrations"), SOURCE).writeStream.format("parquet").option("path", path))
    return t.spark.read.parquet(path).select("alert_id", "org_id", "slug", "url", "payload")


# --- answers --------------------------------------------------------------------------------------------------

_PIECE = 23


def _frames(choices: DataFrame) -> DataFrame:
    """Answers as event streams: a role frame, the text in pieces, a finish frame, the end marker."""

    def chunk(delta, reason=None):
        choice = F.struct(delta.alias("delta"), (F.lit(None) if reason is None else F.lit(reason)).cast("string").alias("finish_reason"))
        body = F.struct(F.concat(F.lit("c"), "message_id").alias("id"), F.lit("m-1").alias("model"), F.array(choice).alias("choices"))
        return F.concat(F.lit("data: "), F.to_json(body, {"ignoreNullFields": "false"}), F.lit("\n\n"))

    starts = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / _PIECE).cast("int"))
    texts = F.transform(starts, lambda i: chunk(F.struct(F.substr("content", i * _PIECE + 1, F.lit(_PIECE)).alias("content"))))
    role = F.array(chunk(F.struct(F.lit("assistant").alias("role"))))
    end = F.array(
        chunk(F.expr("cast(map() as map<string,string>)"), "stop"), F.lit("data: not json\n\n"), F.lit("data: [DONE]\n\n")
    )
    return choices.select(
        F.col("message_id").cast("string").alias("stream_id"),
        (F.col("request_id") % 25).alias("org_id"),
        F.posexplode(F.concat(role, texts, end)).alias("seq", "raw"),
    )


_PIECES = (
    "pieces as (select cast(message_id as varchar) as stream_id, unnest(generate_series(0, (length(content) - 1) // {p})) as i, content, "
    "(length(content) - 1) // {p} as last from choices)"
).format(p=_PIECE)
_FRAMES_SQL = (
    f"with {_PIECES} select stream_id, i + 1 as seq, substring(content, i * {_PIECE} + 1, {_PIECE}) as content, cast(null as varchar) as finish, false as done, false as passthrough from pieces "
    "union all select stream_id, 0, null, null, false, true from pieces where i = 0 union all select stream_id, last + 2, null, 'stop', false, false from pieces where i = 0 "
    "union all select stream_id, last + 3, null, null, false, true from pieces where i = 0 union all select stream_id, last + 4, null, null, true, false from pieces where i = 0"
)


@register("parse_stream_frames", _FRAMES_SQL, "choices")
def parse_stream_frames(t: Inputs):
    return FR.parse_frames(_frames(spread(t("choices"))), "raw").select("stream_id", "seq", "content", "finish", "done", "passthrough")


_ROLE_FRAME = """'{"id":"c' || stream_id || '","model":"m-1","choices":[{"delta":{"role":"assistant"},"finish_reason":null}]}'"""


@register(
    "passthrough_frames",
    f"with {_PIECES} select stream_id, 0 as seq, {_ROLE_FRAME} as payload from pieces where i = 0 union all select stream_id, last + 3, 'not json' from pieces where i = 0".replace("0 as seq", "cast(0 as bigint) as seq"),
    "choices",
)
def passthrough_frames(t: Inputs):
    return FR.parse_frames(_frames(spread(t("choices"))), "raw").filter("passthrough").select("stream_id", "seq", "payload")


@register(
    "frame_output",
    "select cast(message_id as varchar) as stream_id, 'data: ' || cast(to_json({'choices': [{'delta': {'content': content}, 'finish_reason': cast(null as varchar), 'index': 0}], "
    "'id': 'c' || message_id, 'model': '', 'object': 'chat.completion.chunk'}) as varchar) || chr(10) || chr(10) as frame from choices",
    "choices",
)
def frame_output(t: Inputs):
    texts = t("choices").select(F.col("message_id").cast("string").alias("stream_id"), "content")
    frame = FR.content_frame(F.concat(F.lit("c"), "stream_id"), F.lit(None).cast("string"), F.col("content"))
    return texts.select("stream_id", frame.alias("frame"))


@register(
    "finish_frames",
    "select cast(message_id as varchar) as stream_id, 'data: {\"choices\":[{\"delta\":{},\"finish_reason\":\"' || case when message_id % 5 = 0 then 'length' else 'stop' end || "
    "'\",\"index\":0}],\"id\":\"c' || message_id || '\",\"model\":\"m\",\"object\":\"chat.completion.chunk\"}' || chr(10) || chr(10) as frame from choices",
    "choices",
)
def finish_frames(t: Inputs):
    ends = t("choices").select(F.col("message_id").cast("string").alias("stream_id"), F.when(F.col("message_id") % 5 == 0, "length").otherwise("stop").alias("reason"))
    return ends.select("stream_id", FR.finish_frame(F.concat(F.lit("c"), "stream_id"), F.lit("m"), F.col("reason")).alias("frame"))


_OUTBOUND = "outbound as (select org_id from policies group by org_id having bool_or(enabled and action not in ('block', 'flag') and len(patterns) > 0))"
_MASKED = (
    f"with {_OUTBOUND}, answers as (select message_id, request_id % 25 as org_id, content from choices where request_id % 25 in (select org_id from outbound)), "
    + scan_ctes("answers", "message_id", "content")
    + ", "
    + redact_ctes("answers", "message_id", "content", name="masked_all", where="true")
)


@register(
    "redact_finished_streams",
    _MASKED + " select cast(message_id as varchar) as stream_id, text from masked_all union all select cast(message_id as varchar), content from choices "
    "where request_id % 25 not in (select org_id from outbound)",
    "choices policies",
)
def redact_finished_streams(t: Inputs):
    return SA.redact_finished(_frames(spread(t("choices"))), t("policies")).select("stream_id", "text")


@register(
    "stream_redact",
    _MASKED + " select cast(message_id as varchar) as stream_id, text, true as finished, true as ended from masked_all",
    "choices policies",
)
def stream_redact(t: Inputs):
    path = fresh_path(t.spark, "answers")
    redacted = SA.stream_redact(_frames(t.stream("choices", "conversations")), t("policies"))
    finish(t, redacted.writeStream.format("parquet").option("path", path))
    out = t.spark.read.parquet(path)
    per_stream = out.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "content", F.struct("seq", "part", "text")))).alias("d"),
        F.bool_or(F.col("kind") == "finish").alias("finished"),
        F.bool_or(F.col("kind") == "done").alias("ended"),
    )
    text = F.array_join(F.transform("d", lambda x: x["text"]), "")
    # answers that pass unchanged have raw frames only
    return per_stream.filter("ended").select("stream_id", text.alias("text"), "finished", "ended")


# --- counters -------------------------------------------------------------------------------------------------


@register(
    "stream_quota",
    f"select r.org_id, strftime(day, '%Y-%m-%d') as day, cast(least(count(*), any_value({_LIMIT})) as bigint) as used from {_BUSY} r left join orgs using (org_id) group by r.org_id, day",
    "usage_logs orgs",
)
def stream_quota(t: Inputs):
    path = fresh_path(t.spark, "counters")
    busy = t.stream("usage_logs", "events").withColumn("org_id", F.when(F.col("org_id") < 20, 0).otherwise(F.col("org_id")).cast("bigint"))
    finish(t, SC.count_daily(busy, path))
    return SC.stream_quota(t.spark.read.parquet(path), t("orgs")).withColumn("day", F.col("day").cast("string"))


@register(
    "stream_admit",
    f"select log_id, r.org_id, {_LIMIT} is null or n <= {_LIMIT} as admitted, cast(least(n, {_LIMIT}) as bigint) as used from {_BUSY} r left join orgs using (org_id)",
    "usage_logs orgs",
)
def stream_admit(t: Inputs):
    decisions, counts = fresh_path(t.spark, "decisions"), fresh_path(t.spark, "counts")
    busy = t.stream("usage_logs", "events").withColumn("org_id", F.when(F.col("org_id") < 20, 0).otherwise(F.col("org_id")).cast("bigint"))
    finish(t, SC.admit(busy, t("orgs"), decisions, counts))
    return t.spark.read.parquet(decisions).select("log_id", "org_id", "admitted", "used")


@register(
    "stream_daily_usage",
    "select org_id, strftime(created_at, '%Y-%m-%d') as day, count(*) as queries, count(*) filter (where blocked) as blocked from usage_logs group by all",
    "usage_logs",
)
def stream_daily_usage(t: Inputs):
    path = fresh_path(t.spark, "daily")
    finish(t, SC.count_daily(t.stream("usage_logs", "events"), path, {"blocked": F.count_if("blocked")}))
    days = SC.totals(t.spark.read.parquet(path)).withColumnRenamed("requests", "queries")
    return days.withColumn("day", F.col("day").cast("string"))


