"""Dashboard reports, for all organisations at once (one organisation is a filter before the call).

Nothing reads the clock: `as_of` is an argument. Facts are aggregated or cut to k rows before they meet a dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import clamp, clock_text, day_text, minute_text, second_text
from ..plans.sizing import broadcast_if_small


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)


def org_kpis(users: DataFrame, usage: DataFrame, alerts: DataFrame, orgs: DataFrame, as_of: str) -> DataFrame:
    """Active users, requests of the day of `as_of`, alerts not resolved, and compliance over the last 7 days.

    One pass over each table. The time bounds stand as plain ranges so that they reach the scan.
    """
    now = F.lit(as_of).cast("timestamp")
    day = F.date_trunc("day", now)
    next_day = day + F.expr("interval 1 day")
    week = now - F.expr("interval 7 days")
    in_day = (F.col("created_at") >= day) & (F.col("created_at") < next_day)
    in_week = F.col("created_at") > week
    active = users.filter("status = 'active'").groupBy("org_id").agg(F.count("*").alias("active_users"))
    recent = (
        usage.filter(F.col("created_at") >= F.least(day, week))
        .groupBy("org_id")
        .agg(
            F.count_if(in_day).alias("queries_today"),
            F.count_if(in_week).alias("n"),
            F.count_if(in_week & F.col("blocked")).alias("b"),
        )
    )
    open_alerts = (
        alerts.filter(F.col("status").isin("open", "investigating")).groupBy("org_id").agg(F.count("*").alias("risk_incidents"))
    )
    share = F.col("b").cast("decimal(20,0)") / F.expr("nullif(n, 0)").cast("decimal(20,0)")
    score = F.round(F.lit(100).cast("decimal(5,1)") * (F.lit(1).cast("decimal(2,0)") - share), 0).cast("bigint")
    return (
        orgs.select("org_id")
        .join(active, "org_id", "left")
        .join(recent, "org_id", "left")
        .join(open_alerts, "org_id", "left")
        .select(
            "org_id",
            _zero("active_users"),
            _zero("queries_today"),
            _zero("risk_incidents"),
            F.coalesce(score, F.lit(100).cast("bigint")).alias("compliance_score"),
        )
    )


def day_series(orgs: DataFrame, as_of: str, days: int = 10) -> DataFrame:
    """(org_id, day): the last `days` days up to `as_of` for every organisation."""
    last = F.to_date(F.lit(as_of))
    return orgs.select("org_id", F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))


def per_day(facts: DataFrame, name: str, as_of: str, days: int) -> DataFrame:
    """Rows per organisation and day; the range is filtered here because the outer join would not pass it on."""
    last = F.to_date(F.lit(as_of))
    lower = F.date_sub(last, days - 1).cast("timestamp")
    upper = F.date_add(last, 1).cast("timestamp")
    in_range = facts.filter((F.col("created_at") >= lower) & (F.col("created_at") < upper))
    return in_range.groupBy("org_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias(name))


def daily_usage(usage: DataFrame, alerts: DataFrame, orgs: DataFrame, as_of: str, days: int = 10) -> DataFrame:
    """Zero-filled requests and incidents per organisation and day."""
    return usage_series(per_day(usage, "queries", as_of, days), per_day(alerts, "incidents", as_of, days), orgs, as_of, days)


def usage_series(queries: DataFrame, incidents: DataFrame, orgs: DataFrame, as_of: str, days: int = 10) -> DataFrame:
    """`daily_usage` from counts per organisation and day: (org_id, day, queries) and (org_id, day, incidents)."""
    return (
        day_series(orgs, as_of, days)
        .join(queries, ["org_id", "day"], "left")
        .join(incidents, ["org_id", "day"], "left")
        .select("org_id", "day", day_text("day").alias("date"), _zero("queries"), _zero("incidents"))
    )


def latest_k(df: DataFrame, part: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per group in `order`.

    The rank filter lets Spark cut every input partition to k rows per group before the shuffle, so a group that
    holds most of the rows sends no more than k from each task.
    """
    keys = [part] if isinstance(part, str) else part
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def newest(ident: str, ts: str = "created_at") -> list[Column]:
    return [F.desc(ts), F.col(ident)]


def alerts_feed(alerts: DataFrame, teams: DataFrame, k: int = 50) -> DataFrame:
    """Newest alerts per organisation with the team's name; cut to k first, joined after."""
    top = latest_k(alerts, "org_id", newest("alert_id"), k)
    names = broadcast_if_small(teams.select("team_id", F.col("name").alias("team")))
    return top.join(names, "team_id", "left").select(
        "org_id", "alert_id", clock_text("created_at").alias("timestamp"), F.coalesce("team", F.lit("Org-wide")).alias("team"), "severity", "message", "status"
    )


def activity_feed(activity: DataFrame, k: int = 20) -> DataFrame:
    return latest_k(activity, "org_id", newest("activity_id"), k).select(
        "org_id", "activity_id", clock_text("created_at").alias("timestamp"), F.col("actor").alias("user"), "action", "target"
    )


def events_feed(events: DataFrame, k: int = 100) -> DataFrame:
    return latest_k(events, "org_id", newest("event_id"), k).select(
        "org_id", "event_id", "site", "host", "action", "outcome", "labels", "count", second_text("created_at").alias("at")
    )


def personal_activity(activity: DataFrame, users: DataFrame, k: int = 50) -> DataFrame:
    """Newest activity of each user by name within the organisation; namesakes share a feed."""
    feed = latest_k(activity, ["org_id", "actor"], newest("activity_id"), k)
    who = users.select("user_id", "org_id", F.col("name").alias("actor"))
    return feed.join(who, ["org_id", "actor"]).select("user_id", "activity_id", "action", "target", minute_text("created_at").alias("created_at"))


def site_discovery(events: DataFrame) -> DataFrame:
    return events.groupBy("org_id", "site").agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("items_caught"),
        F.count_if(F.col("outcome") == "block").alias("blocked"),
        F.count_if(F.col("outcome") == "redact").alias("redacted"),
        minute_text(F.max("created_at")).alias("last_seen"),
    )


def label_counts(events: DataFrame) -> DataFrame:
    """How often each label was caught; an event without labels counts nowhere, a repeated label twice."""
    return events.select("org_id", F.explode("labels").alias("label")).groupBy("org_id", "label").agg(F.count("*").alias("count"))


def usage_log_page(usage: DataFrame, org: object, provider: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an organisation's log, newest first; limit kept within 1..500, offset not below 0."""
    rows = usage.filter(F.col("org_id") == F.lit(org))
    if provider is not None:
        rows = rows.filter(F.col("provider") == provider)
    return (
        page(rows, [F.desc("created_at"), F.col("log_id")], limit, offset)
        .withColumn("timestamp", second_text("created_at"))
        .drop("created_at")
    )


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), most))


def personal_stats(usage: DataFrame) -> DataFrame:
    """Prompts, redactions and blocks per user, in one pass."""
    return usage.filter("user_id is not null").groupBy("org_id", "user_id").agg(
        F.count("*").alias("total_prompts"),
        F.coalesce(F.sum("redactions"), F.lit(0)).cast("bigint").alias("total_redactions"),
        F.count_if("blocked").alias("total_blocks"),
    )


#: Characters of the last message shown in a conversation list.
PREVIEW = 80


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with the start of their latest message; '' when there is none.

    Messages are cut to the preview before they are compared, so no full text is shuffled.
    """
    last = messages.select(
        "conv_id", "created_at", "message_id", F.substring("content", 1, PREVIEW).alias("p")
    ).groupBy("conv_id").agg(F.max_by("p", F.struct("created_at", "message_id")).alias("preview"))
    return conversations.join(last, "conv_id", "left").select(
        "conv_id", "org_id", "user_id", "title", F.date_format("updated_at", "yyyy-MM-dd").alias("date"), F.coalesce("preview", F.lit("")).alias("preview")
    )


def messages_of(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with the organisation of their conversation; orphans are left out."""
    return messages.join(conversations.select("conv_id", "org_id"), "conv_id").select(
        "org_id", "conv_id", "message_id", "role", "content", clock_text("created_at").alias("timestamp")
    )


def flag_owned(df: DataFrame, conversations: DataFrame) -> DataFrame:
    """Adds `owned`: does (conversation, organisation, user) own an existing conversation? One join for both answers."""
    keys = ["conv_id", "org_id", "user_id"]
    own = conversations.select(*keys).distinct().withColumn("owned", F.lit(True))
    return df.join(own, keys, "left").withColumn("owned", F.coalesce("owned", F.lit(False)))


def owned(df: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows whose (conversation, organisation, user) owns an existing conversation."""
    return df.join(conversations.select("conv_id", "org_id", "user_id"), ["conv_id", "org_id", "user_id"], "left_semi")


def not_owned(df: DataFrame, conversations: DataFrame) -> DataFrame:
    return df.join(conversations.select("conv_id", "org_id", "user_id"), ["conv_id", "org_id", "user_id"], "left_anti")


def top_k_limit(k: Column) -> Column:
    """A requested k within 1..20, 5 when not given."""
    return clamp(F.coalesce(k, F.lit(5)), 1, 20)
