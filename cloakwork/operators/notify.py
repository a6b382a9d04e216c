"""Alerts from telemetry, and the outbox of notifications. The same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import broadcast_if_small
from .directory import delivery_targets

#: The alert kind of everything raised here.
RISK_ALERT = "risk_alert"


def event_alerts(events: DataFrame) -> DataFrame:
    """One alert for each event that caught something."""
    outcome = F.col("outcome")
    verb = F.when(outcome == "block", "blocked").when(outcome == "redact", "redacted").otherwise("flagged")
    what = F.when(F.size("labels") > 0, F.array_join("labels", ", ")).otherwise("sensitive data")
    return events.filter(F.col("count") > 0).select(
        *[c for c in ("event_id", "org_id") if c in events.columns],
        F.when(outcome == "block", "high").when(outcome == "redact", "medium").otherwise("low").alias("severity"),
        F.concat_ws(" ", verb, what, F.lit("on"), "site").alias("message"),
        F.lit("open").alias("status"),
        *[c for c in ("created_at",) if c in events.columns],
    )


def render_payload(slug: Column, alert: dict[str, Column], source: str) -> Column:
    """The JSON body for a target: a line of text for chat tools, an envelope for the rest.

    `alert` gives the columns kind, severity, message, org_id and at; `source` names the sender.
    """
    line = F.concat(F.lit(f"*{source}* ["), F.upper(alert["severity"]), F.lit("] "), alert["message"])
    keep_nulls = {"ignoreNullFields": "false"}
    text = F.to_json(F.struct(line.alias("text")), keep_nulls)
    envelope = F.to_json(
        F.struct(
            F.lit(source.lower()).alias("source"),
            alert["kind"].alias("kind"),
            alert["severity"].alias("severity"),
            alert["message"].alias("message"),
            alert["org_id"].cast("string").alias("orgId"),
            alert["at"].alias("at"),
        ),
        keep_nulls,
    )
    return F.when(slug.isin("slack", "teams"), text).otherwise(envelope)


def alert_fan_out(alerts: DataFrame, integrations: DataFrame, source: str) -> DataFrame:
    """One outbox row per alert and delivery target of its organisation.

    An organisation has at most three targets, so they travel as one array per organisation: the join never
    multiplies rows, the explode does so by three at most.
    """
    targets = (
        delivery_targets(integrations).groupBy("org_id").agg(F.array_sort(F.collect_list(F.struct("slug", "url"))).alias("_targets"))
    )
    out = alerts.join(broadcast_if_small(targets), "org_id").withColumn("_t", F.explode("_targets"))
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = {
        "kind": F.lit(RISK_ALERT),
        "severity": F.col("severity"),
        "message": F.col("message"),
        "org_id": F.col("org_id"),
        "at": at,
    }
    return out.select(
        *alerts.columns,
        F.col("_t.slug").alias("slug"),
        F.col("_t.url").alias("url"),
        render_payload(F.col("_t.slug"), fields, source).alias("payload"),
    )
