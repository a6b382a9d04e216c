"""The audit pipeline over chat requests: scan what goes in and out, log it, raise alerts.

Requests carry `messages array<struct<role,content>>`. Scanning works inside that array, so the only shuffle of the
pipeline is the join of requests with their answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import ROUTE_PROVIDERS
from ..functions.spans import FINDING, scan_text
from ..plans.sizing import broadcast_if_small
from .policies import org_states, with_plan

#: Roles whose messages are scanned on the way in.
INBOUND_ROLES = ("user", "system")


def provider(route: Column) -> Column:
    """Provider name of a route, as logged."""
    name = F.lit(None).cast("string")
    for k, v in ROUTE_PROVIDERS.items():
        name = F.when(route == k, v).otherwise(name)
    return name


def _unscanned(text: Column) -> Column:
    return F.struct(
        text.alias("text"),
        F.expr(f"cast(array() as array<{FINDING}>)").alias("findings"),
        F.lit(0).alias("n_findings"),
        F.lit(False).alias("blocked"),
    )


def scan_inbound(
    requests: DataFrame, policies: DataFrame, has_entities: bool = False, deep_col: str | None = None
) -> DataFrame:
    """Per request: redacted messages, `redactions`, `blocked`, and `first_block` (1-based, 0 for none).

    Assistant messages pass unscanned. A blocked request counts the findings of its first blocking message only.
    With `has_entities` each message brings `entities`, used where `deep_col` (default: always) is true. A frame that
    already has `plan` keeps it.
    """
    planned = requests if "plan" in requests.columns else with_plan(requests, policies)

    def one(m: Column) -> Column:
        ents = m["entities"] if has_entities else None
        if ents is not None and deep_col:
            ents = F.when(F.col(deep_col), ents)
        scanned = scan_text(m["content"], F.col("plan"), ents)
        return F.when(m["role"].isin(*INBOUND_ROLES), scanned).otherwise(_unscanned(m["content"]))

    scans = planned.withColumn("_s", F.transform("messages", one))
    first = F.array_position(F.transform("_s", lambda s: s["blocked"]), True).cast("int")
    total = F.aggregate("_s", F.lit(0), lambda acc, s: acc + s["n_findings"])
    clean = F.zip_with("messages", "_s", lambda m, s: F.struct(m["role"].alias("role"), s["text"].alias("content")))
    return (
        scans.withColumn("first_block", first)
        .withColumn("blocked", F.col("first_block") > 0)
        .withColumn("redactions", F.when(F.col("blocked"), F.get("_s", F.col("first_block") - 1)["n_findings"]).otherwise(total))
        .withColumn("messages", clean)
        .drop("_s")
    )


def scan_inbound_rows(messages: DataFrame, policies: DataFrame, request_col: str, pos_col: str) -> DataFrame:
    """The counters of `scan_inbound` when messages come as rows.

    Each row is scanned where it lies and only small counters are shuffled, combined on the map side first, so a
    request with very many messages is no hot spot.
    """
    scanned = with_plan(messages, policies).withColumn(
        "s",
        F.when(F.col("role").isin(*INBOUND_ROLES), scan_text(F.col("content"), F.col("plan"))).otherwise(_unscanned(F.col("content"))),
    )
    narrow = scanned.select(request_col, pos_col, F.col("s.n_findings").alias("n"), F.col("s.blocked").alias("stop"))
    stopped = F.struct(F.col(pos_col).alias("pos"), F.col("n").alias("n"))
    return (
        narrow.groupBy(request_col)
        .agg(F.sum("n").alias("total"), F.min(F.when(F.col("stop"), stopped)).alias("first"))
        .select(
            request_col,
            F.col("first").isNotNull().alias("blocked"),
            F.coalesce(F.col("first.n").cast("bigint"), F.col("total")).alias("redactions"),
        )
    )


def prompt_snapshot(messages: Column) -> Column:
    """All message contents after redaction, one per line; assistant messages as they came."""
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def prompt_snapshot_scanned(messages: Column, plan: Column) -> Column:
    """Like `prompt_snapshot`, with the assistant messages redacted as well."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.when(m["role"].isin(*INBOUND_ROLES), m["content"]).otherwise(scan_text(m["content"], plan)["text"]),
        ),
        "\n",
    )


def scan_outbound(responses: DataFrame, policies: DataFrame) -> DataFrame:
    """Per answer: redacted choices, their texts run together, and the findings; a block policy does not stop it.

    `choices array<struct<idx,content>>` in order. A frame that already has `plan` keeps it.
    """
    planned = responses if "plan" in responses.columns else with_plan(responses, policies)
    scans = planned.withColumn("_s", F.transform("choices", lambda c: scan_text(c["content"], F.col("plan"))))
    return (
        scans.withColumn("out_redactions", F.aggregate("_s", F.lit(0), lambda acc, s: acc + s["n_findings"]))
        .withColumn("response_text", F.array_join(F.transform("_s", lambda s: s["text"]), ""))
        .withColumn(
            "choices", F.zip_with("choices", "_s", lambda c, s: F.struct(c["idx"].alias("idx"), s["text"].alias("content")))
        )
        .drop("_s")
    )


def usage_rows(requests: DataFrame, responses: DataFrame, policies: DataFrame, orgs: DataFrame) -> DataFrame:
    """One audit row per request, over blocked, streamed and answered ones.

    `requests` are request_id, org_id, user_id, model, stream, messages, and what is to be carried along (latency_ms,
    created_at, day); `responses` request_id, model, prompt_tokens, completion_tokens, choices. What goes in and what comes
    out is scanned as `scan_inbound` and `scan_outbound` do, by one expression over all texts of a request: the states of
    organisations are found once, and each side is shuffled by request once, before it is scanned. Answers to streamed
    requests are redacted as they stream and not looked at here. Organisations of zero retention keep counters, no bodies.
    """
    answers = responses.select(
        "request_id", F.col("model").alias("_answer_model"), "prompt_tokens", "completion_tokens", F.col("choices").alias("_choices")
    )
    carried = [c for c in ("latency_ms", "created_at", "day") if c in requests.columns]
    kept = ["request_id", "org_id", "user_id", "model", "stream", *carried]
    states = broadcast_if_small(org_states(policies, orgs).drop("deep_scan", "rag_enabled"))
    met = requests.select(*kept, "messages").join(states, "org_id", "left").join(answers, "request_id", "left")

    none = F.expr("cast(array() as array<struct<text:string,looked_at:boolean>>)")
    asked = F.transform("messages", lambda m: F.struct(m["content"].alias("text"), m["role"].isin(*INBOUND_ROLES).alias("looked_at")))
    told = F.transform("_choices", lambda c: F.struct(c["content"].alias("text"), (~F.col("stream")).alias("looked_at")))
    texts = F.concat(F.coalesce(asked, none), F.coalesce(told, none))
    scans = F.transform(texts, lambda x: F.when(x["looked_at"], scan_text(x["text"], F.col("plan"))).otherwise(_unscanned(x["text"])))
    passed = [*kept, "route", "zero_retention", "_answer_model", "prompt_tokens", "completion_tokens"]
    n_in, n_all = F.coalesce(F.size("messages"), F.lit(0)), F.greatest(F.size("_s"), F.lit(1))
    sides = met.select(*passed, "messages", "_choices", scans.alias("_s")).select(
        *passed,
        F.slice("_s", F.lit(1), n_in).alias("_in"),
        F.when(F.col("_choices").isNotNull(), F.slice("_s", n_in + 1, n_all)).alias("_out"),
        F.coalesce(F.array_position(F.transform("_s", lambda s: s["blocked"]), True).cast("int"), F.lit(0)).alias("_first"),
        n_in.alias("_n_in"),
    )

    def count(scans: str) -> Column:
        return F.coalesce(F.aggregate(scans, F.lit(0), lambda acc, s: acc + s["n_findings"]), F.lit(0))

    def joined(scans: str, between: str) -> Column:
        return F.array_join(F.transform(scans, lambda s: s["text"]), between)

    # a blocking match in an answer does not stop it
    blocked = (F.col("_first") > 0) & (F.col("_first") <= F.col("_n_in"))
    answered = ~blocked & ~F.col("stream")
    bodies = ~F.coalesce("zero_retention", F.lit(False))
    found = F.when(blocked, F.get("_in", F.col("_first") - 1)["n_findings"]).otherwise(count("_in"))
    return sides.select(
        F.col("request_id").alias("log_id"),
        "org_id",
        "user_id",
        F.when(answered, F.coalesce("_answer_model", "model")).otherwise(F.col("model")).alias("model"),
        provider(F.col("route")).alias("provider"),
        "route",
        F.when(answered, F.coalesce("prompt_tokens", F.lit(0))).otherwise(0).alias("prompt_tokens"),
        F.when(answered, F.coalesce("completion_tokens", F.lit(0))).otherwise(0).alias("output_tokens"),
        (found + F.when(answered, count("_out")).otherwise(0)).alias("redactions"),
        blocked.alias("blocked"),
        (F.col("stream") & ~blocked).alias("streamed"),
        F.when(bodies & ~blocked, joined("_in", "\n")).alias("prompt_body"),
        F.when(bodies & answered, joined("_out", "")).alias("response_body"),
        *carried,
    )


def request_alerts(usage: DataFrame) -> DataFrame:
    """A high alert linked to the log row for a block; a medium one, unlinked, for redactions in an answered request."""
    told = F.col("blocked") | ((F.col("redactions") > 0) & ~F.col("streamed"))
    return usage.filter(told).select(
        "org_id",
        F.when(F.col("blocked"), F.col("log_id")).alias("log_id"),
        F.when(F.col("blocked"), "high").otherwise("medium").alias("severity"),
        F.when(F.col("blocked"), "Request blocked by DLP policy")
        .otherwise(F.concat(F.col("redactions").cast("string"), F.lit(" sensitive field(s) redacted")))
        .alias("message"),
        F.lit("open").alias("status"),
        *[c for c in ("created_at", "day") if c in usage.columns],
    )


def attribute(requests: DataFrame, api_keys: DataFrame, orgs: DataFrame, key_col: str = "presented_key") -> DataFrame:
    """Requests whose key is known and not revoked, with organisation, user, plan and retention.

    Keys are compared by SHA-256. The key table is broadcast when small; when not, AQE splits a key that makes up
    much of the traffic.
    """
    live = api_keys.filter("not revoked").select("key_hash", "key_id", "org_id", "user_id")
    plans = broadcast_if_small(orgs.select("org_id", "plan", "zero_retention"))
    return (
        requests.withColumn("key_hash", F.sha2(F.col(key_col), 256))
        .drop(key_col)
        .join(broadcast_if_small(live), "key_hash")
        .join(plans, "org_id")
    )


def key_last_used(attributed: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Latest use of each key."""
    return attributed.groupBy("key_id").agg(F.max(ts_col).alias("last_used"))


def activity_rows(events: DataFrame, users: DataFrame) -> DataFrame:
    """Activity feed rows: the actor's name is looked up by id, 'Someone' when there is none."""
    names = broadcast_if_small(users.select(F.col("user_id").alias("actor_id"), F.col("name").alias("actor")))
    return events.join(names, "actor_id", "left").withColumn("actor", F.coalesce("actor", F.lit("Someone"))).drop("actor_id")

