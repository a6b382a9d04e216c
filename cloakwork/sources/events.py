"""Browser telemetry: JSON payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "site string, host string, action string, labels array<string>, count int, outcome string"


def parse_events(df: DataFrame, json_col: str) -> DataFrame:
    """Adds the event's columns; labels default to none, count to 0, outcome to 'flag'. Works on streams as well.

    `valid` is false for a payload that is no JSON object, lacks site, host or action, or holds a value of the wrong
    kind: a default stands for a field that is left out, not for a null, labels are strings, and a count has 32 bits.
    `accepted` and `rejected` part the two.
    """
    e = F.from_json(F.col(json_col), EVENT)
    body = F.try_parse_json(F.col(json_col))
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(body, f"$.{name}", "variant")), F.lit("MISSING"))
    count = F.try_variant_get(body, "$.count", "int")
    valid = F.lit(True)
    for name in ("site", "host", "action"):
        valid = valid & (kind(name) == "STRING")
    valid = valid & kind("outcome").isin("STRING", "MISSING")
    valid = valid & ((kind("count") == "MISSING") | ((kind("count") == "BIGINT") & count.isNotNull()))
    valid = valid & ((kind("labels") == "MISSING") | (kind("labels").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.try_variant_get(body, "$.labels", "array<string>"), lambda x: x.isNull())))
    parsed = df.withColumn("_e", e).withColumn("valid", F.coalesce(valid, F.lit(False)))
    return parsed.select(
        *[c for c in df.columns if c != json_col],
        "_e.site",
        "_e.host",
        "_e.action",
        F.coalesce("_e.labels", F.expr("cast(array() as array<string>)")).alias("labels"),
        F.coalesce(count, F.lit(0)).alias("count"),
        F.coalesce("_e.outcome", F.lit("flag")).alias("outcome"),
        "valid",
    )


def accepted(events: DataFrame) -> DataFrame:
    """The events of `parse_events` to store."""
    return events.filter("valid").drop("valid")


def rejected(df: DataFrame, json_col: str) -> DataFrame:
    """The input rows whose payload is refused, as they came."""
    keep = [F.col(c) for c in df.columns]
    return parse_events(df.withColumn("_raw", F.col(json_col)), json_col).filter(~F.col("valid")).select(
        *[F.col("_raw").alias(json_col) if c == json_col else c_ for c, c_ in zip(df.columns, keep)]
    )
