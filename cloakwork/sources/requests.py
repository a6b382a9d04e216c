"""Chat requests: JSON payloads to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
REQUEST = (
    "model string, messages array<struct<role:string,content:string>>, stream boolean, temperature float, max_tokens bigint"
)


def parse_requests(df: DataFrame, json_col: str) -> DataFrame:
    """Adds model, messages, stream (default false), temperature, max_tokens, the remaining fields as `extra`
    (name → JSON text), and `valid`: a model, messages, and only known roles."""
    known = ("model", "messages", "stream", "temperature", "max_tokens")
    body = F.from_json(F.col(json_col), REQUEST)
    everything = F.from_json(F.col(json_col), "map<string,string>")
    parsed = df.withColumn("_body", body).withColumn("_all", everything)
    ok = (
        F.col("model").isNotNull()
        & F.col("messages").isNotNull()
        & F.forall("messages", lambda m: m["role"].isin(*ROLES) & m["content"].isNotNull())
    )
    return (
        parsed.select(
            *[c for c in df.columns if c != json_col],
            "_body.model",
            "_body.messages",
            F.coalesce("_body.stream", F.lit(False)).alias("stream"),
            "_body.temperature",
            "_body.max_tokens",
            F.map_filter("_all", lambda k, _: ~k.isin(*known)).alias("extra"),
        )
        .withColumn("valid", F.coalesce(ok, F.lit(False)))
    )
