"""Answer streams: event-stream text to frames, and frames back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trim_space
from ..functions.spans import let

DONE = "[DONE]"


_CONTENT = "$.choices[0].delta.content"


def _text_at(body: Column, path: str) -> Column:
    """The text at a path of a parsed payload; null for anything but text."""
    value = F.try_variant_get(body, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(body, path, "string"))


def _payloads(raw: Column) -> Column:
    """array<string>: the payload of each event of the raw text, null where an event has none."""
    return F.transform(
        F.split(raw, "\n\n"),
        lambda event: trim_space(F.substr(F.get(F.filter(F.split(event, "\r?\n"), lambda x: x.startswith("data:")), F.lit(0)), F.lit(6))),
    )


def answer_text(raw: Column) -> Column:
    """struct<found, text> of the events of a whole answer: whether any has a text delta, and the deltas up to the end
    marker put together."""
    read = F.transform(
        _payloads(raw),
        lambda p: F.struct((p == DONE).alias("done"), let(F.when(p != DONE, F.try_parse_json(p)), lambda body: _text_at(body, _CONTENT)).alias("content")),
    )

    def joined(events: Column) -> Column:
        end = F.array_position(F.transform(events, lambda e: e["done"]), True)
        upto = F.when(end > 0, F.slice(events, F.lit(1), end.cast("int"))).otherwise(events)
        found = F.exists(events, lambda e: e["content"].isNotNull())
        return F.struct(F.coalesce(found, F.lit(False)).alias("found"), F.array_join(F.transform(upto, lambda e: e["content"]), "").alias("text"))

    return let(read, joined)


def parse_frames(df: DataFrame, raw_col: str) -> DataFrame:
    """One row per event of the raw text, in order (`part`). A row holds whole events: pieces of an answer that cut
    through events are put together first, as `redact_finished` does.

    `content` is the text delta and `finish` the finish reason, where there is one. `done` marks the end marker;
    `passthrough` what is forwarded as it is: frames that do not parse, and frames with neither delta nor reason.
    """
    keep = [c for c in df.columns if c != raw_col]
    events = df.select(*keep, F.posexplode(_payloads(F.col(raw_col))).alias("part", "payload")).filter("payload is not null")
    parsed = events.withColumn("done", F.col("payload") == DONE)
    # one parse per frame; a payload that is no JSON object gives nulls, which is what passing through means
    body = parsed.withColumn("_b", F.when(~F.col("done"), F.try_parse_json("payload")))
    found = body.select(
        *keep,
        "part",
        "payload",
        "done",
        _text_at(F.col("_b"), _CONTENT).alias("content"),
        _text_at(F.col("_b"), "$.choices[0].finish_reason").alias("finish"),
        _text_at(F.col("_b"), "$.id").alias("frame_id"),
        _text_at(F.col("_b"), "$.model").alias("model"),
    )
    return found.withColumn("passthrough", ~F.col("done") & F.col("content").isNull() & F.col("finish").isNull())


def content_frame(frame_id: Column, model: Column, text: Column) -> Column:
    """A chunk carrying text, as event-stream text; null for empty text."""
    choice = F.struct(
        F.struct(text.alias("content")).alias("delta"), F.lit(None).cast("string").alias("finish_reason"), F.lit(0).alias("index")
    )
    return F.when(F.length(text) > 0, _frame(choice, frame_id, model))


def finish_frame(frame_id: Column, model: Column, reason: Column) -> Column:
    """The chunk that tells why the answer ended."""
    nothing = F.expr("cast(map() as map<string,string>)")
    return _frame(F.struct(nothing.alias("delta"), reason.alias("finish_reason"), F.lit(0).alias("index")), frame_id, model)


def _frame(choice: Column, frame_id: Column, model: Column) -> Column:
    body = F.struct(
        F.array(choice).alias("choices"),
        F.coalesce(frame_id, F.lit("")).alias("id"),
        F.coalesce(model, F.lit("")).alias("model"),
        F.lit("chat.completion.chunk").alias("object"),
    )
    return F.concat(F.lit("data: "), F.to_json(body, {"ignoreNullFields": "false"}), F.lit("\n\n"))
