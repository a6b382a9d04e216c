"""Redaction of answers that arrive in pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spans import coalesce_spans, let, mask, raw_findings
from ..operators.policies import org_plans, outbound_orgs
from ..plans.sizing import broadcast_if_small
from ..sources.frames import answer_text
from .pending import Answer, abandoned, events_of, given_out, in_turn

_STATE = (
    "due bigint, early_seq array<bigint>, early_raw array<string>, rest string, text string, frame_id string, model string, over boolean, labels string"
)
_OUT = "stream_id string, seq bigint, part int, kind string, text string, frame string"


def with_outbound(frames: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds `plan`, null for organisations without an enabled redact policy: their answers pass unchanged."""
    wanted = outbound_orgs(policies).filter("has_outbound").select("org_id")
    plans = org_plans(policies).join(wanted, "org_id", "left_semi")
    return frames.join(broadcast_if_small(plans), "org_id", "left")


def stream_redact(frames: DataFrame, policies: DataFrame, timeout_ms: int | None = None, first_seq: int | None = 0) -> DataFrame:
    """Redacted frames of a stream of (stream_id, org_id, seq, raw), as they can be given out.

    Pieces of an answer are numbered from `first_seq` without gaps. They may come in any order, over any number of
    micro-batches, and more than once: a piece that is early waits in the state, one that comes again is left out. With
    `first_seq` None numbers may have gaps and only order the pieces of a micro-batch. Sorted by seq and part, the frames
    given out are in the order of the answer. A piece without a number belongs nowhere and is left out; one without text
    is empty.

    The state of an answer is the pieces that wait, an unfinished event and its pending tail, usually a few hundred
    characters; answers that pass unchanged keep none. With `timeout_ms` an answer that has been silent that long is
    closed: what waits goes out over the gaps, then the rest, and its state is dropped; that of an ended answer is kept as
    long, so that nothing follows its end. Without, it is dropped at the end marker. A service should set it; a query that
    should come to an end by itself must not, as open timeouts keep it running.
    """
    ordered = F.array_sort(
        F.transform(F.map_entries("plan"), lambda e: F.struct(e["value"]["ord"].alias("ord"), e["key"].alias("label")))
    )
    labels = F.to_json(F.transform(ordered, lambda x: x["label"]))
    numbered = with_outbound(frames, policies).filter("seq is not null")
    rows = numbered.select(F.col("stream_id").cast("string"), "org_id", "seq", F.coalesce("raw", F.lit("")).alias("raw"), labels.alias("labels"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *kept, plan = state.get if state.exists else (*Answer(first_seq).kept(), None)
        answer = Answer.of(*kept)
        out: list[tuple] = []
        if state.hasTimedOut:
            out += [(key[0], 2**62, i, *o) for i, o in enumerate(given_out(answer, abandoned(answer), json.loads(plan)))]
            state.remove()
        else:
            batch = pd.concat(list(parts)).sort_values("seq", kind="stable")
            now = batch["labels"].iloc[0]  # an organisation has one plan in a micro-batch
            plan = now if isinstance(now, str) else plan
            pieces = list(zip(batch["seq"].tolist(), batch["raw"].tolist()))
            if plan is None:
                out += [(key[0], seq, 0, "raw", None, raw) for seq, raw in pieces]
            elif not answer.over:
                names = json.loads(plan)
                for seq, raw in in_turn(answer, pieces):
                    out += [(key[0], seq, i, *o) for i, o in enumerate(given_out(answer, events_of(answer, raw), names))]
                if answer.over:
                    answer.early.clear()
            if plan is not None and (timeout_ms is not None or not answer.over):
                state.update((*answer.kept(), plan))
                if timeout_ms is not None:
                    state.setTimeoutDuration(timeout_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "part", "kind", "text", "frame"])

    return rows.groupBy("stream_id", "org_id").applyInPandasWithState(
        step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def redact_finished(frames: DataFrame, policies: DataFrame) -> DataFrame:
    """Batch form: (stream_id, org_id, text) with the deltas of each answer joined and masked once.

    The raw pieces of an answer are put together before events are told apart, as an event may straddle pieces; what
    follows the end marker does not count. As in the stream, every finding of an organisation with outbound redaction is
    masked, whatever its action. The text of an answer is one value of the result, so it has to fit a row here as it
    does there.
    """
    pieces = frames.groupBy("stream_id", "org_id").agg(F.array_sort(F.collect_list(F.struct("seq", "raw"))).alias("d"))
    # found out once per answer; an outer explode keeps the filter from being pushed below it, which would read everything twice
    read = answer_text(F.array_join(F.transform("d", lambda x: x["raw"]), ""))
    joined = pieces.select("stream_id", "org_id", F.explode_outer(F.array(read)).alias("_a")).filter("_a.found").select("stream_id", "org_id", "_a.text")
    planned = with_outbound(joined, policies)
    masked = let(raw_findings(F.col("text"), F.col("plan")), lambda raw: mask(F.col("text"), coalesce_spans(raw)))
    return planned.select("stream_id", "org_id", masked.alias("text"))
