"""Answers in pieces, and the streaming operators over several files."""

from __future__ import annotations

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.operators.notify import render_payload
from cloakwork.operators.quota import quota_decisions, quota_used
from cloakwork.plans import run
from cloakwork.sources.events import parse_events
from cloakwork.sources.frames import content_frame, finish_frame
from cloakwork.streaming import answers as SA
from cloakwork.streaming import counters as SC
from cloakwork.sources.frames import parse_frames
from cloakwork.streaming.pending import Answer, Event, abandoned, events_of, given_out, in_turn, merged_spans, read_event, release

from .conftest import policy_rows

LABELS = ["EMAIL", "SSN", "PHONE", "IBAN"]


def frame(content=None, finish=None, **more):
    delta = {} if content is None else {"content": content}
    return "data: " + json.dumps({**more, "choices": [{"delta": delta, "finish_reason": finish}]}) + "\n\n"


def text_of(out):
    return "".join(t for kind, t, _ in out if kind == "content")


def feed(held, pieces, labels):
    return [o for p in pieces for o in given_out(held, events_of(held, p), labels)]


def test_value_split_over_two_frames():
    out = feed(Answer(), [frame("mail me at jane@ac", id="1", model="m"), frame("me.co now"), frame(finish="stop"), "data: [DONE]\n\n"], ["EMAIL"])
    assert text_of(out) == "mail me at [REDACTED:EMAIL] now"
    assert [k for k, _, _ in out] == ["content", "finish", "done"]
    body = json.loads(out[1][2][6:])
    assert body["id"] == "1" and body["model"] == "m" and body["choices"][0] == {"delta": {}, "finish_reason": "stop", "index": 0}


def test_clean_text_passes_and_other_frames_keep_their_place():
    role = 'data: {"choices":[{"delta":{"role":"assistant"}}]}\n\n'
    number = 'data: {"choices":[{"delta":{"content":5}}]}\n\n'
    out = feed(Answer(), [": comment\n\n", role, frame("hello world"), "data: {oops\n\n", number, "data: [DONE]\n\n", frame("too late")], ["EMAIL"])
    assert [(k, t) for k, t, _ in out] == [("raw", None), ("raw", None), ("raw", None), ("content", "hello world"), ("done", None)]
    assert out[1][2] == "data: {oops\n\n"


def test_source_that_just_ends():
    held = Answer()
    assert not feed(held, [frame("mail a@b.co") + "data: half"], ["EMAIL"])
    out = list(given_out(held, abandoned(held), ["EMAIL"]))
    assert [(k, t) for k, t, _ in out] == [("content", "mail [REDACTED:EMAIL]"), ("raw", None), ("done", None)]
    assert out[1][2] == "data: half\n\n"
    assert not list(given_out(held, abandoned(held), ["EMAIL"]))


def test_pieces_wait_for_their_turn():
    held = Answer()
    assert list(in_turn(held, [(2, "c"), (3, "d"), (2, "again")])) == []
    assert list(in_turn(held, [(1, "b"), (0, "a")])) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert list(in_turn(held, [(3, "again"), (6, frame(" b@c.co")), (5, frame("mail"))])) == [] and held.due == 4
    out = list(given_out(held, abandoned(held), ["EMAIL"]))  # piece 4 never came
    assert text_of(out) == "mail [REDACTED:EMAIL]" and out[-1][0] == "done"
    assert list(in_turn(Answer(None), [(90, "b"), (7, "a")])) == [(7, "a"), (90, "b")]


def test_the_cut_never_goes_through_a_finding():
    text = "x" * 40 + " a@" + "b" * 50 + ".co and the rest"
    emitted, kept = release(text, ["EMAIL"], False)
    assert emitted == "x" * 40 + " " and kept.startswith("a@")


def mask_all(text, labels):
    out, at = [], 0
    for s, e, label in merged_spans(text, labels):
        out += [text[at:s], f"[REDACTED:{label}]"]
        at = e
    return "".join(out) + text[at:]


PARTS = st.sampled_from(["a@b.co", "123-45-6789", "GB29NWBK60161331926819", "+1 415 555 0134", "word", "été", "😀", "end."])


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=40), st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 50))
def test_any_chunking_equals_masking_the_whole(parts, sizes, raw_size):
    text = " . ".join(parts)
    pieces, at, i = [], 0, 0
    while at < len(text):
        pieces.append(text[at : at + sizes[i % len(sizes)]])
        at, i = at + sizes[i % len(sizes)], i + 1
    raw = "".join(frame(p) for p in pieces) + frame(finish="stop") + "data: [DONE]\n\n"
    held, out = Answer(), []
    for k in range(0, len(raw), raw_size):  # network pieces do not respect event borders
        out += feed(held, [raw[k : k + raw_size]], LABELS)
        held = Answer.of(*held.kept())
    assert text_of(out) == mask_all(text, LABELS)


def test_batch_form_on_pieces_cut_anywhere(spark):
    """Events that straddle rows, numbers where text should be, and frames after the end marker."""
    rnd = random.Random(3)
    rows, want = [], {}
    for i in range(12):
        text = " . ".join(rnd.choice(["a@b.co", "123-45-6789", "word", "été", "😀"]) for _ in range(20))
        parts = [text[k : k + 9] for k in range(0, len(text), 9)]
        raw = "".join(frame(p) for p in parts) + 'data: {"choices":[{"delta":{"content":5}}]}\n\n' + frame(finish="stop") + "data: [DONE]\n\n" + frame("late")
        at, n = 0, 0
        while at < len(raw):
            size = rnd.randint(1, 70)
            rows.append((f"s{i}", 1, n, raw[at : at + size]))
            at, n = at + size, n + 1
        want[f"s{i}"] = mask_all(text, ["EMAIL", "SSN"])
    frames = spark.createDataFrame(rows, "stream_id string, org_id long, seq long, raw string")
    got = SA.redact_finished(frames, policy_rows(spark, (1, ["email", "ssn"], "redact"))).collect()
    assert {r["stream_id"]: r["text"] for r in got} == want


def test_only_text_is_a_delta(spark):
    raws = ['data: {"choices":[{"delta":{"content":5}}],"id":7}\n\n', 'data: {"choices":[{"delta":{"content":"5"}}],"id":"7"}\n\n', "data: [1]\n\n", 'data: {"choices":{}}\n\n']
    rows = parse_frames(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [(r["content"], r["frame_id"], r["passthrough"]) for r in rows] == [(None, None, True), ("5", "7", False), (None, None, True), (None, None, True)]


def test_both_readings_of_a_payload_agree(spark):
    """Payloads read in the state of a stream, and as columns."""
    values = ['"t"', '""', "null", "5", "true", "[]", "{}", '["t"]', '{"content":"t"}']
    payloads = [f'{{"choices":[{{"delta":{{"content":{v}}},"finish_reason":{w}}}],"id":{v},"model":{w}}}' for v in values for w in values]
    payloads += [f'{{"choices":{v}}}' for v in values] + [f'{{"choices":[{v}]}}' for v in values] + [*values, "", "{", "[DONE]", "[DONE] ", "x"]
    payloads += ['{"choices":[{"delta":{"content":"a"}},{"delta":{"content":"b"}}]}', '{"choices":[{"delta":{"content":"\\u00e9\\n"}}]}']
    rows = parse_frames(spark.createDataFrame([(i, f"data: {p}") for i, p in enumerate(payloads)], "i int, raw string"), "raw").collect()
    assert len(rows) == len(payloads)
    for r in rows:
        e = read_event(payloads[r["i"]].strip())
        kinds = [k for k, _ in e.follow]
        assert (e.ends, "raw" in kinds, e.text) == (r["done"], r["passthrough"], r["content"]), payloads[r["i"]]
        assert [w for k, w in e.follow if k == "finish"] == ([r["finish"]] if r["finish"] is not None else []), payloads[r["i"]]
        assert e.head == (r["frame_id"], r["model"]), payloads[r["i"]]
    assert isinstance(e, Event)


def write_json(folder, batches):
    """One file per micro-batch; files are read in the order of their times."""
    for i, rows in enumerate(batches):
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def finish(writer, tmp_path, name):
    query = writer.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def read_json(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_stream_redact_over_micro_batches(spark, tmp_path):
    rnd = random.Random(2)
    texts = {f"s{i}": " . ".join(rnd.choice(["a@b.co", "123-45-6789", "word", "été"]) for _ in range(25)) for i in range(6)}
    rows = []
    for sid, text in texts.items():
        pieces = [text[i : i + 11] for i in range(0, len(text), 11)]
        raws = [frame(p, id=sid) for p in pieces] + [frame(finish="stop"), "data: [DONE]\n\n"]
        org = 2 if sid == "s5" else 1
        rows.append([{"stream_id": sid, "org_id": org, "seq": n, "raw": r} for n, r in enumerate(raws)])
    src = tmp_path / "in"
    src.mkdir()
    batches = [[r for s in rows for r in s[k * 7 : (k + 1) * 7]] for k in range(max(map(len, rows)) // 7 + 1)]
    write_json(src, [b for b in batches if b])
    policies = policy_rows(spark, (1, ["email"], "redact"), (1, ["ssn"], "flag"), (2, ["email"], "block"))
    frames = read_json(spark, src, "stream_id string, org_id long, seq long, raw string")
    out = tmp_path / "out"
    finish(SA.stream_redact(frames, policies).writeStream.format("parquet").option("path", str(out)), tmp_path, "cp")
    got = spark.read.parquet(str(out)).orderBy("stream_id", "seq", "part").collect()
    for sid, text in texts.items():
        mine = [r for r in got if r["stream_id"] == sid]
        if sid == "s5":  # no redact policy: frames pass as they came
            assert {r["kind"] for r in mine} == {"raw"} and len(mine) == len(rows[5])
            continue
        assert "".join(r["text"] for r in mine if r["kind"] == "content") == mask_all(text, ["EMAIL", "SSN"])
        assert [r["kind"] for r in mine][-2:] == ["finish", "done"]
    batch = spark.read.schema("stream_id string, org_id long, seq long, raw string").json(str(src))
    whole = {r["stream_id"]: r["text"] for r in SA.redact_finished(batch, policies).collect()}
    assert whole == {s: t if s == "s5" else mask_all(t, ["EMAIL", "SSN"]) for s, t in texts.items()}


def test_pieces_dealt_at_random_over_micro_batches(spark, tmp_path):
    """Pieces cut anywhere, out of order over ten micro-batches, some twice, some after the end marker, with a restart in
    between: the texts are those of the finished answers."""
    rnd = random.Random(8)
    rows = []
    for i in range(8):
        text = " . ".join(rnd.choice(["a@b.co", "123-45-6789", "word", "été", "😀"]) for _ in range(30))
        raw = "".join(frame(text[k : k + 13]) for k in range(0, len(text), 13)) + frame(finish="stop") + "data: [DONE]\n\n" + frame("late")
        cuts = sorted({0, len(raw), *rnd.sample(range(len(raw)), 25)})
        rows += [{"stream_id": f"s{i % 4}", "org_id": 1 + i // 4, "seq": n, "raw": raw[a:b]} for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    schema = "stream_id string, org_id long, seq long, raw string"
    policies = policy_rows(spark, (1, ["email"], "redact"), (1, ["ssn"], "flag"), (2, ["ssn"], "redact"))
    want = {(r["stream_id"], r["org_id"]): r["text"] for r in SA.redact_finished(spark.createDataFrame(rows, schema), policies).collect()}
    rnd.shuffle(rows)
    batches = [rows[k::10] for k in range(10)]
    batches[9] = batches[9] + batches[2][:5]
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for some in (batches[:6], batches):
        write_json(src, some)
        for org in (1, 2):  # a sink of its own for each organisation, as the frames given out do not name it
            frames = read_json(spark, src, schema).filter(F.col("org_id") == org)
            finish(SA.stream_redact(frames, policies).writeStream.format("parquet").option("path", f"{out}{org}"), tmp_path, f"cp{org}")
    for (sid, org), text in want.items():
        got = spark.read.parquet(f"{out}{org}").filter(F.col("stream_id") == sid).orderBy("seq", "part").collect()
        assert "".join(r["text"] for r in got if r["kind"] == "content") == text
        assert [r["kind"] for r in got][-2:] == ["finish", "done"] and text


def test_ingest_writes_events_and_alerts_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    body = [
        {"site": "a", "host": "h", "action": "paste", "labels": ["EMAIL", "SSN"], "count": 2, "outcome": "block"},
        {"site": "b", "host": "h", "action": "paste", "count": 1},
        {"site": "c", "host": "h", "action": "paste"},
    ]
    write_json(src, [[{"event_id": i, "org_id": 1, "body": json.dumps(b)}] for i, b in enumerate(body)])
    stream = parse_events(read_json(spark, src, "event_id long, org_id long, body string"), "body")
    events, alerts = str(tmp_path / "events"), str(tmp_path / "alerts")
    finish(SC.ingest(stream, events, alerts), tmp_path, "cp")
    finish(SC.ingest(stream, events, alerts), tmp_path, "cp")  # a restart finds nothing new
    stored = {r["event_id"]: r for r in spark.read.parquet(events).collect()}
    assert len(stored) == 3 and stored[2]["labels"] == [] and stored[2]["count"] == 0 and stored[2]["outcome"] == "flag"
    raised = sorted((r["severity"], r["message"]) for r in spark.read.parquet(alerts).collect())
    assert raised == [("high", "blocked EMAIL, SSN on a"), ("low", "flagged sensitive data on b")]


def test_admission_over_micro_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"log_id": i, "org_id": 1, "created_at": f"2024-01-01T{i // 30:02d}:{i % 30:02d}:00Z"} for i in range(450)]
    rows += [{"log_id": 1000 + i, "org_id": 2, "created_at": "2024-01-01T00:00:00Z"} for i in range(10)]
    rows += [{"log_id": 2000 + i, "org_id": 1, "created_at": "2024-01-02T00:00:00Z"} for i in range(5)]
    write_json(src, [rows[:150], rows[150:300], rows[300:]])
    orgs = spark.createDataFrame([(1, "free"), (2, "enterprise")], "org_id long, plan string")
    stream = read_json(spark, src, "log_id long, org_id long, created_at timestamp")
    decisions = str(tmp_path / "decisions")
    finish(SC.admit(stream, orgs, decisions, str(tmp_path / "counts")), tmp_path, "cp")
    got = {r["log_id"]: r for r in spark.read.parquet(decisions).collect()}
    assert len(got) == len(rows)
    assert [i for i in range(450) if got[i]["admitted"]] == list(range(200))
    assert got[449]["used"] == 200 and got[1009]["admitted"] and got[2004]["used"] == 5


def test_counters_add_up_in_any_order(spark, tmp_path):
    """Late rows, a row far in the future, and rows without time or organisation: as the batch operators have it."""
    src = tmp_path / "in"
    src.mkdir()
    times = [f"2024-01-0{1 + i % 3}T{i % 24:02d}:00:00Z" for i in range(700)]
    rows = [{"log_id": i, "org_id": 1 + i % 2, "created_at": t} for i, t in enumerate(times)]
    random.Random(4).shuffle(rows)
    odd = [{"log_id": 900, "org_id": 3, "created_at": "2031-01-01T00:00:00Z"}, {"log_id": 901, "org_id": 1}, {"log_id": 902, "created_at": times[0]}]
    write_json(src, [rows[:300], odd, rows[300:500], rows[500:]])
    schema = "log_id long, org_id long, created_at timestamp"
    orgs = spark.createDataFrame([(1, "free"), (2, "enterprise"), (3, "free")], "org_id long, plan string")
    batch = spark.read.schema(schema).json(str(src))
    counts, decisions = str(tmp_path / "counts"), str(tmp_path / "decisions")
    finish(SC.count_daily(read_json(spark, src, schema), counts), tmp_path, "cp")
    key = lambda r: tuple(map(str, r))
    want = sorted(map(tuple, quota_used(batch, orgs).select("org_id", "day", "used").collect()), key=key)
    assert sorted(map(tuple, SC.stream_quota(spark.read.parquet(counts), orgs).collect()), key=key) == want
    SC.compact(spark, counts, str(tmp_path / "compact"), 2)
    again = SC.since_compaction(spark, counts, str(tmp_path / "compact"), 2)
    assert sorted(map(tuple, SC.stream_quota(again, orgs).collect()), key=key) == want
    finish(SC.admit(read_json(spark, src, schema), orgs, decisions, str(tmp_path / "increments")), tmp_path, "cp2")
    got = spark.read.parquet(decisions)
    whole = quota_decisions(batch, orgs)
    assert got.count() == whole.count() == len(rows) + 3
    for df in (got, whole):
        assert {r["log_id"] for r in df.filter("not admitted and (org_id is null or created_at is null)").collect()} == {901, 902}
    admitted = lambda df: sorted(map(tuple, df.filter("admitted").groupBy("org_id", "day").count().collect()), key=key)
    assert admitted(got) == admitted(whole)


def test_admission_goes_on_after_restarts(spark, tmp_path):
    """Files in no order, a restart, a new checkpoint over the old counters: as many pass as in one go, and the folders
    that a batch reads do not become more."""
    rnd = random.Random(6)
    rows = [{"log_id": i, "org_id": rnd.choice([1, 1, 1, 2]), "created_at": f"2024-01-0{rnd.randint(1, 3)}T{rnd.randint(0, 23):02d}:{i % 60:02d}:00Z"} for i in range(1400)]
    parts = [rows[i::14] for i in range(14)]
    src, more = tmp_path / "in", tmp_path / "more"
    src.mkdir(), more.mkdir()
    schema = "log_id long, org_id long, created_at timestamp"
    orgs = spark.createDataFrame([(1, "free"), (2, "enterprise")], "org_id long, plan string")
    decisions, counts = str(tmp_path / "decisions"), str(tmp_path / "counts")
    go = lambda folder, cp: finish(SC.admit(read_json(spark, folder, schema), orgs, decisions, counts, every=3), tmp_path, cp)
    write_json(src, parts[:4])
    go(src, "cp")
    write_json(src, parts[:10])
    go(src, "cp")  # a restart
    write_json(more, parts[10:])
    go(more, "cp2")  # a new checkpoint
    got, whole = spark.read.parquet(decisions), quota_decisions(spark.createDataFrame(rows).withColumn("created_at", F.to_timestamp("created_at")), orgs)
    assert got.count() == len(rows) and got.select("log_id").distinct().count() == len(rows)
    admitted = lambda df: sorted(map(tuple, df.filter("admitted").groupBy("org_id", F.to_date("created_at")).count().collect()))
    assert admitted(got) == admitted(whole) and dict(((o, d), n) for o, d, n in admitted(got)).get((1, admitted(got)[0][1])) == 200
    assert {r["used"] for r in got.filter("org_id = 1 and not admitted").collect()} == {200}
    for run in os.listdir(counts):
        assert len(os.listdir(f"{counts}/{run}")) <= 2 * 3 + 3


def test_counters_of_a_repeated_batch(spark, tmp_path):
    """A batch that failed after any of its writes is done again, and nothing is counted twice; old counters expire."""
    day = lambda n, org=1: spark.sql(f"select cast({org} as bigint) as org_id, date'2024-01-01' as day, cast({n} as bigint) as requests")
    kept = SC.Counters(spark, str(tmp_path / "counts"), "a", every=2)
    for b in range(7):
        for _ in range(2):
            before = kept.before(b).collect()
            assert [r["requests"] for r in before] == ([sum(range(1, b + 1))] if b else [])
            kept.add(day(b + 1).unionByName(day(5, "null")), b)
    after = SC.Counters(spark, str(tmp_path / "counts"), "b", every=1, expires="0 seconds")
    assert [(r["org_id"], r["requests"]) for r in after.before(0).collect()] == [(1, 28)]
    after.add(day(1), 0)
    assert after.before(1).count() == 0


STREAMS = ["stream_ingest_events", "stream_fan_out", "stream_redact", "stream_quota", "stream_admit", "stream_daily_usage"]


def test_streams_over_folder_tables(spark, sf_dir, tmp_path):
    """A table as a folder of part files gives what the single file gives."""
    for name in os.listdir(sf_dir):
        table = spark.read.parquet(f"{sf_dir}/{name}")
        if name in ("events.parquet", "conversations.parquet"):
            table.repartition(3).write.parquet(str(tmp_path / name))
        else:
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    key = lambda r: tuple(map(str, r))
    for name in STREAMS:
        one, many = (sorted(map(tuple, run(name, spark, d).collect()), key=key) for d in (sf_dir, str(tmp_path)))
        if name == "stream_admit":  # who is admitted follows the order of arrival; how many are does not
            one, many = (sorted((r[1], r[2]) for r in rows) for rows in (one, many))
        assert one == many and one, name


def test_frames_as_columns(spark):
    df = spark.createDataFrame([("i", "m", "tä\"x", "stop"), (None, None, "", "length")], "i string, m string, t string, r string")
    rows = df.select(content_frame(F.col("i"), F.col("m"), F.col("t")), finish_frame(F.col("i"), F.col("m"), F.col("r"))).collect()
    first = json.loads(rows[0][0][6:])
    assert first == {"choices": [{"delta": {"content": 'tä"x'}, "finish_reason": None, "index": 0}], "id": "i", "model": "m", "object": "chat.completion.chunk"}
    assert rows[1][0] is None  # no text, no frame
    assert json.loads(rows[1][1][6:])["choices"] == [{"delta": {}, "finish_reason": "length", "index": 0}]


@pytest.mark.parametrize("slug", ["slack", "teams", "webhooks"])
def test_payloads(spark, slug):
    df = spark.createDataFrame([(slug, "risk_alert", "high", "m", "7", None)], "slug string, kind string, severity string, message string, org_id string, at string")
    fields = {c: F.col(c) for c in ("kind", "severity", "message", "org_id", "at")}
    body = json.loads(df.select(render_payload(F.col("slug"), fields, "Sender")).first()[0])
    if slug == "webhooks":
        assert body == {"source": "sender", "kind": "risk_alert", "severity": "high", "message": "m", "orgId": "7", "at": None}
    else:
        assert body == {"text": "*Sender* [HIGH] m"}
