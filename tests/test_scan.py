"""Scanning under policies: who wins on shared spans, what blocks, what is rewritten."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.operators import audit as A
from cloakwork.operators import scan as X

from .conftest import policy_rows

ENTITY = "array<struct<label:string,start:int,end:int,score:double>>"


def scan_one(spark, text, *policies):
    df = spark.createDataFrame([(1, 1, text)], "id long, org_id long, text string")
    return X.scan(df, "text", "org_id", policy_rows(spark, *policies)).first()


def test_two_labels_in_one_text(spark):
    r = scan_one(spark, "mail a@b.co ssn 123-45-6789", (1, ["email", "ssn"], "redact"))
    assert r["text"] == "mail [REDACTED:EMAIL] ssn [REDACTED:SSN]" and r["n_findings"] == 2 and not r["blocked"]


def test_block_keeps_the_text(spark):
    r = scan_one(spark, "mail a@b.co", (1, ["email"], "block"))
    assert r["text"] == "mail a@b.co" and r["blocked"] and r["n_findings"] == 1


def test_two_policies_on_one_span_count_once(spark):
    r = scan_one(spark, "mail a@b.co now", (1, ["email"], "redact"), (1, ["email"], "redact"))
    assert r["text"] == "mail [REDACTED:EMAIL] now" and r["n_findings"] == 1


def test_flag_and_redact_is_redacted(spark):
    r = scan_one(spark, "mail a@b.co now", (1, ["email"], "flag"), (1, ["email"], "redact"))
    assert r["text"] == "mail [REDACTED:EMAIL] now" and not r["blocked"]


def test_block_and_redact_is_not_rewritten(spark):
    r = scan_one(spark, "mail a@b.co now", (1, ["email"], "redact"), (1, ["email"], "block"))
    assert r["text"] == "mail a@b.co now" and r["blocked"]


def test_flag_only_counts(spark):
    r = scan_one(spark, "mail a@b.co now", (1, ["email"], "flag"))
    assert r["text"] == "mail a@b.co now" and r["n_findings"] == 1 and not r["blocked"]


def test_card_beats_the_phone_inside_it(spark):
    r = scan_one(spark, "card 4111 1111 1111 1111 ok", (1, ["phone", "credit_card"], "redact"))
    # both start at the first digit; the card is wider, so its label stays although phone is listed first
    assert r["text"] == "card [REDACTED:CREDIT_CARD] ok" and r["n_findings"] == 1


def test_international_formats(spark):
    r = scan_one(spark, "GB29NWBK60161331926819 at 10.0.0.1 or +14155550134", (1, ["iban", "ip_address", "intl_phone"], "redact"))
    assert r["text"] == "[REDACTED:IBAN] at [REDACTED:IP_ADDRESS] or [REDACTED:INTL_PHONE]"


@pytest.mark.parametrize("policy", [(1, ["email"], "block", False), (1, ["nope"], "block"), (2, ["email"], "block"), (1, [], "redact")])
def test_policies_that_do_not_apply(spark, policy):
    r = scan_one(spark, "mail a@b.co", policy)
    assert r["text"] == "mail a@b.co" and r["n_findings"] == 0 and not r["blocked"]


def test_clean_and_missing_text(spark):
    assert scan_one(spark, "hello world", (1, ["email"], "redact"))["n_findings"] == 0
    r = scan_one(spark, None, (1, ["email"], "redact"))
    assert r["text"] is None and r["n_findings"] == 0 and not r["blocked"]


def test_packs_are_off_until_selected(spark):
    text = "nino AB 12 34 56 C cpf 123.456.789-09"
    assert scan_one(spark, text, (1, ["email", "ssn"], "redact"))["n_findings"] == 0
    r = scan_one(spark, text, (1, ["uk_nino", "br_cpf"], "redact"))
    assert r["text"] == "nino [REDACTED:UK_NINO] cpf [REDACTED:BR_CPF]"


def test_emoji_before_a_value(spark):
    r = scan_one(spark, "😀é a@b.co 😀", (1, ["email"], "redact"))
    assert r["text"] == "😀é [REDACTED:EMAIL] 😀" and r["findings"][0]["start"] == 3


def deep(spark, text, entities, *policies):
    df = spark.createDataFrame([(1, 1, text, entities)], f"id long, org_id long, text string, ents {ENTITY}")
    return X.scan_deep(df, "text", "org_id", policy_rows(spark, *policies), entities="ents").first()


def test_deep_without_entities_is_flat(spark):
    flat = scan_one(spark, "Ann a@b.co", (1, ["email"], "redact"))
    for none in (None, []):
        r = deep(spark, "Ann a@b.co", none, (1, ["email"], "redact"))
        assert (r["text"], r["n_findings"], r["blocked"]) == (flat["text"], flat["n_findings"], flat["blocked"])


def test_deep_rules(spark):
    ents = [
        ("PERSON", 0, 3, 0.5),  # kept
        ("NAME", 2, 5, 0.9),  # overlaps the one accepted before
        ("MAIL", 4, 6, 0.9),  # overlaps a finding
        ("PLACE", 14, 19, 0.49),  # too unsure
        ("TIME", 3, 4, 0.9),  # touches, does not overlap
    ]
    r = deep(spark, "Ann a@b.co in Paris", ents, (1, ["email"], "redact"))
    assert r["text"] == "[REDACTED:PERSON][REDACTED:TIME][REDACTED:EMAIL] in Paris"


def test_deep_leaves_blocked_texts(spark):
    r = deep(spark, "Ann a@b.co", [("PERSON", 0, 3, 0.9)], (1, ["email"], "block"))
    assert r["text"] == "Ann a@b.co" and r["blocked"] and r["n_findings"] == 1


def test_overlap_predicate(spark):
    rows = [(0, 5, 4, 8, True), (0, 5, 5, 8, False), (3, 4, 0, 9, True), (6, 8, 0, 6, False)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want boolean")
    assert df.filter(S.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("want")).count() == 0


def brute_merge(raw):
    out = []
    for start, neg_end, _, label, rank in sorted(raw):
        if out and start < out[-1][2]:
            last = out[-1]
            out[-1] = (last[0], last[1], max(last[2], -neg_end), max(last[3], rank))
        else:
            out.append((label, start, -neg_end, rank))
    return out


def random_raw(rnd):
    n = rnd.randint(0, 12)
    starts = [rnd.randint(0, 30) for _ in range(n)]
    return [(s, -(s + rnd.randint(1, 6)), i, rnd.choice("ABC"), rnd.randint(1, 3)) for i, s in enumerate(starts)]


def test_merge_array_and_table_form_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, random_raw(rnd)) for i in range(300)]
    df = spark.createDataFrame(rows, f"id long, raw array<{S.RAW}>")
    got = {r["id"]: [tuple(f) for f in r["f"]] for r in df.select("id", S.coalesce_spans(F.col("raw")).alias("f")).collect()}
    want = {i: brute_merge(raw) for i, raw in rows}
    assert got == want
    flat = df.select("id", F.explode("raw").alias("r")).select("id", "r.label", "r.start", (-F.col("r.neg_end")).alias("end"), "r.rank", "r.ord")
    table = {}
    for r in X.coalesce_rows(flat, "id").collect():
        table.setdefault(r["id"], []).append((r["label"], r["start"], r["end"], r["rank"]))
    assert {k: sorted(v, key=lambda f: f[1]) for k, v in table.items()} == {k: v for k, v in want.items() if v}
    again = df.select("id", S.coalesce_spans(S.as_raw(S.coalesce_spans(F.col("raw")))).alias("f")).collect()
    assert {r["id"]: [tuple(f) for f in r["f"]] for r in again} == want


def test_entity_anti_join_equals_brute_force(spark):
    rnd = random.Random(5)

    def spans(n, longest):
        starts = [rnd.randint(0, 3000) for _ in range(n)]
        return [(rnd.randint(0, 2), i, s, s + rnd.randint(1, longest)) for i, s in enumerate(starts)]

    f, e = spans(120, 20), spans(150, 900)
    schema = "doc long, ent long, start int, end int"
    got = X.entity_anti_join(spark.createDataFrame(f, schema), spark.createDataFrame(e, schema), "doc", "ent")
    want = {x for x in e if not any(x[0] == y[0] and x[2] < y[3] and y[2] < x[3] for y in f)}
    assert {tuple(r) for r in got.select("doc", "ent", "start", "end").collect()} == want and want


MESSAGES = "request_id long, org_id long, messages array<struct<role:string,content:string>>"


def test_inbound_counts_only_the_first_blocking_message(spark):
    policies = policy_rows(spark, (1, ["email"], "redact"), (1, ["ssn"], "block"))
    msgs = [("user", "a@b.co c@d.co"), ("assistant", "123-45-6789"), ("user", "x@y.co 123-45-6789"), ("system", "123-45-6789 111-22-3333 a@b.co")]
    df = spark.createDataFrame([(1, 1, msgs), (2, 1, msgs[:2]), (3, 9, msgs)], MESSAGES)
    got = {r["request_id"]: r for r in A.scan_inbound(df, policies).collect()}
    assert (got[1]["blocked"], got[1]["redactions"], got[1]["first_block"]) == (True, 2, 3)
    assert (got[2]["blocked"], got[2]["redactions"]) == (False, 2)
    assert (got[3]["blocked"], got[3]["redactions"]) == (False, 0)
    snap = A.scan_inbound(df, policies).filter("request_id = 2")
    texts = snap.select(A.prompt_snapshot(F.col("messages")), A.prompt_snapshot_scanned(F.col("messages"), F.col("plan"))).first()
    assert texts[0] == "[REDACTED:EMAIL] [REDACTED:EMAIL]\n123-45-6789"
    assert texts[1] == "[REDACTED:EMAIL] [REDACTED:EMAIL]\n123-45-6789"  # a block rule never rewrites


def test_inbound_row_and_array_forms_agree(spark):
    policies = policy_rows(spark, (1, ["email"], "redact"), (1, ["ssn"], "block"))
    rnd = random.Random(11)
    pool = ["a@b.co", "123-45-6789", "nothing", "x@y.co z@w.co"]
    roles = ["user", "system", "assistant"]
    reqs = [(i, 1, [(rnd.choice(roles), rnd.choice(pool)) for _ in range(rnd.randint(1, 6))]) for i in range(60)]
    arrays = A.scan_inbound(spark.createDataFrame(reqs, MESSAGES), policies).select("request_id", "blocked", F.col("redactions").cast("long"))
    rows = [(i, org, pos, role, text) for i, org, m in reqs for pos, (role, text) in enumerate(m)]
    flat = spark.createDataFrame(rows, "request_id long, org_id long, pos int, role string, content string")
    by_rows = A.scan_inbound_rows(flat, policies, "request_id", "pos")
    assert sorted(map(tuple, arrays.collect())) == sorted(map(tuple, by_rows.select("request_id", "blocked", "redactions").collect()))


def test_entities_are_taken_in_turn(spark):
    """Many overlapping entities and findings, empty ones included, against a plain loop."""
    rnd = random.Random(17)
    rows = []
    for i in range(300):
        raw = [(s := rnd.randrange(60), -(s + rnd.randrange(1, 9)), j, "F", 2) for j in range(rnd.randrange(6))]
        ents = [(s := rnd.randrange(60), s + rnd.randrange(0, 12), f"E{j}", rnd.choice([0.4, 0.5, 0.9])) for j in range(rnd.randrange(25))]
        rows.append((i, raw, ents))
    rows.append((300, [], None))
    rows.append((301, [], [(2 * j, 2 * j + 3, f"E{j}", 0.9) for j in range(1000)]))
    df = spark.createDataFrame(rows, f"i int, raw array<{S.RAW}>, ents array<struct<start:int,end:int,label:string,score:double>>")
    for r in df.select("i", S.accept_entities(F.col("raw"), F.col("ents")).alias("got")).collect():
        _, raw, ents = rows[r["i"]]
        taken = []
        for start, end, label, score in ents or []:
            if score >= 0.5 and not any(start < b and a < end for a, b in [(f[0], -f[1]) for f in raw] + [t[:2] for t in taken]):
                taken.append((start, end, label))
        assert sorted((g["start"], -g["neg_end"], g["label"]) for g in r["got"]) == sorted(taken), rows[r["i"]]
