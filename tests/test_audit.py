"""The audit rows of requests, against the scans of either side on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakwork.operators import audit as A
from cloakwork.operators.policies import org_plans, org_states, resolve_policies

from .conftest import policy_rows

MESSAGES = "array<struct<role:string,content:string>>"
CHOICES = "array<struct<idx:int,content:string>>"


def test_usage_rows_equal_both_scans(spark):
    mail, ssn = "mail jane@acme.co now", "ssn 123-45-6789"
    asked = [
        (1, 1, False, [("system", mail), ("user", mail), ("assistant", mail)]),
        (2, 1, True, [("user", mail)]),
        (3, 2, False, [("user", "fine"), ("user", f"{ssn} {ssn}"), ("user", ssn)]),  # the first blocking message counts
        (4, 2, False, [("user", "fine")]),  # blocking text in the answer only
        (5, 3, False, [("user", mail)]),  # no policy
        (6, 1, False, []),
        (7, 1, False, None),
        (8, 4, False, [("user", mail), ("user", None)]),  # zero retention
    ]
    told = [(1, [(0, mail), (1, "and b@c.co")]), (2, [(0, mail)]), (3, [(0, mail)]), (4, [(0, ssn)]), (5, [(0, mail)]), (6, []), (7, None), (8, [(0, mail)])]
    requests = spark.createDataFrame([(i, o, 9, "m", s, m) for i, o, s, m in asked], f"request_id long, org_id long, user_id long, model string, stream boolean, messages {MESSAGES}")
    answers = spark.createDataFrame([(i, "answer", 5, None, c) for i, c in told], f"request_id long, model string, prompt_tokens int, completion_tokens int, choices {CHOICES}")
    policies = policy_rows(spark, (1, ["email"], "redact"), (2, ["ssn"], "block"), (4, ["email"], "flag"))
    orgs = spark.createDataFrame([(1, False), (2, None), (4, True)], "org_id long, zero_retention boolean")
    rows = {r["log_id"]: r for r in A.usage_rows(requests, answers, policies, orgs).collect()}
    ins = {r["request_id"]: r for r in A.scan_inbound(requests, policies).withColumn("text", A.prompt_snapshot(F.col("messages"))).collect()}
    outs = {r["request_id"]: r for r in A.scan_outbound(answers.join(requests.select("request_id", "org_id"), "request_id"), policies).collect()}
    assert sorted(rows) == list(range(1, 9))
    for i, org, stream, messages in asked:
        r, sent, got = rows[i], ins[i], outs[i]
        stopped = bool(sent["blocked"])
        answered = not stopped and not stream
        assert (r["blocked"], r["streamed"]) == (stopped, stream and not stopped)
        assert r["redactions"] == (sent["redactions"] or 0) + ((got["out_redactions"] or 0) if answered else 0)
        assert (r["model"], r["prompt_tokens"], r["output_tokens"]) == (("answer", 5, 0) if answered else ("m", 0, 0))
        assert r["prompt_body"] == (None if stopped or org == 4 else "" if messages is None else sent["text"])
        assert r["response_body"] == (got["response_text"] if answered and org != 4 else None)
    assert rows[3]["blocked"] and rows[3]["redactions"] == 2 and not rows[4]["blocked"] and rows[4]["redactions"] == 1
    assert rows[5]["route"] is None  # an organisation that is in no table
    one = A.usage_rows(requests, answers.limit(0), policies, orgs)
    assert {r["response_body"] for r in one.collect()} == {None} and one.count() == 8


def test_states_read_policies_once(spark):
    """The same switches and plans as the two functions that find them apart, policies without a known detector included."""
    policies = policy_rows(spark, (1, ["email", "nope"], "redact"), (1, ["email"], "block"), (2, ["nope"], "flag"), (3, [], "redact"))
    policies = policies.withColumn("route", F.when(F.col("org_id") > 1, "selfhosted").otherwise("cloud")).withColumn("deep_scan", F.col("org_id") == 3)
    orgs = spark.createDataFrame([(i, None) for i in range(1, 5)], "org_id long, zero_retention boolean")
    both = resolve_policies(policies, orgs).drop("policies").join(org_plans(policies), "org_id", "left")
    cols = ["org_id", "plan", "route", "deep_scan", "rag_enabled"]
    got, want = ({r["org_id"]: r.asDict(True) for r in df.select(cols).collect()} for df in (org_states(policies, orgs), both))
    assert got == want and got[2]["plan"] is None and got[3]["route"] == "selfhosted" and got[4]["route"] == "cloud"
