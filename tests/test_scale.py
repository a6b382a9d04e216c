"""What must hold for big inputs: plans, checked broadcasts, hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import policies as P
from cloakwork.operators import quota as Q
from cloakwork.operators import reports as R
from cloakwork.operators import scan as X
from cloakwork.plans import run, sizing
from cloakwork.sources.tables import append, read_table

from .conftest import policy_rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scan", "scan_deep", "entity_anti_join", "coalesce_rows", "usage_log_rows", "upsert_latest"])
def test_texts_are_scanned_once(spark, sf_dir, name):
    assert sum("RLIKE" in line for line in plan_of(run(name, spark, sf_dir)).split("\n")) == 1


@pytest.mark.parametrize("name", ["alerts_feed", "activity_feed", "events_feed", "personal_activity", "cosine_top_k"])
def test_feeds_are_cut_before_the_shuffle(spark, sf_dir, name):
    assert plan_of(run(name, spark, sf_dir)).count("WindowGroupLimit") == 2


def test_reads_push_down_and_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(
        F.col("id"), (F.col("id") % 3).alias("org_id"), F.lit("x").alias("wide"), F.lit("2024-01-01").alias("day")
    ).write.parquet(path)
    plan = plan_of(read_table(spark, path, ["id"], org=1))
    assert "PushedFilters: [IsNotNull(org_id), EqualTo(org_id,1)]" in plan and "ReadSchema: struct<id:bigint,org_id:bigint>" in plan


def test_daily_report_filters_both_facts_at_the_scan(spark, tmp_path):
    for name in ("usage", "alerts"):
        spark.range(10).select(
            (F.col("id") % 3).alias("org_id"), F.timestamp_seconds(F.lit(1706600000) + F.col("id")).alias("created_at")
        ).write.parquet(str(tmp_path / name))
    usage, alerts = (spark.read.parquet(str(tmp_path / n)) for n in ("usage", "alerts"))
    orgs = spark.createDataFrame([(0,), (1,)], "org_id long")
    plan = plan_of(R.daily_usage(usage, alerts, orgs, "2024-01-30"))
    assert plan.count("GreaterThanOrEqual(created_at,2024-01-21") == 2 and plan.count("LessThan(created_at") == 2


def test_append_writes_by_day_and_adds(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(50).select("id", F.concat(F.lit("2024-01-0"), F.col("id") % 3 + 1).alias("day"))
    append(df, path)
    append(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 100 and "PartitionFilters: [isnotnull(day" in plan_of(back.filter("day = date'2024-01-02'"))


def test_without_broadcasts_results_are_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    # two thirds of the texts belong to one organisation
    docs = [(i, 1 if rnd.random() < 0.67 else rnd.randint(2, 9), rnd.choice(["a@b.co x", "ssn 123-45-6789", "clean"])) for i in range(400)]
    df = spark.createDataFrame(docs, "id long, org_id long, text string")
    policies = policy_rows(spark, *[(o, ["email", "ssn"], a) for o, a in ((1, "redact"), (2, "flag"), (3, "block"))])

    def result():
        return sorted(map(str, X.scan(df, "text", "org_id", policies).collect()))

    small = result()
    monkeypatch.setattr(sizing, "estimated_bytes", lambda _: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(X.scan(df, "text", "org_id", policies))
        assert result() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_big_sides_get_no_hint(spark):
    df = spark.range(1000)
    assert "broadcast" in sizing.broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sizing.broadcast_if_small(df, limit=10)._jdf.queryExecution().logical().toString().lower()


def test_ranks_of_a_hot_organisation(spark):
    """Many requests in one minute, equal times included, ranked as one sort of the day would."""
    rnd = random.Random(12)
    base = 1706486400 - 90  # the day turns inside the data
    rows = [(i, 1 if rnd.random() < 0.8 else 2, base + rnd.randint(0, 180)) for i in range(900)]
    df = spark.createDataFrame(rows, "log_id long, org_id long, s long").withColumn("created_at", F.timestamp_seconds("s"))
    got = {r["log_id"]: r["n"] for r in Q.rank_within_day(df, slot=30).collect()}
    want, count = {}, {}
    for i, org, s in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (org, s // 86400)
        count[key] = want[i] = count.get(key, 0) + 1
    assert got == want


def test_plans_hold_one_entry_per_label(spark):
    """However many policies an organisation has, its plan is bounded by the catalogue."""
    many = policy_rows(spark, *[(1, ["email", "api_key", "secret", "token"], a) for a in ["flag", "redact", "block"] * 40])
    plan = P.org_plans(many).first()["plan"]
    assert set(plan) == {"EMAIL", "API_KEY"} and plan["EMAIL"]["rank"] == 3 and plan["EMAIL"]["ord"] == 0


def test_package_is_sent_to_the_workers(spark):
    """Functions that run inside tasks find the package wherever the workers start."""
    assert any(f.endswith("cloakwork.zip") for f in spark.sparkContext.listFiles)


def test_many_findings_in_one_text(spark):
    """Folds and masking go by blocks: thousands of findings come out right, and twice as many take about twice as long."""
    import time

    from cloakwork.operators.scan import scan

    from .conftest import policy_rows

    policies = policy_rows(spark, (1, ["email", "ssn"], "redact"))

    def run(n):
        text = " é ".join(f"u{i}@acme.co 123-45-{i % 10000:04d}" for i in range(n // 2))
        df = spark.createDataFrame([(1, 1, text)], "id long, org_id long, text string")
        start = time.perf_counter()
        row = scan(df, "text", "org_id", policies).select("text", "n_findings").first()
        return time.perf_counter() - start, row

    for n in (2, 510, 512, 514, 3000):
        _, row = run(n)
        assert row["n_findings"] == n
        assert row["text"] == " é ".join(["[REDACTED:EMAIL] [REDACTED:SSN]"] * (n // 2))
    run(16_000)
    few, many = (min(run(n)[0] for _ in range(2)) for n in (16_000, 32_000))
    assert many <= 2.2 * few, (few, many)
