from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from cloakwork.plans.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        app="tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


POLICY = "policy_id long, org_id long, name string, enabled boolean, patterns array<string>, action string, deep_scan boolean, route string, rag_enabled boolean, created_at timestamp"


def policy_rows(spark, *rows):
    """Policies from (org_id, patterns, action[, enabled[, deep_scan]])."""
    import datetime as dt

    made = []
    for i, (org, patterns, action, *more) in enumerate(rows):
        enabled = more[0] if more else True
        deep = more[1] if len(more) > 1 else False
        made.append((i, org, f"p{i}", enabled, patterns, action, deep, "cloud", False, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)))
    return spark.createDataFrame(made, POLICY)
