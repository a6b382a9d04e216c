"""Every registered query against its check SQL, whole results, on the small tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cloakwork.plans import load_queries
from tools.check import compare, duck

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(load_queries()))
def test_query(name, spark, sf_dir, con):
    built = []

    def build(session, folder):
        built.append(queries()[name](session, folder))
        return built[0]

    ok, note = compare(spark, con, sf_dir, name, build, SQL.get(name))
    assert ok, note
    # nothing pairs every row with every row
    plan = built[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_the_approximate_searches_have_no_sql():
    assert set(load_queries()) - set(SQL) == {"approx_top_k", "indexed_top_k"}


def test_entry(spark):
    assert entry(spark).count() > 0


def test_activity_has_every_event_of_a_user(spark, sf_dir):
    from cloakwork.plans import bindings

    events, users = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("events", "customer"))
    want = events.join(users, events.user_id == users.c_custkey).count()
    activity = bindings.table(spark, sf_dir, "activity")
    assert activity.count() == want and activity.filter("action = 'view'").count() > 0
