"""Sums kept from a change-feed, against sums over the whole table after each feed."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import kept as K
from cloakwork.sources.stored import StoredTable

ROW = "id long, org_id long, created_at timestamp, blocked boolean"
FEED = f"{ROW}, _change string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_feeds_of_all_kinds(spark, tmp_path):
    import datetime as dt

    rnd = random.Random(5)

    def row(i):
        day = dt.datetime(2024, 1, rnd.randint(1, 9), rnd.randint(0, 23))
        return (i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([day, day, day, None]), rnd.choice([True, False, None]))

    parts = K.per_day({"blocked": F.coalesce(F.col("blocked").cast("int"), F.lit(0))})
    now = {i: row(i) for i in range(60)}
    path = str(tmp_path / "partials")
    table = parts.store(spark.createDataFrame(list(now.values()), ROW), path, 4)
    key = lambda r: tuple(map(str, r))
    for step in range(3):
        feed = []
        for i in rnd.sample(sorted(now), 25):
            feed.append((*now[i], "update_preimage" if i % 2 else "delete"))
            del now[i]
            if i % 2:
                now[i] = row(i)
                feed.append((*now[i], "update_postimage"))
        for i in range(100 + 10 * step, 110 + 10 * step):
            now[i] = row(i)
            feed.append((*now[i], "insert"))
        rnd.shuffle(feed)
        changes = spark.createDataFrame(feed, FEED)
        table = parts.apply(spark, path, changes, step)
        assert parts.apply(spark, path, changes, step).version == table.version == step + 1  # done again: nothing twice
        want = parts.of(spark.createDataFrame(list(now.values()), ROW))
        cols = ["org_id", "day", "n_rows", "blocked"]
        assert sorted(map(tuple, table.read().select(cols).collect()), key=key) == sorted(map(tuple, want.select(cols).collect()), key=key)


def test_untouched_buckets_and_empty_feeds(spark, tmp_path):
    parts, path = K.per_day(), str(tmp_path / "partials")
    rows = spark.sql("select id, id % 40 as org_id, timestamp'2024-01-01' as created_at, true as blocked from range(400)")
    table = parts.store(rows, path, 8)
    before = dict(table.folders)
    one = rows.filter("id = 7").withColumn("_change", F.lit("delete"))
    table = parts.apply(spark, path, one, 0)
    assert sum(before[b] != f for b, f in table.folders.items()) == 1
    held = files(path)
    assert parts.apply(spark, path, one.limit(0), 1).version == 1 and files(path) == held
    early = K.per_day()
    gone = str(tmp_path / "early")
    table = early.store(rows.limit(0), gone, 2)
    table = early.apply(spark, gone, one, table.version)  # it goes before it has come
    assert [r["n_rows"] for r in table.read().collect()] == [-1]
    table = early.apply(spark, gone, one.withColumn("_change", F.lit("insert")), table.version)
    assert table.read().count() == 0 and StoredTable(spark, gone).version == 2
    with pytest.raises(Exception, match="unknown change: renamed"):
        parts.of_changes(one.withColumn("_change", F.lit("renamed"))).collect()


def test_labels(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["A", "B", "A"]), (1, []), (2, None), (2, ["B"])], "org_id long, labels array<string>")
    table = K.per_label().store(rows, str(tmp_path / "p"), 2)
    feed = rows.limit(1).withColumn("_change", F.lit("delete"))
    table = K.per_label().apply(spark, str(tmp_path / "p"), feed, table.version)
    assert [tuple(r) for r in table.read().select("org_id", "label", "n_rows").collect()] == [(2, "B", 1)]
