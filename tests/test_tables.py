"""The layout of appended tables: which files and row groups a read opens."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakwork.sources import tables as TB

COLS = ["id", "org_id", "day"]


def scan(df):
    """(rows that came out of the file scan, files opened), after a run of a plan without shuffles."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = leaves.apply(0).metrics()
    return metrics.apply("numOutputRows").value(), metrics.apply("numFiles").value()


def log(spark, n, orgs):
    # a third of all rows belongs to one organisation, some to none
    org = F.when(F.col("n") % 3 == 0, 1).when(F.col("n") % 50 == 1, None).otherwise(F.col("n") % orgs)
    rows = spark.range(n).withColumnRenamed("id", "n")
    return rows.select((F.col("n") * 7919 % 1_000_003).alias("id"), org.cast("long").alias("org_id"), F.concat(F.lit("2024-01-0"), F.col("n") % 4 + 1).alias("day"))


def test_one_organisation_opens_its_buckets_only(spark, tmp_path):
    path, rows = str(tmp_path / "log"), log(spark, 40_000, 200)
    TB.append(rows.filter("id % 2 = 0"), path)
    TB.append(rows.filter("id % 2 = 1"), path)
    out, every = scan(TB.read_table(spark, path, COLS))
    assert out == 40_000 and every >= 2 * 4 * TB.ORG_BUCKETS
    for org in (1, 17, 150, 999):
        got = TB.read_table(spark, path, COLS, org=org)
        key = lambda r: (r["id"], str(r["day"]))
        want = rows.filter(F.col("org_id") == org)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
        assert scan(got)[1] <= every / TB.ORG_BUCKETS * 2  # one bucket of sixteen, however many organisations
        one_day = got.filter("day = date'2024-01-02'")
        assert scan(one_day)[1] <= every / TB.ORG_BUCKETS / 2
    assert TB.read_table(spark, path, COLS).filter("org_id is null").count() == rows.filter("org_id is null").count()


def test_ids_are_looked_up_by_bloom_filter(spark, tmp_path):
    rows = log(spark, 20_000, 50).filter("id % 1000 <> 500")  # ids that are not there lie between those that are
    plain, filtered = str(tmp_path / "plain"), str(tmp_path / "filtered")
    TB.append(rows, plain)
    TB.append(rows, filtered, ids=("id",), per_group=1000)
    wanted = [r["id"] for r in rows.limit(5).collect()]
    read = lambda path, i: TB.read_table(spark, path, COLS).filter(F.col("id") == int(i))
    for i in wanted:
        assert read(filtered, i).count() == read(plain, i).count() > 0
    absent = [500_500, 123_500, 777_500]
    assert sum(scan(read(filtered, i))[0] for i in absent) < sum(scan(read(plain, i))[0] for i in absent) / 5
    assert all(read(filtered, i).count() == 0 for i in absent)


def test_tables_without_organisations_or_rows(spark, tmp_path):
    path = str(tmp_path / "days")
    TB.append(log(spark, 100, 5).drop("org_id"), path)
    assert TB.read_table(spark, path, ["id", "day"]).count() == 100
    empty = str(tmp_path / "empty")
    TB.append(log(spark, 0, 5), empty)
    TB.append(log(spark, 10, 5), empty)
    assert TB.read_table(spark, empty, COLS, org=1).count() == log(spark, 10, 5).filter("org_id = 1").count()
