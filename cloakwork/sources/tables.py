"""Tables at rest: pruned reads, and appends in a layout that reads can prune.

Appended rows lie in folders by day and by bucket of their organisation (`org16=3`: the fourth of sixteen), so that a read
of one organisation opens its bucket's files only. In a file rows are in the order of organisations, and ids may have
Bloom filters: Parquet then skips row groups without the organisation or id asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of organisations in the folder of a day.
ORG_BUCKETS = 16


def _bucket(org: Column, buckets: int) -> Column:
    """Organisations are taken as text, so that an int and a long of one value meet."""
    return F.pmod(F.xxhash64(org.cast("string")), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str, cols: list[str], org: object | None = None, schema: str | None = None) -> DataFrame:
    """The named columns of a Parquet table, of one organisation or of all; both reach the scan, and of a table that
    `append` wrote only the organisation's buckets are opened."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path)
    if org is not None:
        asked = F.col("org_id") == F.lit(org)
        for column in rows.columns:
            if laid := re.fullmatch(r"org(\d+)", column):
                asked &= F.col(column) == _bucket(F.lit(org), int(laid[1]))
        rows = rows.filter(asked)
    return rows.select(*cols)


def append(df: DataFrame, path: str, day_col: str = "day", org_buckets: int = ORG_BUCKETS, ids: tuple[str, ...] = (), per_group: int = 1_000_000) -> None:
    """Append rows by day and, where they have `org_id`, by bucket of it; rows without one have a bucket as well.

    The rebalance hint groups the rows of a folder to avoid many tiny files, and lets AQE split a folder that is too big
    for one task, such as that of a busy organisation. `ids` get Bloom filters, for `per_group` ids a row group.
    """
    folders, rows = [day_col], df
    if "org_id" in df.columns:
        folders.append(f"org{org_buckets}")
        rows = df.withColumn(folders[1], _bucket(F.col("org_id"), org_buckets))
    laid = rows.hint("rebalance", *[F.col(c) for c in folders])
    if "org_id" in df.columns:
        laid = laid.sortWithinPartitions(*folders, "org_id")
    writer = laid.write.mode("append").partitionBy(*folders)
    for c in ids:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(per_group))
    writer.parquet(path)
