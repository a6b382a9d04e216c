"""Reports kept up to date: partial sums of a table, maintained from its change-feed.

A change is a row of the table with `_change`: insert, delete, or one half of an update (update_preimage,
update_postimage). What a report counts is summed per key over the rows; a row that comes adds to the sums, one that goes
takes its part back. So a feed costs what it holds, however large the table is, and the order of its changes does not
matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import StoredTable

CHANGE = "_change"
ADDING, TAKING = ("insert", "update_postimage"), ("delete", "update_preimage")


class Partials:
    """What is kept of a table: sums of whole numbers per key.

    `keys` and `sums` are columns by name, over the rows that `facts` makes of the table's rows (as they are, by default).
    `n_rows` is always kept; a key whose rows are all gone is dropped. Keys may be null.
    """

    def __init__(self, keys: dict[str, Column], sums: dict[str, Column] | None = None, facts: Callable[[DataFrame], DataFrame] | None = None):
        self.keys, self.sums, self.facts = keys, {"n_rows": F.lit(1), **(sums or {})}, facts or (lambda rows: rows)

    def of(self, rows: DataFrame, sign: Column | None = None) -> DataFrame:
        """(keys, sums) of rows, combined on the map side; `sign` says whether a row adds (1) or takes (-1)."""
        facts = self.facts(rows if sign is None else rows.withColumn("_sign", sign))
        by = F.lit(1) if sign is None else F.col("_sign")
        sums = [F.coalesce(F.sum(c.cast("bigint") * by), F.lit(0)).cast("bigint").alias(name) for name, c in self.sums.items()]
        return facts.groupBy(*[c.alias(name) for name, c in self.keys.items()]).agg(*sums)

    def of_changes(self, changes: DataFrame) -> DataFrame:
        """What a feed adds to the sums; a change of an unknown kind is an error."""
        kind = F.col(CHANGE)
        sign = F.when(kind.isin(*ADDING), 1).when(kind.isin(*TAKING), -1).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null")))))
        return self.of(changes, sign)

    def added(self, kept: DataFrame, more: DataFrame) -> DataFrame:
        """The sums after more has been added; (keys, sums) both."""
        every = kept.unionByName(more).groupBy(*self.keys)
        # a row may go before it has come: its key is kept, below nothing, until that evens out
        return every.agg(*[F.sum(c).alias(c) for c in self.sums]).filter(" or ".join(f"{c} <> 0" for c in self.sums))

    def store(self, rows: DataFrame, path: str, buckets: int) -> StoredTable:
        """Begin with the table as it is."""
        return StoredTable.create(self.of(rows), path, list(self.keys), buckets)

    def apply(self, spark: SparkSession, path: str, changes: DataFrame, version: int) -> StoredTable:
        """Add a feed to the sums of `version`, giving the next. Done again, it finds the next version and leaves it, so a
        job that lost its answer can be repeated. Only the buckets of keys that the feed touches are written."""
        latest = StoredTable(spark, path)
        if latest.version > version:
            return StoredTable(spark, path, version + 1)
        return latest.merge(self.of_changes(changes), self.added)


def per_day(sums: dict[str, Column] | None = None) -> Partials:
    """Partials per organisation and UTC day."""
    return Partials({"org_id": F.col("org_id"), "day": F.to_date("created_at")}, sums)


def per_label() -> Partials:
    """Partials per organisation and label of events with `labels`."""

    def caught(events: DataFrame) -> DataFrame:
        return events.withColumn("label", F.explode("labels"))

    return Partials({"org_id": F.col("org_id"), "label": F.col("label")}, facts=caught)
