"""Streams of events and requests: ingest with alerts, daily counters, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.notify import event_alerts
from ..operators.quota import decided, plan_limit, rank_within_day
from ..plans.sizing import broadcast_if_small

#: A counter is forgotten so long after it was begun.
COUNTER_EXPIRY = "25 hours"
#: Micro-batches after which the counters are summed up.
FOLD_EVERY = 16


def write_batch(df: DataFrame, path: str, batch_id: int, by: tuple[str, ...] = ()) -> None:
    """One folder per micro-batch, replaced when the batch is repeated, so a restart writes nothing twice."""
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch_id}")


def ingest(events: DataFrame, events_path: str, alerts_path: str) -> DataStreamWriter:
    """Stores events and the alerts they raise; the alerts are made from what was stored, so the source is read once."""

    def both(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, events_path, batch_id)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{events_path}/batch={batch_id}")
        write_batch(event_alerts(stored), alerts_path, batch_id)

    return events.writeStream.foreachBatch(both)


def count_daily(rows: DataFrame, path: str, measures: dict[str, Column] | None = None, ts_col: str = "created_at") -> DataStreamWriter:
    """Writes what each micro-batch adds to the counters per organisation and UTC day.

    Nothing is kept between micro-batches and nothing is ever too late: `totals` adds up whatever has been written, in
    any order. Rows without time or organisation are counted under null. `measures` are further sums by name.
    """

    def count(batch: DataFrame, batch_id: int) -> None:
        sums = [c.alias(name) for name, c in (measures or {}).items()]
        write_batch(batch.groupBy("org_id", F.to_date(ts_col).alias("day")).agg(F.count("*").alias("requests"), *sums), path, batch_id)

    return rows.writeStream.foreachBatch(count)


def totals(counts: DataFrame) -> DataFrame:
    """The counters of what `count_daily` wrote: everything added up per organisation and day."""
    rest = [c for c in counts.columns if c not in ("org_id", "day", "batch")]
    return counts.groupBy("org_id", "day").agg(*[F.sum(c).alias(c) for c in rest])


def compact(spark: SparkSession, path: str, to: str, through: int) -> None:
    """Adds up the micro-batches up to `through` into one folder of `to`; readers then take `since_compaction`."""
    write_batch(totals(spark.read.parquet(path).filter(F.col("batch") <= through)), to, through)


def since_compaction(spark: SparkSession, path: str, to: str, through: int) -> DataFrame:
    """The compacted counters and the micro-batches after them, for `totals`."""
    later = spark.read.parquet(path).filter(F.col("batch") > through)
    return spark.read.parquet(f"{to}/batch={through}").withColumn("batch", F.lit(through)).unionByName(later)


def stream_quota(counts: DataFrame, orgs: DataFrame) -> DataFrame:
    """The counter per organisation and UTC day, capped at the plan's limit, from what `count_daily` wrote."""
    plans = broadcast_if_small(orgs.select("org_id", "plan"))
    return totals(counts).join(plans, "org_id", "left").select("org_id", "day", F.least("requests", plan_limit(F.col("plan"))).alias("used"))


def admit(
    requests: DataFrame,
    orgs: DataFrame,
    decisions_path: str,
    counts_path: str,
    ts_col: str = "created_at",
    id_col: str = "log_id",
    every: int = FOLD_EVERY,
    expires: str = COUNTER_EXPIRY,
) -> DataStreamWriter:
    """Admits or rejects requests in the order they come, by the counter their organisation has reached that day.

    Ranks within a micro-batch are found as in the batch operator, in slots, so a busy organisation is not counted by
    one task. Each batch writes its decisions and what it adds to the counters (`Counters`); the work of a batch does not
    grow with the age of the stream. A counter begun longer than `expires` ago is forgotten when counters are next summed
    up. All writes replace what a failed attempt left, and a stream with a new checkpoint goes on from the counters that
    the one before it left in `counts_path`.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # stays the same as long as the checkpoint does
        kept = Counters(spark, counts_path, run, every, expires)
        plans = broadcast_if_small(orgs.select("org_id", "plan"))
        ranked = (
            rank_within_day(batch, ts_col, id_col)
            .join(plans, "org_id", "left")
            .join(broadcast_if_small(kept.before(batch_id).select("org_id", "day", F.col("requests").alias("_used"))), ["org_id", "day"], "left")
            .withColumn("n", F.col("n") + F.coalesce("_used", F.lit(0)))
        )
        write_batch(decided(ranked).drop("n", "_used"), f"{decisions_path}/run={run}", batch_id)
        kept.add(batch.groupBy("org_id", F.to_date(ts_col).alias("day")).agg(F.count("*").alias("requests")), batch_id)

    return requests.writeStream.foreachBatch(decide)


class Counters:
    """Counters per organisation and day of one stream, kept as what each micro-batch added and, after every `every`
    batches, as their sum.

    Which folders hold the counters before a batch follows from its number, so none are listed: the last sum, and at
    most `every` - 1 batches since. A batch that is repeated replaces its own folders and finds the ones before it as they
    were, as those are deleted only when the next sum but one has been written. Rows without organisation or day are not
    counted.
    """

    SCHEMA = "org_id bigint, day date, requests bigint, begun timestamp"

    def __init__(self, spark: SparkSession, path: str, run: str, every: int = FOLD_EVERY, expires: str = COUNTER_EXPIRY):
        self.spark, self.path, self.run, self.every, self.expires = spark, path.rstrip("/"), run, every, expires

    def _folder(self, kind: str, batch: int, run: str | None = None) -> str:
        return f"{self.path}/run={run or self.run}/{kind}={batch}"

    def before(self, batch_id: int) -> DataFrame:
        """(org_id, day, requests, begun) as they were before the batch."""
        since = batch_id // self.every * self.every
        if batch_id == 0:
            self._take_over()
        return self._sum([self._folder("sum", since - 1)] + [self._folder("batch", b) for b in range(since, batch_id)])

    def add(self, counts: DataFrame, batch_id: int) -> None:
        """Adds (org_id, day, requests) of a batch, whose predecessors have all been added."""
        known = counts.filter("org_id is not null and day is not null").withColumn("begun", F.current_timestamp())
        known.write.mode("overwrite").parquet(self._folder("batch", batch_id))
        if (batch_id + 1) % self.every:
            return
        first = batch_id + 1 - self.every
        parts = [self._folder("sum", first - 1)] + [self._folder("batch", b) for b in range(first, batch_id + 1)]
        fresh = self._sum(parts).filter(F.col("begun") >= F.current_timestamp() - F.expr(f"interval {self.expires}"))
        fresh.write.mode("overwrite").parquet(self._folder("sum", batch_id))
        outdated = [self._folder("sum", first - 1 - self.every)] + [self._folder("batch", b) for b in range(first - self.every, first)]
        for folder in outdated if first else []:
            self._fs(folder).delete(self._path(folder), True)

    def _sum(self, folders: list[str]) -> DataFrame:
        parts = self.spark.read.schema(self.SCHEMA).parquet(*folders)
        return parts.groupBy("org_id", "day").agg(F.sum("requests").alias("requests"), F.min("begun").alias("begun"))

    def _take_over(self) -> None:
        """The first sum: what the run that wrote last has left, or nothing. Done once per checkpoint, so listing is fine."""
        start, root = self._folder("sum", -1), self._path(self.path)
        fs = self._fs(self.path)
        runs = [s for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("run=")]
        others = {s.getPath().getName()[4:]: s.getPath() for s in runs if s.getPath().getName() != f"run={self.run}"}
        written: dict[str, dict[tuple[str, int], int]] = {}
        for run, at in others.items():
            for s in fs.listStatus(at):
                kind, _, number = s.getPath().getName().partition("=")
                done = self._path(f"{s.getPath().toString()}/_SUCCESS")
                if kind in ("sum", "batch") and fs.exists(done):
                    written.setdefault(run, {})[kind, int(number)] = fs.getFileStatus(done).getModificationTime()
        if not written:
            self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(start)
            return
        run = max(written, key=lambda r: max(written[r].values()))
        through = max(n for kind, n in written[run] if kind == "sum")
        later = [n for kind, n in written[run] if kind == "batch" and n > through]
        left = self._sum([self._folder("sum", through, run)] + [self._folder("batch", n, run) for n in sorted(later)])
        left.write.mode("overwrite").parquet(start)

    def _path(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(folder)

    def _fs(self, folder: str):
        return self._path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
