"""Tables stored in buckets of their key, changed bucket by bucket.

A table is a folder with `data/<version>/bucket=<n>/` and `manifest/version=<n>/`. A manifest says, for each bucket that
has rows, which version's folder holds it. A merge reads and writes only the buckets that its changes fall into; all
others stay the files they are. The new manifest is one small file that is written last, so a merge that fails, or loses
its executors, leaves the table as it was, and of two merges of one version the later fails. Everything goes through
Spark's readers and writers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that buckets are told by.
BUCKET = "_bucket"
_MANIFEST = "bucket int, folder string, buckets int, keys array<string>, shape string"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row by its key. Keys are taken as text, so that an int and a long of one value meet."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


class StoredTable:
    """A stored table at one version."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        """The latest version, or the one asked for."""
        self.spark, self.path = spark, path.rstrip("/")
        manifest = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{self.path}/manifest")
        if version is None:
            version = manifest.agg(F.max("version")).first()[0]
        rows = manifest.filter(F.col("version") == version).collect() if version is not None else []  # one row per bucket
        if not rows:
            raise ValueError(f"{path} holds no stored table of version {version}")
        self.version, self.buckets, self.keys = version, rows[0]["buckets"], rows[0]["keys"]
        self.schema = T.StructType.fromJson(json.loads(rows[0]["shape"]))
        self.folders = {r["bucket"]: r["folder"] for r in rows if r["folder"] is not None}

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], buckets: int) -> StoredTable:
        """Store `df`. Choose as many buckets as make one of them a task's work, for the size that the table will grow to."""
        path = path.rstrip("/")
        cls._put(df.sparkSession, df, path, 0, keys, buckets, {}, range(buckets))
        return cls(df.sparkSession, path)

    @staticmethod
    def _put(spark: SparkSession, rows: DataFrame, path: str, version: int, keys: list[str], buckets: int, folders: dict, touched) -> None:
        """Write the rows of the touched buckets, then the manifest of the version."""
        folder = f"{path}/data/{version}"
        dealt = rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(folder)  # over what an attempt left that failed later
        try:
            made = [r[0] for r in spark.read.parquet(folder).select(BUCKET).distinct().collect()]
        except AnalysisException:  # nothing is left in any touched bucket
            made = []
        now = {b: f for b, f in folders.items() if b not in set(touched)} | {b: f"{folder}/{BUCKET}={b}" for b in made}
        shape = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).json()
        lines = [(b, f, buckets, keys, shape) for b, f in sorted(now.items())] or [(0, None, buckets, keys, shape)]
        spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows, of all buckets or of some."""
        folders = [f for b, f in sorted(self.folders.items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose key is among `wanted`, from the buckets that may hold them."""
        return self.read(self.touched(wanted)).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets that changes fall into; at most all of them."""
        return [r[0] for r in changes.select(bucket_of(self.keys, self.buckets).alias("b")).distinct().collect()]

    def merge(self, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> StoredTable:
        """The table after `step(current, changes) → next`, which is given the rows of the touched buckets only and must
        leave every row in its key's bucket. Without changes the table stays at its version."""
        touched = self.touched(changes)
        if not touched:
            return self
        after = step(self.read(touched), changes)
        same = after.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        self._put(self.spark, same, self.path, self.version + 1, self.keys, self.buckets, self.folders, touched)
        return StoredTable(self.spark, self.path, self.version + 1)
