"""The registered queries: name → (Spark builder, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bindings


class Inputs:
    """Hands a query its input tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        return bindings.table(self.spark, self.sf_dir, name)

    def stream(self, name: str, source: str) -> DataFrame:
        return bindings.stream_table(self.spark, self.sf_dir, name, source)


class Query(NamedTuple):
    build: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, reads: str = "") -> Callable:
    """Register a builder under `name`; `sql` is its check, put behind the CTEs of the bindings in `reads`."""

    def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = Query(build, bindings.sql_with(reads, sql) if sql else None)
        return build

    return add


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(QUERIES[name].build(Inputs(spark, sf_dir)))


def widen(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that result types do not depend on the engine's literals."""
    return df.select(
        *[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f"`{f.name}`") for f in df.schema]
    )


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


STAMP_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def render(findings: Column) -> Column:
    """A span array as text, for comparing across engines."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["label"], f["start"].cast("string"), f["end"].cast("string"), f["rank"].cast("string"))),
        ";",
    )
