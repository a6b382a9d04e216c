"""What the operators of this subpackage share: column picking, Arrow maps, the shared folder, query registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.session import configure, fresh_path, spread

#: Rows of an Arrow batch: texts can be long, so batches are short.
BATCH_ROWS = 1024

#: Bytes of a written table up to which it is broadcast; beyond them Spark joins by shuffling.
SMALL = 8 << 20

#: name → (builder, check SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Register a builder (spark, sf_dir) → DataFrame under `name`."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = (build, sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole base table, with the session prepared for Arrow maps over long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names; `columns` maps new name → name in `df`.

    Names match exactly first, so a further column that differs only in case does no harm, nor do names with dots.
    """
    names = df.columns
    places = {}
    for new, old in columns.items():
        places[new] = names.index(old) if old in names else [n.lower() for n in names].index(old.lower())
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"c{i}").alias(new) for new, i in places.items()])


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null text as empty, spread over the cores when the input is a single small file."""
    picked = pick(df, doc_id=id_col, text=text_col)
    return spread(picked.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))


def map_lists(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """Map Arrow batches through `make()`: it takes the batch's columns as lists and returns the output columns as lists.

    `make` runs once per task, so whatever it holds (a tokenizer, a cache) lives as long as the task.
    """
    struct = T._parse_datatype_string(schema)
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            columns = step(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, struct)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
