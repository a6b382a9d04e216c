"""Corpus pipeline: from raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns they were given. Decisions are about whole rows (id and text), so that repeated ids
with different texts are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import jaccard_join, language_id, packing, secrets, toxicity
from cloakwork.llm.common import SMALL, table, written
from cloakwork.plans.sizing import broadcast_if_small

#: No SQL expresses the network, the links or the packing; tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with what decisions are keyed by; null ids are a key like any other."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_key_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("_key_text", F.xxhash64(text))


def _keys(decided: DataFrame) -> DataFrame:
    keys = decided.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_key_id"), F.col("text_key").alias("_key_text"))
    return written(keys.distinct(), "decisions")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key is not among `keys`, which are broadcast only while their written table is small."""
    return docs.join(broadcast_if_small(keys, SMALL), ["_key_id", "_key_text"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some known language; blank texts and texts in none go."""
    found = language_id.identify(docs, declared_col="lang", host_col="source")
    return _without(_keyed(docs), _keys(found.filter(~F.col("kept")))).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labelled ones among them, does not call toxic."""
    net = spark.sparkContext.broadcast(toxicity.train(docs, table(spark, sf_dir, "labels")))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(toxicity.score_texts(net.value, batch.fillna("").tolist()), dtype="float64")

    return docs.filter(score(F.col("text").cast("string")) < 0.5)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that of the smallest id."""
    found = written(jaccard_join.near_duplicates(docs), "near-duplicates").filter(F.col("component").isNotNull())
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("order"), F.col("doc_id"), F.col("text_key"))
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    # groups of one row need no decision; of the others, every row but the first goes
    groups = found.groupBy("component").agg(F.count("*").alias("rows")).filter("rows > 1")
    stay = first.join(groups, "component").select("component", F.col("first.doc_id").alias("stay_id"), F.col("first.text_key").alias("stay_text"))
    members = found.join(stay, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_key") == F.col("stay_text"))
    left = _without(_keyed(docs), _keys(members.filter(~stays)))
    # the same row several times: its id and text stay, but once
    again = _keys(members.filter(stays).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1"))
    if not again.limit(1).count():
        return left.select(docs.columns)
    repeated = left.join(broadcast_if_small(again, SMALL), ["_key_id", "_key_text"], "left_semi").dropDuplicates(["_key_id", "_key_text"])
    return _without(left, again).unionByName(repeated).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers and secrets masked; `n_chars` follows the text."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None else secrets.redact(t))

    old: Column = F.col("text").cast("string")
    out = docs.withColumn("_masked", masked(old))
    changed = F.col("_masked") != F.col("text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("_masked")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("_masked")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
