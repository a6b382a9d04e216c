"""The fixed catalogues as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import DETECTORS, INTEGRATIONS, PACKS, Catalogue, Detector
from ..functions.patterns import check_pattern

#: Detectors that a catalogue may have: each becomes part of one expression.
MAX_DETECTORS = 256


def detectors(spark: SparkSession) -> DataFrame:
    """Built-in detectors first, then the regional ones, in a fixed order."""
    rows = [(i, d.key, d.label) for i, d in enumerate(DETECTORS)]
    return spark.createDataFrame(rows, "position int, pattern string, label string")


def detector_rows(spark: SparkSession) -> DataFrame:
    """The fixed catalogue in the form that `user_catalogue` reads."""
    rows = [(i, d.key, d.label, d.body, d.any_case) for i, d in enumerate(DETECTORS)]
    return spark.createDataFrame(rows, "position int, key string, label string, pattern string, any_case boolean")


def user_catalogue(rows: DataFrame) -> Catalogue:
    """Detectors that users bring as a relation (key, label, pattern[, any_case][, position]), read when a query is planned.

    Order is by position, then key. An expression that could backtrack without bound is refused, as are a key with two
    detectors, a null, and more than `MAX_DETECTORS` rows; the same row twice counts once.
    """
    given = rows.select(
        "key",
        "label",
        "pattern",
        F.coalesce("any_case", F.lit(False)).alias("any_case") if "any_case" in rows.columns else F.lit(False).alias("any_case"),
        F.col("position").cast("long").alias("position") if "position" in rows.columns else F.lit(0).cast("long").alias("position"),
    )
    once = given.groupBy("key", "label", "pattern", "any_case").agg(F.min("position").alias("position"))
    found = once.orderBy("position", "key").limit(MAX_DETECTORS + 1).collect()
    if len(found) > MAX_DETECTORS:
        raise ValueError(f"a catalogue has at most {MAX_DETECTORS} detectors")
    if any(None in (r["key"], r["label"], r["pattern"]) for r in found):
        raise ValueError("a detector has a key, a label and a pattern")
    if len({r["key"] for r in found}) < len(found):
        raise ValueError("a key names one detector")
    return Catalogue(tuple(Detector(r["key"], r["label"], check_pattern(r["pattern"], r["any_case"]), r["any_case"]) for r in found))


def rule_packs(spark: SparkSession) -> DataFrame:
    """One row per rule of each regional pack."""
    rows = [
        (p.pack_id, p.name, p.region, p.description, [{"pattern": k, "label": label} for k, label in p.rules])
        for p in PACKS
    ]
    packs = spark.createDataFrame(
        rows,
        "pack_id string, name string, region string, description string, rules array<struct<pattern:string,label:string>>",
    )
    return packs.select("pack_id", "name", "region", "description", F.explode("rules").alias("r")).select(
        "pack_id", "name", "region", "description", "r.pattern", F.col("r.label").alias("rule_label")
    )


def integration_rows() -> Column:
    """The integration catalogue as an array literal, to explode next to an organisation."""
    return F.array(
        *[
            F.struct(
                F.lit(i.slug).alias("slug"),
                F.lit(i.name).alias("name"),
                F.lit(i.description).alias("description"),
                F.lit(i.icon).alias("icon"),
                F.lit(i.configurable).alias("configurable"),
            )
            for i in INTEGRATIONS
        ]
    )
