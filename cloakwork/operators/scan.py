"""Scanning text columns under per-organisation policies. Row-local apart from attaching the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.catalog import BUILT_IN, Catalogue
from ..functions.spans import scan_text
from .policies import with_plan


def scan(df: DataFrame, text_col: str, org_col: str, policies: DataFrame, catalogue: Catalogue = BUILT_IN) -> DataFrame:
    """Adds findings, n_findings and blocked, and replaces the text by its redacted form. `catalogue` may be one that
    users bring (`sources.catalogs.user_catalogue`)."""
    return scan_deep(df, text_col, org_col, policies, catalogue=catalogue)


def scan_deep(
    df: DataFrame,
    text_col: str,
    org_col: str,
    policies: DataFrame,
    entities: str | None = None,
    deep_col: str | None = None,
    catalogue: Catalogue = BUILT_IN,
) -> DataFrame:
    """`scan` plus model entities from the array column `entities` where `deep_col` (default: always) allows it."""
    ents = None
    if entities is not None:
        ents = F.when(F.col(deep_col), F.col(entities)) if deep_col else F.col(entities)
    planned = with_plan(df, policies, org_col, catalogue=catalogue)
    scanned = planned.withColumn("_scan", scan_text(F.col(text_col), F.col("plan"), ents, catalogue))
    keep = [c for c in df.columns if c != text_col]
    return scanned.select(
        *keep,
        F.col("_scan.text").alias(text_col),
        F.col("_scan.findings").alias("findings"),
        F.col("_scan.n_findings").alias("n_findings"),
        F.col("_scan.blocked").alias("blocked"),
    )


def redact_at_rest(df: DataFrame, text_col: str, org_col: str, policies: DataFrame) -> DataFrame:
    """The text with every match of any enabled policy masked, whatever its action."""
    scanned = with_plan(df, policies, org_col, force_redact=True)
    return scanned.select(
        *[c for c in df.columns if c != text_col], scan_text(F.col(text_col), F.col("plan"))["text"].alias(text_col)
    )


def span_rows(df: DataFrame, id_col: str, spans_col: str) -> DataFrame:
    """The table form of a span column: one row per span.

    The outer explode keeps Spark from deriving a filter on the array's size, which it would push below the scan and
    so run every detector a second time.
    """
    rows = df.select(id_col, F.explode_outer(spans_col).alias("s"))
    return rows.filter(F.col("s").isNotNull()).select(id_col, "s.*")


def running_max_end(spans: DataFrame, id_col: str) -> DataFrame:
    """Span rows with the largest end among the spans before each one, in (start, widest, ord) order.

    The window is one text's spans, so it is bounded by the length of a text.
    """
    w = Window.partitionBy(id_col).orderBy("start", F.desc("end"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("max_end_before", F.max("end").over(w))


def coalesce_rows(spans: DataFrame, id_col: str) -> DataFrame:
    """Merging in table form (gaps and islands); same result as `coalesce_spans` on the array."""
    w = Window.partitionBy(id_col).orderBy("start", F.desc("end"), "ord")
    fresh = F.col("max_end_before").isNull() | (F.col("start") >= F.col("max_end_before"))
    return (
        running_max_end(spans, id_col)
        .withColumn("island", F.sum(fresh.cast("int")).over(w))
        .groupBy(id_col, "island")
        .agg(
            F.min_by("label", F.struct("start", -F.col("end"), "ord")).alias("label"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max("rank").alias("rank"),
        )
        .drop("island")
    )


#: Width in characters of the position bins that overlap joins meet in.
OVERLAP_BIN = 256


def entity_anti_join(findings: DataFrame, entities: DataFrame, id_col: str, entity_id: str) -> DataFrame:
    """Entity rows overlapping no finding of the same text.

    Both sides are cut into position bins, so the join is an equality on (text, bin) and even a single huge text
    spreads over many tasks instead of pairing all its spans.
    """

    def binned(df: DataFrame) -> DataFrame:
        last = F.floor((F.greatest("end", F.col("start") + 1) - 1) / OVERLAP_BIN)
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / OVERLAP_BIN), last)))

    f = binned(findings.select(id_col, "start", "end")).select(
        F.col(id_col).alias("_id"), F.col("bin").alias("_bin"), F.col("start").alias("_start"), F.col("end").alias("_end")
    )
    e = binned(entities.select(id_col, entity_id, "start", "end"))
    hit = (
        e.join(
            f,
            (F.col(id_col) == F.col("_id"))
            & (F.col("bin") == F.col("_bin"))
            & (F.col("start") < F.col("_end"))
            & (F.col("_start") < F.col("end")),
            "left_semi",
        )
        .select(id_col, entity_id)
        .distinct()
    )
    return entities.join(hit, [id_col, entity_id], "left_anti")
