"""Which detectors and actions apply to which organisation.

A policy row is (policy_id, org_id, name, enabled, patterns, action, deep_scan, route, rag_enabled, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import BUILT_IN, REDACT, STARTER_POLICIES, Catalogue, Starter
from ..functions.spans import PLAN, action_name, rank
from ..plans.sizing import broadcast_if_small


def unit_of(key: Column, catalogue: Catalogue = BUILT_IN) -> Column:
    """Detector key → (unit, label); null for a key the catalogue does not know."""
    known = [
        x
        for key_, unit in catalogue.unit_of.items()
        for x in (F.lit(key_), F.struct(F.lit(unit).alias("unit"), F.lit(catalogue.units[unit].label).alias("label")))
    ]
    none = F.expr("cast(map() as map<string,struct<unit:string,label:string>>)")
    return F.try_element_at(F.create_map(*known) if known else none, key)


def action_col(action: Column) -> Column:
    """Normalised action: block, flag, and redact for anything else."""
    return action_name(rank(action))


def policy_detectors(policies: DataFrame, catalogue: Catalogue = BUILT_IN) -> DataFrame:
    """One row per enabled policy and known detector key; unknown keys drop out."""
    return (
        policies.filter("enabled")
        .select("org_id", "policy_id", "created_at", "action", F.posexplode("patterns").alias("pos", "pattern"))
        .withColumn("known", unit_of(F.col("pattern"), catalogue))
        .filter(F.col("known").isNotNull())
        .select("*", "known.unit", "known.label")
        .drop("known")
        .withColumn("rank", rank(F.col("action")))
    )


def org_plans(policies: DataFrame, force_redact: bool = False, catalogue: Catalogue = BUILT_IN) -> DataFrame:
    """(org_id, plan): per organisation the strongest rank and first position of every unit asked for.

    The first aggregate leaves at most one row per organisation and unit, so however many policies an organisation
    has, what is collected is bounded by the catalogue.
    """
    per_unit = (
        policy_detectors(policies, catalogue)
        .groupBy("org_id", "unit")
        .agg(
            F.min(F.struct("created_at", "policy_id", "pos")).alias("first"),
            F.max(F.lit(REDACT) if force_redact else F.col("rank")).alias("rank"),
        )
    )
    return per_unit.groupBy("org_id").agg(_plan_of(F.collect_list(F.struct("first", "unit", "rank"))).alias("plan"))


def _plan_of(units: Column) -> Column:
    """PLAN of the (first, unit, rank) of an organisation."""
    return F.map_from_entries(
        F.transform(
            F.array_sort(units),
            lambda x, i: F.struct(
                x["unit"].alias("key"),
                F.struct(x["rank"].alias("rank"), i.cast("int").alias("ord")).alias("value"),
            ),
        )
    ).cast(PLAN)


def org_states(policies: DataFrame, orgs: DataFrame, catalogue: Catalogue = BUILT_IN) -> DataFrame:
    """(org_id, zero_retention, plan, route, deep_scan, rag_enabled) for every organisation, with the policies read once.

    As in `org_plans` the first aggregate leaves one row per organisation and unit; policies that name no known detector
    still count for the switches.
    """
    per_unit = (
        policies.filter("enabled")
        .select("*", F.posexplode_outer("patterns").alias("pos", "pattern"))
        .withColumn("unit", unit_of(F.col("pattern"), catalogue)["unit"])
        .groupBy("org_id", "unit")
        .agg(
            F.min(F.struct("created_at", "policy_id", "pos")).alias("first"),
            F.max(rank(F.col("action"))).alias("rank"),
            F.bool_or(F.col("route") == "selfhosted").alias("selfhosted"),
            F.bool_or("deep_scan").alias("deep_scan"),
            F.bool_or("rag_enabled").alias("rag_enabled"),
        )
    )
    states = per_unit.groupBy("org_id").agg(
        F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("first", "unit", "rank"))).alias("units"),
        *[F.bool_or(c).alias(c) for c in ("selfhosted", "deep_scan", "rag_enabled")],
    )
    return orgs.select("org_id", "zero_retention").join(states, "org_id", "left").select(
        "org_id",
        "zero_retention",
        F.when(F.size("units") > 0, _plan_of(F.col("units"))).alias("plan"),
        F.when(F.col("selfhosted"), "selfhosted").otherwise("cloud").alias("route"),
        F.coalesce("deep_scan", F.lit(False)).alias("deep_scan"),
        F.coalesce("rag_enabled", F.lit(False)).alias("rag_enabled"),
    )


def policy_entries(policies: DataFrame, catalogue: Catalogue = BUILT_IN) -> DataFrame:
    """(org_id, entries): the policy list itself as ordered (unit, label, rank), duplicates kept."""
    return (
        policy_detectors(policies, catalogue)
        .groupBy("org_id")
        .agg(F.array_sort(F.collect_list(F.struct("created_at", "policy_id", "pos", "unit", "label", "rank"))).alias("e"))
        .select("org_id", F.transform("e", lambda x: F.struct(x["unit"].alias("unit"), x["label"].alias("label"), x["rank"].alias("rank"))).alias("entries"))
    )


def with_plan(
    df: DataFrame, policies: DataFrame, org_col: str = "org_id", force_redact: bool = False, catalogue: Catalogue = BUILT_IN
) -> DataFrame:
    """`df` with its organisation's plan; null where nothing is enabled."""
    plans = org_plans(policies, force_redact, catalogue).withColumnRenamed("org_id", org_col)
    return df.join(broadcast_if_small(plans), org_col, "left")


def resolve_policies(policies: DataFrame, orgs: DataFrame) -> DataFrame:
    """Per organisation the route, the deep-scan and retrieval switches, and the enabled policies in order."""
    resolved = (
        policies.filter("enabled")
        .groupBy("org_id")
        .agg(
            F.bool_or(F.col("route") == "selfhosted").alias("selfhosted"),
            F.bool_or("deep_scan").alias("deep_scan"),
            F.bool_or("rag_enabled").alias("rag_enabled"),
            F.array_sort(
                F.collect_list(
                    F.struct("created_at", "policy_id", "name", "patterns", action_col(F.col("action")).alias("action"))
                )
            ).alias("policies"),
        )
    )
    none = F.expr("cast(array() as array<struct<name:string,patterns:array<string>,action:string>>)")
    return orgs.select("org_id").join(resolved, "org_id", "left").select(
        "org_id",
        F.when(F.col("selfhosted"), "selfhosted").otherwise("cloud").alias("route"),
        F.coalesce("deep_scan", F.lit(False)).alias("deep_scan"),
        F.coalesce("rag_enabled", F.lit(False)).alias("rag_enabled"),
        F.coalesce(
            F.transform("policies", lambda p: F.struct(p["name"].alias("name"), p["patterns"].alias("patterns"), p["action"].alias("action"))),
            none,
        ).alias("policies"),
    )


def effective_policy(policies: DataFrame, orgs: DataFrame) -> DataFrame:
    """Per organisation what a client should enforce: all pattern keys, the strongest mode, and whether any.

    Here an unknown action counts as flag, the mode of no policies is redact, and unknown keys are passed on.
    """
    enabled = policies.filter("enabled")
    strength = F.when(F.col("action") == "block", 3).when(F.col("action") == "redact", 2).otherwise(1)
    mode = enabled.groupBy("org_id").agg(F.max(strength).alias("best"))
    keys = (
        enabled.select("org_id", F.explode("patterns").alias("pattern"))
        .groupBy("org_id")
        .agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    )
    return (
        orgs.select("org_id")
        .join(mode, "org_id", "left")
        .join(keys, "org_id", "left")
        .select(
            "org_id",
            F.coalesce("patterns", F.expr("cast(array() as array<string>)")).alias("patterns"),
            F.when(F.col("best") == 3, "block").when(F.col("best") == 1, "flag").otherwise("redact").alias("mode"),
            F.col("patterns").isNotNull().alias("enabled"),
        )
    )


def list_policies(policies: DataFrame, org: object | None = None) -> DataFrame:
    rows = policies if org is None else policies.filter(F.col("org_id") == F.lit(org))
    keys = ["created_at", "policy_id"] if org is not None else ["org_id", "created_at", "policy_id"]
    return rows.orderBy(*keys)


def outbound_orgs(policies: DataFrame, orgs: DataFrame | None = None) -> DataFrame:
    """(org_id, has_outbound): does an enabled redact policy list any pattern?"""
    asks = (rank(F.col("action")) == REDACT) & F.col("enabled") & (F.size("patterns") > 0)
    flags = policies.groupBy("org_id").agg(F.bool_or(asks).alias("has_outbound"))
    if orgs is None:
        return flags
    return orgs.select("org_id").join(flags, "org_id", "left").withColumn("has_outbound", F.coalesce("has_outbound", F.lit(False)))


def seed_policies(orgs: DataFrame, policies: tuple[Starter, ...] = STARTER_POLICIES) -> DataFrame:
    """The policies organisations start with: one row per organisation and starter."""
    starters = F.array(
        *[
            F.struct(
                F.lit(i).alias("seq"),
                F.lit(s.name).alias("name"),
                F.lit(s.description).alias("description"),
                F.array(*[F.lit(p) for p in s.patterns]).alias("patterns"),
            )
            for i, s in enumerate(policies)
        ]
    )
    return orgs.select("org_id", F.explode(starters).alias("s")).select(
        "org_id",
        "s.*",
        F.lit(True).alias("enabled"),
        F.lit("redact").alias("action"),
        F.lit("cloud").alias("route"),
    )


def with_adoption(catalog: DataFrame, policies: DataFrame) -> DataFrame:
    """A catalogue with the number of organisations that have each detector key switched on."""
    adopted = (
        policies.filter("enabled")
        .select("org_id", F.explode("patterns").alias("pattern"))
        .distinct()
        .groupBy("pattern")
        .agg(F.count("*").alias("orgs_enabled"))
    )
    return catalog.join(adopted, "pattern", "left").withColumn("orgs_enabled", F.coalesce("orgs_enabled", F.lit(0)).cast("bigint"))
