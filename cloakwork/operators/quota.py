"""Daily request quotas per organisation, in fixed UTC days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.catalog import PLAN_LIMITS
from ..functions.scalars import next_utc_midnight
from ..plans.sizing import broadcast_if_small

#: Seconds per slot of the two-step ranking.
SLOT_SECONDS = 60


def plan_limit(plan: Column) -> Column:
    """Requests per day a plan allows; null is unlimited."""
    limit = F.lit(None).cast("bigint")
    for name, n in PLAN_LIMITS.items():
        limit = F.when(plan == name, F.lit(n).cast("bigint")).otherwise(limit)
    return limit


def rank_within_day(requests: DataFrame, ts_col: str = "created_at", id_col: str = "log_id", slot: int = SLOT_SECONDS) -> DataFrame:
    """Adds `day` and `n`, the 1-based order of a request within its organisation and UTC day.

    Ranking a whole (organisation, day) would put a busy organisation's day into one task. Here rows are ranked
    within short slots, which spread over the cluster, and each slot adds the number of requests in the slots before
    it; that prefix sum runs over counts only, at most 86400 / slot of them per organisation and day. Rows without
    organisation or time keep their place, among themselves.
    """
    rows = requests.withColumn("day", F.to_date(ts_col)).withColumn("_slot", F.floor(F.unix_seconds(ts_col) / slot))
    keys = ["org_id", "day", "_slot"]
    before = Window.partitionBy("org_id", "day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_c"))
    offsets = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys).orderBy(ts_col, id_col)
    ranked = rows.withColumn("_in_slot", F.row_number().over(within))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]  # rows without time or organisation are ranked as well
    joined = ranked.join(offsets, same, "left").withColumn("n", F.col("_in_slot") + F.col("_before"))
    return joined.drop("_slot", "_in_slot", "_before", *[f"_{k}" for k in keys])


def decided(ranked: DataFrame) -> DataFrame:
    """Adds `limit`, `admitted` and `used` to rows with day, `n` and `plan`. What has no organisation or time is rejected."""
    limited = ranked.withColumn("limit", plan_limit(F.col("plan")))
    known = F.col("org_id").isNotNull() & F.col("day").isNotNull()
    allowed = known & (F.col("limit").isNull() | (F.col("n") <= F.col("limit")))
    return limited.withColumn("admitted", allowed).withColumn("used", F.when(known, F.least("n", "limit")))


def quota_decisions(requests: DataFrame, orgs: DataFrame, ts_col: str = "created_at", id_col: str = "log_id") -> DataFrame:
    """Each request with `admitted` and `used`, the counter after it.

    The first `limit` requests of an organisation and day pass, whatever becomes of them later; a rejected request
    gives its place back, so the counter stays at the limit. A request without organisation or time is rejected.
    """
    plans = broadcast_if_small(orgs.select("org_id", "plan"))
    return decided(rank_within_day(requests, ts_col, id_col).join(plans, "org_id", "left"))


def quota_used(requests: DataFrame, orgs: DataFrame, ts_col: str = "created_at") -> DataFrame:
    """The counter at the end of each organisation and UTC day."""
    counts = requests.groupBy("org_id", F.to_date(ts_col).alias("day")).agg(F.count("*").alias("requests"))
    plans = broadcast_if_small(orgs.select("org_id", "plan"))
    return counts.join(plans, "org_id", "left").select(
        "org_id", "day", "requests", F.least("requests", plan_limit(F.col("plan"))).alias("used")
    )


def quota_status(requests: DataFrame, orgs: DataFrame, as_of: str, ts_col: str = "created_at") -> DataFrame:
    """Plan, limit, used, remaining and reset time of every organisation at `as_of`."""
    now = F.lit(as_of).cast("timestamp")
    today = requests.filter((F.col(ts_col) >= F.date_trunc("day", now)) & (F.col(ts_col) <= now))
    counts = today.groupBy("org_id").agg(F.count("*").alias("_n"))
    limit = plan_limit(F.col("plan"))
    used = F.least(F.coalesce("_n", F.lit(0).cast("bigint")), limit)
    return orgs.join(counts, "org_id", "left").select(
        "org_id",
        "plan",
        limit.alias("limit"),
        used.alias("used"),
        F.greatest(limit - used, F.lit(0).cast("bigint")).alias("remaining"),
        next_utc_midnight(now).cast("bigint").alias("resets_at"),
    )
