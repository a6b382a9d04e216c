"""People, teams, keys, invites and integrations of organisations: the small relational reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import DELIVERABLE_SLUGS
from ..functions.scalars import trim_space
from ..plans.sizing import broadcast_if_small
from ..sources.catalogs import integration_rows


def integrations(orgs: DataFrame, state: DataFrame) -> DataFrame:
    """Every catalogue entry per organisation with its state; never touched means not installed and no URL."""
    listed = orgs.select("org_id", F.explode(integration_rows()).alias("i")).select("org_id", "i.*")
    current = state.select("org_id", "slug", "installed", F.get_json_object("config", "$.url").alias("webhook_url"))
    return listed.join(current, ["org_id", "slug"], "left").withColumn("installed", F.coalesce("installed", F.lit(False)))


def delivery_targets(state: DataFrame) -> DataFrame:
    """(org_id, slug, url) alerts can be sent to: installed, deliverable, and with a URL."""
    url = F.coalesce(F.get_json_object("config", "$.url"), F.lit(""))
    return (
        state.filter(F.col("installed") & F.col("slug").isin(*DELIVERABLE_SLUGS) & (url != "")).select("org_id", "slug", url.alias("url"))
    )


def users_with_team(users: DataFrame, teams: DataFrame) -> DataFrame:
    names = broadcast_if_small(teams.select("team_id", F.col("name").alias("team")))
    return users.join(names, "team_id", "left").withColumn("team", F.coalesce("team", F.lit("")))


def team_member_counts(teams: DataFrame, users: DataFrame) -> DataFrame:
    """Members per team, empty teams included; users are counted before the join."""
    counts = users.filter("team_id is not null").groupBy("team_id").agg(F.count("*").alias("member_count"))
    return teams.join(counts, "team_id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0).cast("bigint")))


def orgs_with_admin(users: DataFrame, orgs: DataFrame) -> DataFrame:
    """Organisations that have an administrator."""
    return orgs.join(users.filter("role = 'Admin'").select("org_id"), "org_id", "left_semi")


def _key_columns(keys: DataFrame) -> DataFrame:
    shown = [c for c in ("key_id", "org_id", "user_id", "name", "prefix") if c in keys.columns]
    return keys.select(
        *shown,
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"),
        F.date_format("last_used", "yyyy-MM-dd HH:mm").alias("last_used"),
        "revoked",
    )


def org_keys(keys: DataFrame, org: object | None = None) -> DataFrame:
    """All keys of an organisation (or of all), newest first."""
    rows = keys if org is None else keys.filter(F.col("org_id") == F.lit(org))
    return _key_columns(rows.orderBy(F.desc("created_at"), "key_id"))


def personal_keys(keys: DataFrame, user: object | None = None) -> DataFrame:
    """Keys of personal scope of a user (or of all), newest first."""
    rows = keys.filter("scope = 'personal'")
    rows = rows if user is None else rows.filter(F.col("user_id") == F.lit(user))
    return _key_columns(rows.orderBy(F.desc("created_at"), "key_id"))


def org_settings(orgs: DataFrame) -> DataFrame:
    return orgs.select("org_id", F.col("name").alias("org_name"), "plan", "zero_retention", "settings")


def pending_invites(invites: DataFrame, users: DataFrame, orgs: DataFrame, as_of: str) -> DataFrame:
    """Invites neither accepted nor expired at `as_of`, with who is invited and where."""
    live = invites.filter(F.col("accepted_at").isNull() & (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    who = users.select("user_id", F.col("org_id").alias("user_org"), "name", "email", "role")
    return (
        live.select("invite_id", "user_id", "org_id")
        .join(who, "user_id")
        .join(broadcast_if_small(orgs.select("org_id", F.col("name").alias("org_name"))), "org_id")
        .select("invite_id", "user_id", F.col("user_org").alias("org_id"), "name", "email", "role", "org_name")
    )


def team_id_of(org: Column, name: Column) -> Column:
    """The id of a team that is created by its name: 60 bits of a digest, so the same whoever creates it."""
    return F.conv(F.left(F.md5(F.concat_ws(":", org.cast("string"), name)), F.lit(15)), 16, 10).cast("bigint")


def teams_by_name(teams: DataFrame, asked: DataFrame) -> DataFrame:
    """(org_id, name, team_id, fresh) for every team name asked for; `fresh` teams are not there yet and get an id here.

    Names are compared as given; blank ones ask for no team and drop out.
    """
    wanted = asked.select("org_id", "name").filter(trim_space(F.col("name")) != "").distinct()
    found = wanted.join(teams.select("org_id", "name", "team_id"), ["org_id", "name"], "left")
    made = team_id_of(F.col("org_id"), F.col("name"))
    return found.select("org_id", "name", F.coalesce("team_id", made).alias("team_id"), F.col("team_id").isNull().alias("fresh"))


def with_asked_teams(teams: DataFrame, asked: DataFrame) -> DataFrame:
    """The teams after those that were asked for and missing have been created."""
    return teams.select("team_id", "org_id", "name").unionByName(teams_by_name(teams, asked).filter("fresh").select("team_id", "org_id", "name"))
