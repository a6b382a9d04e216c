"""Change-feeds: (current table, changes) → next table.

Changes to one key are reduced by aggregates, which combine on the map side, so a key with very many changes is no
hot spot. The next table is a new DataFrame; writing it is up to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import INTEGRATIONS
from ..functions.scalars import is_web_url, trim_space
from ..plans.sizing import broadcast_if_small
from .scan import redact_at_rest


def _order(cols: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def upsert_latest(
    current: DataFrame, changes: DataFrame, keys: list[str], order: list[str], owner: list[str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Insert by key or overwrite, the latest change winning.

    An existing row is overwritten only by changes of its owner. A new key belongs to the owner of its first change.
    Columns in `keep` hold their first value.

    Changes are read once: reduced per (key, owner) first, and those few rows then to one per key.
    """
    payload = [c for c in current.columns if c not in keys and c not in owner]
    row, who = F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(c) for c in owner])
    per_owner = changes.groupBy(*keys, *owner).agg(
        F.max_by(row, _order(order)).alias("_last"), F.min_by(row, _order(order)).alias("_first"), F.min(_order(order)).alias("_since")
    )
    holders = current.select(*keys, who.alias("_holder"))
    per_key = (
        per_owner.join(holders, keys, "left")
        .groupBy(*keys)
        .agg(
            F.min_by(F.struct(who.alias("owner"), F.col("_first").alias("first"), F.col("_last").alias("last")), "_since").alias("_new"),
            F.max_by("_last", F.when(who == F.col("_holder"), 1)).alias("_mine"),  # null when only strangers wrote
        )
    )
    merged = current.select(*keys, who.alias("_own"), row.alias("_old")).join(per_key, keys, "full")
    known = F.col("_old").isNotNull()
    owners = [F.when(known, F.col(f"_own.{c}")).otherwise(F.col(f"_new.owner.{c}")).alias(c) for c in owner]
    base = F.when(known, F.col("_old")).otherwise(F.col("_new.first"))
    now = F.when(known, F.coalesce("_mine", "_old")).otherwise(F.col("_new.last"))
    rest = [(base if c in keep else now)[c].alias(c) for c in payload]
    return merged.select(*keys, *owners, *rest).select(*current.columns)


def conversation_titles(changes: DataFrame, orgs: DataFrame, policies: DataFrame) -> DataFrame:
    """Titles as stored: generic for zero-retention organisations, else redacted, 'New chat' when blank."""
    redacted = redact_at_rest(changes, "title", "org_id", policies)
    flags = broadcast_if_small(orgs.select("org_id", F.col("zero_retention").alias("_zero")))
    title = F.when(F.coalesce("_zero", F.lit(False)), "Conversation").when(trim_space(F.col("title")) == "", "New chat").otherwise(F.col("title"))
    return redacted.join(flags, "org_id", "left").withColumn("title", title).drop("_zero")


def insert_if_absent(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Append changes with new keys; an existing key wins, and the first of several changes."""
    rest = [c for c in current.columns if c not in keys]
    first = changes.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), _order(order)).alias("_r"))
    fresh = first.join(current.select(*keys), keys, "left_anti").select(*keys, "_r.*")
    return current.unionByName(fresh.select(*current.columns))


def patch_rows(current: DataFrame, patches: DataFrame, keys: list[str], order: list[str], stamp_col: str | None = None) -> DataFrame:
    """Replace fields a patch names, in order; null leaves a field as it is. `stamp_col` takes the last patch time."""
    fields = [c for c in patches.columns if c in current.columns and c not in keys and c != stamp_col]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), _order(order))).alias(f"_p_{c}") for c in fields]
    if stamp_col:
        last.append(F.max(order[0]).alias("_stamp"))
    merged = current.join(patches.groupBy(*keys).agg(*last), keys, "left")
    for c in fields:
        merged = merged.withColumn(c, F.coalesce(f"_p_{c}", c))
    if stamp_col:
        merged = merged.withColumn(stamp_col, F.coalesce("_stamp", stamp_col))
    return merged.select(*current.columns)


def merge_json_config(current: DataFrame, patches: DataFrame, order: list[str], field: str = "url") -> DataFrame:
    """Set one key of the JSON `config` per (org_id, slug) and mark it installed; other keys keep their values.

    Only web addresses are taken, trimmed, and only for integrations that have one. A pair that was not there is added.
    """
    configurable = [i.slug for i in INTEGRATIONS if i.configurable]
    good = patches.withColumn("_v", trim_space(F.col(field))).filter(is_web_url(F.col("_v")) & F.col("slug").isin(*configurable))
    last = good.groupBy("org_id", "slug").agg(F.max_by("_v", _order(order)).alias("_v"))
    both = current.join(last, ["org_id", "slug"], "full")
    # values stay variants, so numbers, lists and nested objects survive unchanged
    config = F.coalesce(F.from_json("config", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    others = F.map_filter(config, lambda k, _: k != field)
    value = F.parse_json(F.to_json(F.struct(F.col("_v").alias("v"))))
    merged = F.to_json(F.map_concat(others, F.create_map(F.lit(field), F.variant_get(value, "$.v", "variant"))))
    return both.select(
        "org_id",
        "slug",
        F.when(F.col("_v").isNotNull(), True).otherwise(F.col("installed")).alias("installed"),
        F.when(F.col("_v").isNotNull(), merged).otherwise(F.col("config")).alias("config"),
    )


def set_installed(current: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Install or uninstall per (org_id, slug), the latest change winning.

    Installing adds a missing pair with an empty config; uninstalling one that was never there leaves nothing. Slugs
    outside the catalogue are refused.
    """
    known = changes.filter(F.col("slug").isin(*[i.slug for i in INTEGRATIONS]))
    last = known.groupBy("org_id", "slug").agg(
        F.max_by("installed", _order(order)).alias("_on"), F.bool_or("installed").alias("_ever")
    )
    both = current.join(last, ["org_id", "slug"], "full").filter(F.col("installed").isNotNull() | F.col("_ever"))
    return both.select(
        "org_id", "slug", F.coalesce("_on", "installed").alias("installed"), F.coalesce("config", F.lit("{}")).alias("config")
    )


def cascade_delete(parent: DataFrame, child: DataFrame, fk: str, ids: DataFrame, also: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parents not in `ids`, and the children of the rest. `also` names owner columns a deletion must match."""
    on = [fk, *(also or [])]
    gone = parent.join(ids.select(*on).distinct(), on, "left_semi").select(fk)
    return parent.join(gone, fk, "left_anti"), child.join(gone, fk, "left_anti")


def detach_children(child: DataFrame, fk: str, ids: DataFrame) -> DataFrame:
    """Children keep living with the deleted reference set to null."""
    gone = broadcast_if_small(ids.select(fk).distinct().withColumn("_gone", F.lit(True)))
    return child.join(gone, fk, "left").withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).drop("_gone").select(*child.columns)


def replace_pending(invites: DataFrame, issued: DataFrame, ttl_days: int = 7) -> DataFrame:
    """Invites after new ones were issued: accepted ones stay, and each user has one pending, the newest."""
    latest = issued.groupBy("user_id").agg(F.max_by(F.struct("invite_id", "org_id", "issued_at"), F.struct("issued_at", "invite_id")).alias("r"))
    fresh = latest.select("user_id", "r.*").select(
        "invite_id",
        "user_id",
        "org_id",
        "issued_at",
        (F.col("issued_at") + F.make_interval(days=F.lit(ttl_days))).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("accepted_at"),
    )
    pending = F.col("accepted_at").isNull()
    kept = invites.filter(pending).join(issued.select("user_id"), "user_id", "left_anti")
    return invites.filter(~pending).unionByName(kept).unionByName(fresh)


def revoke_keys(keys: DataFrame, revocations: DataFrame) -> DataFrame:
    """Keys with revocations applied: by organisation, or for personal scope by the owner only.

    `revocations` is (key_id, org_id, user_id, personal).
    """
    r = revocations.select(
        "key_id", F.col("org_id").alias("_org"), F.col("user_id").alias("_user"), F.col("personal").alias("_personal")
    )
    own = F.col("_personal") & (F.col("scope") == "personal") & (F.col("user_id") == F.col("_user"))
    org = ~F.col("_personal") & (F.col("org_id") == F.col("_org"))
    hit = keys.join(r, "key_id").filter(own | org).select("key_id").distinct().withColumn("_hit", F.lit(True))
    return keys.join(hit, "key_id", "left").withColumn("revoked", F.col("revoked") | F.coalesce("_hit", F.lit(False))).drop("_hit")


#: Title of a conversation that a message opens.
OPENED_TITLE = "New Chat"
#: Roles a stored message may have.
MESSAGE_ROLES = ("user", "assistant", "system")


def accept_messages(
    incoming: DataFrame, messages: DataFrame, conversations: DataFrame, orgs: DataFrame, policies: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(messages, conversations) after a batch of incoming messages.

    `incoming` is (message_id, conv_id, org_id, user_id, role, content, at). Unknown roles are refused and
    zero-retention organisations store nothing. A missing conversation is created for its first sender; messages to
    somebody else's are refused. Content is redacted whatever the policy's action; a known message id changes
    nothing; the conversation's updated_at moves to its latest accepted message.
    """
    zero = broadcast_if_small(orgs.select("org_id", F.col("zero_retention").alias("_zero")))
    allowed = (
        incoming.filter(F.col("role").isin(*MESSAGE_ROLES))
        .join(zero, "org_id", "left")
        .filter(~F.coalesce("_zero", F.lit(False)))
        .drop("_zero")
    )
    openings = allowed.select(
        "conv_id", "org_id", "user_id", F.lit(OPENED_TITLE).alias("title"), F.col("at").alias("updated_at"), "message_id"
    )
    opened = insert_if_absent(conversations, openings, ["conv_id"], ["updated_at", "message_id"])
    owned = allowed.join(opened.select("conv_id", "org_id", "user_id"), ["conv_id", "org_id", "user_id"], "left_semi")
    # only ids that are new get scanned; the text of one id is the one that came first
    fresh = owned.groupBy("message_id").agg(
        F.min(F.struct("at", "conv_id", "org_id", "role", "content")).alias("r")
    ).join(messages.select("message_id"), "message_id", "left_anti").select("message_id", "r.*")
    stored = redact_at_rest(fresh, "content", "org_id", policies)
    touched = owned.groupBy("conv_id").agg(F.max("at").alias("_at"))
    moved = opened.join(touched, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")
    return messages.unionByName(stored.select(*messages.columns)), moved

