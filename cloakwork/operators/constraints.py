"""Table rules as reports of the rows that break them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import broadcast_if_small

#: Allowed values per column (fixed values of the data model).
ALLOWED = {
    "plan": ("free", "team", "enterprise"),
    "role": ("Admin", "Manager", "User"),
    "user_status": ("active", "inactive", "invited"),
    "action": ("redact", "block", "flag"),
    "route": ("cloud", "selfhosted"),
    "severity": ("low", "medium", "high", "critical"),
    "alert_status": ("open", "investigating", "resolved"),
    "message_role": ("user", "assistant", "system"),
    "outcome": ("redact", "block", "flag"),
    "scope": ("org", "personal"),
}
#: Length of a stored embedding.
EMBEDDING_DIM = 1536


class Check(NamedTuple):
    """A predicate every row must fulfil; null counts as fulfilled, as in SQL."""

    name: str
    holds: Column


class NotNull(NamedTuple):
    name: str
    columns: tuple[str, ...]


class Unique(NamedTuple):
    """No two rows with equal columns, among the rows of `where`; nulls never collide."""

    name: str
    columns: tuple[str, ...]
    where: Column | None = None


class Foreign(NamedTuple):
    """Every non-null value has a row in `parent`."""

    name: str
    column: str
    parent: DataFrame
    parent_column: str


Rule = Check | NotNull | Unique | Foreign


def one_of(name: str, column: str, values: tuple[str, ...]) -> Check:
    return Check(name, F.col(column).isin(*values))


def vector_length(column: str = "embedding", dim: int = EMBEDDING_DIM) -> Check:
    return Check(f"{column}_dim", F.col(column).isNull() | (F.size(column) == dim))


def violations(df: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """(rule, id): one row per broken rule and row. `violation_changes` tells what a change set does to this report.

    All row-local rules share one pass. A uniqueness rule finds the repeated values first, by counts, and only those
    meet the rows again.
    """
    ident = F.col(id_col).cast("string").alias("id")
    local: list[Column] = []
    parts: list[DataFrame] = []
    for r in rules:
        if isinstance(r, Check):
            local.append(F.when(~r.holds, F.lit(r.name)))
        elif isinstance(r, NotNull):
            local.append(F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in r.columns]), F.lit(r.name)))
        elif isinstance(r, Unique):
            rows = (df if r.where is None else df.filter(r.where)).dropna(subset=list(r.columns)).select(ident.alias("_id"), *r.columns)
            repeated = rows.groupBy(*r.columns).count().filter("count > 1").drop("count")
            parts.append(rows.join(repeated, list(r.columns), "left_semi").select(F.lit(r.name).alias("rule"), F.col("_id").alias("id")))
        else:
            known = r.parent.select(F.col(r.parent_column).alias("_k"))
            rows = df.filter(F.col(r.column).isNotNull()).select(ident, F.col(r.column).alias("_k"))
            parts.append(rows.join(known, "_k", "left_anti").select(F.lit(r.name).alias("rule"), "id"))
    if local:
        broken = df.select(ident, F.explode(F.array_compact(F.array(*local))).alias("rule")).select("rule", "id")
        parts.insert(0, broken)
    return reduce(DataFrame.unionByName, parts)


class Changed(NamedTuple):
    """What a change set makes of a table: `before` is the table as it was, `ids` the changed ids, `old` and `new` the rows
    with those ids before and after."""

    before: DataFrame
    id_col: str
    ids: DataFrame
    old: DataFrame
    new: DataFrame

    @property
    def after(self) -> DataFrame:
        return self.unchanged(self.before).unionByName(self.new)

    def unchanged(self, rows: DataFrame) -> DataFrame:
        return rows.join(broadcast_if_small(self.ids), self.id_col, "left_anti")


def changed(before: DataFrame, id_col: str, upserts: DataFrame, deletes: DataFrame) -> Changed:
    """The change set of whole rows that come or take a row's place (`upserts`) and of ids that go (`deletes`).

    Ids are unique and not null in the table and in the change set; an id in both goes and comes again.
    """
    ids = upserts.select(id_col).unionByName(deletes.select(id_col)).distinct()
    old = before.join(broadcast_if_small(ids), id_col, "left_semi").select(before.columns)
    return Changed(before, id_col, ids, old, upserts.select(before.columns))


def violation_changes(table: Changed, rules: list[Rule], parents: dict[str, Changed] | None = None) -> DataFrame:
    """(rule, id, change): the violations that a change set brings (1) and ends (-1), so that the report of the whole
    table after it is the report before it, plus these rows.

    Row-local rules look at changed rows alone. A uniqueness rule looks at the rows that share a value with a changed row.
    A foreign key looks up the values of changed rows, and the rows whose value a changed parent has: `parents` holds the
    change sets of parent tables by rule name, and a rule without one takes its parent as unchanged. The table itself is
    scanned for two narrow columns only; the values looked for are few, so the scan is filtered by a broadcast, or by the
    Bloom filter that Spark makes of them when both sides are big, before anything is shuffled.
    """
    ident = F.col(table.id_col).cast("string").alias("id")
    parts: list[DataFrame] = []

    def put(rows: DataFrame, rule: str, sign: int) -> None:
        parts.append(rows.select(F.lit(rule).alias("rule"), "id", F.lit(sign).alias("change")))

    local = [r for r in rules if isinstance(r, (Check, NotNull))]
    if local:
        for rows, sign in ((table.new, 1), (table.old, -1)):
            parts.append(violations(rows, table.id_col, local).withColumn("change", F.lit(sign)))
    for r in rules:
        if isinstance(r, Unique):
            columns = list(r.columns)

            def valued(rows: DataFrame, rule: Unique = r) -> DataFrame:
                kept = rows if rule.where is None else rows.filter(rule.where)
                return kept.dropna(subset=list(rule.columns)).select(table.id_col, *[c for c in rule.columns if c != table.id_col])

            values = valued(table.old).unionByName(valued(table.new)).select(*columns).distinct()
            was = valued(table.before).join(broadcast_if_small(values), columns, "left_semi")
            now = table.unchanged(was).unionByName(valued(table.new))
            for rows, sign in ((now, 1), (was, -1)):
                repeated = rows.groupBy(*columns).count().filter("count > 1").drop("count")
                put(rows.join(repeated, columns, "left_semi").select(ident), r.name, sign)
        elif isinstance(r, Foreign):
            parent = (parents or {}).get(r.name)

            def pointing(rows: DataFrame, rule: Foreign = r) -> DataFrame:
                return rows.filter(F.col(rule.column).isNotNull()).select(ident, F.col(rule.column).alias("_k"), F.col(table.id_col).alias("_id"))

            def orphans(rows: DataFrame, known: DataFrame, rule: Foreign = r) -> DataFrame:
                keys = known.select(F.col(rule.parent_column).alias("_k"))
                # of the parent, only the values asked for
                asked = keys.join(broadcast_if_small(rows.select("_k").distinct()), "_k", "left_semi")
                return rows.join(asked, "_k", "left_anti")

            put(orphans(pointing(table.new), parent.after if parent else r.parent), r.name, 1)
            put(orphans(pointing(table.old), parent.before if parent else r.parent), r.name, -1)
            if parent:  # children that stay as they are, of parents that come and go
                moved = parent.old.unionByName(parent.new).select(F.col(r.parent_column).alias("_k")).distinct()
                stay = pointing(table.before).join(broadcast_if_small(moved), "_k", "left_semi")
                stay = stay.join(broadcast_if_small(table.ids.select(F.col(table.id_col).alias("_id"))), "_id", "left_anti")
                put(orphans(stay, parent.after), r.name, 1)
                put(orphans(stay, parent.before), r.name, -1)
    both = reduce(DataFrame.unionByName, parts).groupBy("rule", "id").agg(F.sum("change").alias("change"))
    return both.filter("change <> 0")


def schema_rules(name: str, tables: dict[str, DataFrame], dim: int = EMBEDDING_DIM) -> list[Rule]:
    """The rules of one table of the data model; `tables` holds the tables that its foreign keys point to."""

    def belongs(column: str, parent: str) -> Foreign:
        return Foreign(f"{name}.{column}", column, tables[parent], column)

    def listed(column: str, values: str) -> Check:
        return one_of(f"{name}.{column}", column, ALLOWED[values])

    def once(*columns: str, where: Column | None = None) -> Unique:
        return Unique(f"{name}({','.join(columns)})", columns, where)

    rules: dict[str, Callable[[], list[Rule]]] = {
        "orgs": lambda: [NotNull("orgs.name", ("name",)), listed("plan", "plan")],
        "teams": lambda: [once("org_id", "name"), belongs("org_id", "orgs")],
        "users": lambda: [listed("role", "role"), listed("status", "user_status"), once("org_id", "email"), belongs("org_id", "orgs"), belongs("team_id", "teams")],
        "api_keys": lambda: [listed("scope", "scope"), once("key_hash"), belongs("org_id", "orgs"), belongs("user_id", "users")],
        "policies": lambda: [listed("action", "action"), listed("route", "route"), belongs("org_id", "orgs")],
        "usage_logs": lambda: [listed("route", "route"), belongs("org_id", "orgs"), belongs("user_id", "users")],
        "risk_alerts": lambda: [listed("severity", "severity"), listed("status", "alert_status"), belongs("org_id", "orgs"), belongs("team_id", "teams")],
        "activity": lambda: [NotNull("activity.actor", ("actor",)), belongs("org_id", "orgs")],
        "conversations": lambda: [belongs("org_id", "orgs"), belongs("user_id", "users")],
        "messages": lambda: [listed("role", "message_role"), belongs("conv_id", "conversations")],
        "integrations": lambda: [once("org_id", "slug"), belongs("org_id", "orgs")],
        "rag_documents": lambda: [NotNull("rag_documents.title", ("title",)), belongs("org_id", "orgs")],
        "rag_chunks": lambda: [vector_length(dim=dim), belongs("document_id", "rag_documents")],
        "shadow_events": lambda: [listed("outcome", "outcome"), belongs("org_id", "orgs")],
        "invites": lambda: [once("user_id", where=F.col("accepted_at").isNull()), belongs("user_id", "users")],
    }
    return rules[name]()
