"""Registered queries: detection, spans, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.catalog import DETECTORS
from ..operators import policies as P
from ..operators import scan as X
from ..sources.catalogs import detector_rows, user_catalogue
from .check_sql import detect_sql, merge_ctes, plan_ctes, redact_ctes, scan_ctes, span_ctes, user_ctes
from .registry import Inputs, register, render
from .session import spread

_REGIONAL = {"passport", "credit_card"} | {d.key for d in DETECTORS[11:]}


def _register_detectors() -> None:
    for d in DETECTORS:
        docs = "regional_docs" if d.key in _REGIONAL else "seeded_docs"

        def build(t: Inputs, key: str = d.key, docs: str = docs):
            found = spread(t(docs)).select("doc_id", "text", F.explode(S.detect(F.col("text"), key)).alias("s"))
            return found.select(
                "doc_id", "s.label", "s.start", "s.end", F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value")
            )

        register(f"detect_{d.key}", detect_sql(docs, "doc_id", "text", d.key), docs)(build)


_register_detectors()

_SCAN = f"with {scan_ctes('seeded_docs', 'doc_id', 'text')} "
_READS = "seeded_docs policies"


def _raw(t: Inputs):
    docs = P.with_plan(spread(t("seeded_docs")), t("policies"))
    return docs.withColumn("raw", S.raw_findings(F.col("text"), F.col("plan")))


@register(
    "collect_findings",
    f'with {plan_ctes()}, {span_ctes("seeded_docs", "doc_id", "text")} '
    'select doc_id, s.label, start, end_ as "end", cast(rank as bigint) as rank from spans s join seeded_docs using (doc_id) join entries e using (org_id, label)',
    _READS,
)
def collect_findings(t: Inputs):
    docs = spread(t("seeded_docs")).join(P.broadcast_if_small(P.policy_entries(t("policies"))), "org_id")
    return docs.select("doc_id", F.explode(S.collect_findings(F.col("text"), F.col("entries"))).alias("f")).select("doc_id", "f.*")


@register("block_flag", _SCAN + "select doc_id, blocked from scanned", _READS)
def block_flag(t: Inputs):
    return _raw(t).select("doc_id", S.blocked(F.col("raw")).alias("blocked"))


@register("coalesce_spans", _SCAN + "select doc_id, findings from scanned", _READS)
def coalesce_spans(t: Inputs):
    return _raw(t).select("doc_id", render(S.coalesce_spans(F.col("raw"))).alias("findings"))


def _raw_rows(t: Inputs):
    return X.span_rows(_raw(t), "doc_id", "raw").withColumn("end", -F.col("neg_end")).drop("neg_end")


@register(
    "coalesce_rows",
    _SCAN + 'select doc_id, label, start, end_ as "end", cast(rank as bigint) as rank from merged',
    _READS,
)
def coalesce_rows(t: Inputs):
    return X.coalesce_rows(_raw_rows(t), "doc_id")


@register(
    "running_max_end",
    _SCAN + 'select doc_id, label, start, end_ as "end", cast(prev as bigint) as max_end_before from merged_m',
    _READS,
)
def running_max_end(t: Inputs):
    return X.running_max_end(_raw_rows(t), "doc_id").select("doc_id", "label", "start", "end", "max_end_before")


@register(
    "sort_with_ties",
    _SCAN.rstrip() + ", s as (select doc_id, string_agg(label || ':' || start || ':' || end_, ';' order by start, end_ desc, ord) as in_order from raw group by doc_id) "
    "select doc_id, coalesce(in_order, '') as in_order from seeded_docs left join s using (doc_id)",
    _READS,
)
def sort_with_ties(t: Inputs):
    in_order = F.transform(
        F.array_sort("raw"), lambda r: F.concat_ws(":", r["label"], r["start"].cast("string"), (-r["neg_end"]).cast("string"))
    )
    return _raw(t).select("doc_id", F.array_join(in_order, ";").alias("in_order"))


@register(
    "stronger_action",
    f"with {plan_ctes('tenant_policies')} select org_id, label, cast(rank as bigint) as rank from plan",
    "tenant_policies",
)
def stronger_action(t: Inputs):
    asked = P.policy_detectors(t("tenant_policies"))
    flags, rest = asked.filter("rank = 1"), asked.filter("rank > 1")
    sides = [x.groupBy("org_id", "label").agg(F.max("rank").alias(n)) for x, n in ((flags, "r"), (rest, "s"))]
    both = sides[0].join(sides[1], ["org_id", "label"], "full")
    return both.select("org_id", "label", S.stronger(F.col("r"), F.col("s")).alias("rank"))


_NEXT = (
    "select doc_id, start, end_ as \"end\", n_start < end_ and start < n_end as overlaps_next from ("
    "select doc_id, start, end_, lead(start) over w as n_start, lead(end_) over w as n_end from raw "
    "window w as (partition by doc_id order by start, end_ desc, ord)) where n_start is not null"
)


@register("spans_overlap", _SCAN + _NEXT, _READS)
def spans_overlap(t: Inputs):
    def pair(r, nxt):
        return F.struct(
            r["start"].alias("start"),
            (-r["neg_end"]).alias("end"),
            S.overlaps(r["start"], -r["neg_end"], nxt["start"], -nxt["neg_end"]).alias("overlaps_next"),
        )

    rows = _raw(t).select("doc_id", F.array_sort("raw").alias("s"))
    pairs = F.transform(
        F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))), lambda r, i: pair(r, F.get("s", i.cast("int") + 1))
    )
    return X.span_rows(rows.withColumn("p", pairs), "doc_id", "p")


@register("apply_redactions", _SCAN + "select doc_id, text from redacted", _READS)
def apply_redactions(t: Inputs):
    merged = _raw(t).withColumn("f", S.coalesce_spans(F.col("raw")))
    return merged.select("doc_id", S.redact(F.col("text"), F.col("f")).alias("text"))


@register("scan", _SCAN + "select * from scanned", _READS)
def scan(t: Inputs):
    out = X.scan(spread(t("seeded_docs")), "text", "org_id", t("policies"))
    return out.select("doc_id", "text", "n_findings", "blocked", render(F.col("findings")).alias("findings"))


@register(
    "scan_regional",
    f"with {scan_ctes('regional_docs', 'doc_id', 'text')} select * from scanned",
    "regional_docs policies",
)
def scan_regional(t: Inputs):
    out = X.scan(spread(t("regional_docs")), "text", "org_id", t("policies"))
    return out.select("doc_id", "text", "n_findings", "blocked", render(F.col("findings")).alias("findings"))


# Detectors read from a table; the second form reads the fixed catalogue as a table and must say what `scan` says.
@register(
    "scan_user_detectors",
    f"with {user_ctes('seeded_docs', 'doc_id', 'text', 'user_policies', 'user_detectors')} select * from scanned",
    "seeded_docs user_policies user_detectors",
)
def scan_user_detectors(t: Inputs):
    out = X.scan(spread(t("seeded_docs")), "text", "org_id", t("user_policies"), user_catalogue(t("user_detectors")))
    return out.select("doc_id", "text", "n_findings", "blocked", render(F.col("findings")).alias("findings"))


@register("scan_catalogue_as_table", _SCAN + "select * from scanned", _READS)
def scan_catalogue_as_table(t: Inputs):
    out = X.scan(spread(t("seeded_docs")), "text", "org_id", t("policies"), user_catalogue(detector_rows(t.spark)))
    return out.select("doc_id", "text", "n_findings", "blocked", render(F.col("findings")).alias("findings"))


@register("count_findings", _SCAN + "select doc_id, n_findings from scanned", _READS)
def count_findings(t: Inputs):
    merged = _raw(t).withColumn("f", S.coalesce_spans(F.col("raw")))
    return merged.select("doc_id", S.n_findings(F.col("f")).alias("n_findings"))


# Model entities at fixed places of every document: scores on both sides of the bar, some overlapping findings.
_ENTITIES_SQL = (
    "ents as (select doc_id, 0 as ent_id, 'PERSON' as label, 2 as start, 9 as end_, 0.9 as score from seeded_docs "
    "union all select doc_id, 1, 'PLACE', 20, 31, case when doc_id % 2 = 0 then 0.5 else 0.49 end from seeded_docs "
    "union all select doc_id, 2, 'ORG', length(text) - 14, length(text) - 6, 0.8 from seeded_docs)"
)


def _entities():
    n = F.length("text")

    def ent(i, label, start, end, score):
        return F.struct(
            F.lit(i).alias("ent_id"), F.lit(label).alias("label"), start.alias("start"), end.alias("end"), score.alias("score")
        )

    return F.array(
        ent(0, "PERSON", F.lit(2), F.lit(9), F.lit(0.9)),
        ent(1, "PLACE", F.lit(20), F.lit(31), F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(0.49)),
        ent(2, "ORG", n - 14, n - 6, F.lit(0.8)),
    )


_ACCEPTED_SQL = (
    _SCAN.rstrip() + f", {_ENTITIES_SQL}, accepted as (select e.* from ents e where score >= 0.5 and not exists "
    "(select 1 from raw r where r.doc_id = e.doc_id and e.start < r.end_ and r.start < e.end_)) "
)


@register(
    "accept_entities",
    _ACCEPTED_SQL + "select doc_id, label, cast(start as bigint) as start, cast(end_ as bigint) as \"end\" from accepted",
    _READS,
)
def accept_entities(t: Inputs):
    docs = _raw(t).withColumn("ents", _entities())
    rows = docs.select("doc_id", F.explode(S.accept_entities(F.col("raw"), F.col("ents"))).alias("e"))
    return rows.select("doc_id", "e.label", "e.start", (-F.col("e.neg_end")).alias("end"))


@register(
    "entity_anti_join",
    _ACCEPTED_SQL.replace("score >= 0.5 and", "")
    + "select doc_id, cast(ent_id as bigint) as ent_id, label, cast(start as bigint) as start, cast(end_ as bigint) as \"end\" from accepted",
    _READS,
)
def entity_anti_join(t: Inputs):
    ents = spread(t("seeded_docs")).select("doc_id", F.explode(_entities()).alias("e")).select("doc_id", "e.*").drop("score")
    return X.entity_anti_join(_raw_rows(t), ents, "doc_id", "ent_id")


_DEEP_SQL = (
    _ACCEPTED_SQL.rstrip()
    + ", deep_raw as (select doc_id, label, start, end_, rank, ord from raw union all "
    "select a.doc_id, label, start, end_, 2, 2147483647 from accepted a left join blocks b using (doc_id) where not coalesce(b.blocked, false)), "
    + merge_ctes("doc_id", "deep_raw", "deep")
    + ", "
    + redact_ctes("seeded_docs", "doc_id", "text", "deep", "deep_text")
    + " select doc_id, d.text, coalesce(n, 0) as n_findings, coalesce(b.blocked, false) as blocked from deep_text d "
    "left join (select doc_id, count(*) as n from deep group by doc_id) using (doc_id) left join blocks b using (doc_id)"
)


@register("scan_deep", _DEEP_SQL, _READS)
def scan_deep(t: Inputs):
    docs = spread(t("seeded_docs")).withColumn("ents", _entities())
    out = X.scan_deep(docs, "text", "org_id", t("policies"), entities="ents")
    return out.select("doc_id", "text", "n_findings", "blocked")


@register(
    "redact_for_store",
    f"with {scan_ctes('seeded_docs', 'doc_id', 'text', force=True)} select doc_id, text from scanned",
    _READS,
)
def redact_for_store(t: Inputs):
    return X.redact_at_rest(spread(t("seeded_docs")), "text", "org_id", t("policies")).select("doc_id", "text")


# The cut rule over documents as pending texts; every third one is at its end.
@register(
    "release_prefix",
    _SCAN.rstrip()
    + ", t0 as (select doc_id, text, case when doc_id % 3 = 0 then length(text) else greatest(length(text) - 64, 0) end as t from seeded_docs), "
    "cut as (select doc_id, t0.text as src, coalesce((select min(start) from merged m where m.doc_id = t0.doc_id and start < t and end_ > t), t) as cut from t0), "
    "pre as (select doc_id, substring(src, 1, cut) as text, substring(src, cut + 1) as kept from cut), "
    "done as (select m.* from merged m join cut using (doc_id) where end_ <= cut), "
    + redact_ctes("pre", "doc_id", "text", "done", "out", "true")
    + " select doc_id, o.text as emitted, kept from out o join pre using (doc_id)",
    _READS,
)
def release_prefix(t: Inputs):
    merged = _raw(t).withColumn("f", S.coalesce_spans(F.col("raw")))
    out = merged.withColumn("r", S.release_prefix(F.col("text"), F.col("f"), F.col("doc_id") % 3 == 0))
    return out.select("doc_id", "r.emitted", "r.kept")


