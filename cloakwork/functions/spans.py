"""Sensitive spans as array columns: detect, collect, merge, redact.

A span is half-open, 0-based and counted in code points. Everything here is a Column expression that looks at
one row only, so a scan needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import BLOCK, BUILT_IN, BY_KEY, FLAG, GAPS, MIN_ENTITY_SCORE, REDACT, STREAM_TAIL, WINDOW_MARK, Catalogue, Detector, built_in, java_regex

SPAN = "struct<label:string,start:int,end:int>"
#: Field order is the sort order: leftmost, then widest, then policy order.
RAW = "struct<start:int,neg_end:int,ord:int,label:string,rank:int>"
FINDING = "struct<label:string,start:int,end:int,rank:int>"
#: What a policy set says about each unit of a catalogue.
PLAN = "map<string,struct<rank:int,ord:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank(action: Column) -> Column:
    """Strength of an action name: block 3, flag 1, anything else redact 2."""
    return F.when(action == "block", BLOCK).when(action == "flag", FLAG).otherwise(REDACT)


def stronger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def action_name(r: Column) -> Column:
    return F.when(r == BLOCK, "block").when(r == FLAG, "flag").otherwise("redact")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def guard(text: Column, d: Detector, digit: Column | None = None) -> Column:
    """A cheap test every matching text passes; it spares most texts the full expression."""
    own = built_in(d)
    if own is None:
        return F.lit(True)
    if own.label == "EMAIL":
        return text.contains("@")
    if own.label == "API_KEY":
        return reduce(or_, [text.contains(x) for x in ("sk-", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")])
    digit = has_digit(text) if digit is None else digit
    if own.label == "INTL_PHONE":
        return text.contains("+") & digit
    if own.label in ("SSN", "BR_CPF", "BR_CNPJ"):
        return text.contains("-") & digit
    return digit


def _hit(text: Column, d: Detector, unit: str, wanted: Column | None, digit: Column | None = None) -> Column:
    """struct<unit, label, gaps, hits> where the detector matches, else null: the matches and the text between them."""
    regex = java_regex(d)
    matching = guard(text, d, digit) & text.rlike(regex)
    return F.when(
        matching if wanted is None else wanted & matching,
        F.struct(
            F.lit(unit).alias("unit"),
            F.lit(d.label).alias("label"),
            F.split(text, regex, -1).alias("gaps"),
            F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"),
        ),
    )


def windows(text: Column) -> Column:
    """The text with a mark for every stretch that no fixed detector reaches into, usually short: the whole text is walked
    through once, and the detectors look at what is left. A text that holds the mark itself stays as it is."""
    return F.when(text.contains(WINDOW_MARK), text).otherwise(F.regexp_replace(text, GAPS, WINDOW_MARK))


def window_shifts(text: Column) -> Column:
    """array<int>: how many characters stand in `text`, and not in its `windows`, before each window."""
    gaps = F.regexp_extract_all(text, F.lit(GAPS), F.lit(0))
    later = walk(gaps, F.lit(0), "int", lambda at, gap: (at + F.length(gap) - 1, None, at + F.length(gap) - 1))
    return F.when(text.contains(WINDOW_MARK), F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), later))


#: Items that a fold appends one by one before it hands them on as a block: appending copies what is there already.
BLOCK_ITEMS = 256


def in_blocks(items: Column) -> Column:
    """The array cut into blocks; an empty one is a single empty block."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK_ITEMS).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK_ITEMS + 1, F.lit(BLOCK_ITEMS)))


def walk(items: Column, carry: Column, element: str, step: Callable[[Column, Column], tuple[Column, Column | None, Column]]) -> Column:
    """array<element>: what a fold over `items` gives, which carries a value along. `step` takes what is carried and an
    item, and says what to carry on, whether to give an element (None: always) and which. Takes as long as there are items."""
    none, nested = F.expr(f"cast(array() as array<{element}>)"), F.expr(f"cast(array() as array<array<{element}>>)")

    def state(carried: Column, out: Column) -> Column:
        return F.struct(carried.alias("carry"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        carried, wanted, item = step(acc["carry"], x)
        grown = F.array_append(acc["out"], item.cast(element))
        return state(carried, grown if wanted is None else F.when(wanted, grown).otherwise(acc["out"]))

    def block(acc: Column, some: Column) -> Column:
        return F.aggregate(some, state(acc["carry"], none), one, lambda done: state(done["carry"], F.array_append(acc["out"], done["out"])))

    return let(items, lambda all_: F.aggregate(in_blocks(all_), state(carry, nested), block, lambda acc: F.flatten(acc["out"])))


def _places(hit: Column, shifts: Column | None = None) -> Column:
    """array<struct<start,end>> of one `_hit`, from the running lengths of gaps and matches.

    With `shifts` the hit is one in `windows`, and places are those in the whole text: every mark leads on to the next
    window.
    """
    marks = lambda g: F.length(g) - F.length(F.replace(g, F.lit(WINDOW_MARK), F.lit("")))
    lengths = F.zip_with(
        hit["gaps"], hit["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), (F.lit(0) if shifts is None else marks(g)).alias("marks"))
    )
    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start, window = at["at"] + x["gap"], at["window"] + x["marks"]
        end = start + x["hit"]
        shift = F.lit(0) if shifts is None else F.coalesce(F.get(shifts, window), F.lit(0))
        place = F.struct((start + shift).alias("start"), (end + shift).alias("end"))
        return F.struct(end.alias("at"), window.alias("window")), x["hit"].isNotNull(), place

    return walk(lengths, F.expr("named_struct('at', 0, 'window', 0)"), "struct<start:int,end:int>", step)


def detect(text: Column, key: str) -> Column:
    """array<span> of one detector."""
    found = let(
        _hit(text, BY_KEY[key], key, None),
        lambda hit: F.transform(
            _places(hit),
            lambda m: F.struct(hit["label"].alias("label"), m["start"].alias("start"), m["end"].alias("end")),
        ),
    )
    return F.coalesce(found, F.expr(f"cast(array() as array<{SPAN}>)"))


def _placed(text: Column, catalogue: Catalogue, wanted: Callable[[str], Column]) -> Column:
    """array<struct<unit, label, at>> of the units that are wanted and match. Those of the fixed catalogue look at the
    windows of the text, others, which may match anything, at the whole text."""
    fixed = {u: d for u, d in catalogue.units.items() if built_in(d)}

    def hits(of: Column, units: dict[str, Detector], digit: Column | None) -> Column:
        return F.array_compact(F.array(*[_hit(of, d, u, wanted(u), digit) for u, d in units.items()]))

    def placed(found: Column, shifts: Column | None) -> Column:
        return F.transform(found, lambda h: F.struct(h["unit"].alias("unit"), h["label"].alias("label"), _places(h, shifts).alias("at")))

    none = F.expr("cast(array() as array<struct<unit:string,label:string,at:array<struct<start:int,end:int>>>>)")
    parts = []
    if fixed:
        in_windows = let(windows(text), lambda w: let(has_digit(w), lambda digit: hits(w, fixed, digit)))
        # where the windows stand is asked only if something is found
        parts.append(let(in_windows, lambda h: F.when(F.size(h) > 0, let(window_shifts(text), lambda s: placed(h, s))).otherwise(none)))
    if others := {u: d for u, d in catalogue.units.items() if u not in fixed}:
        parts.append(placed(hits(text, others, None), None))
    return F.concat(none, *parts)


def raw_findings(text: Column, plan: Column, catalogue: Catalogue = BUILT_IN) -> Column:
    """array<RAW>: every match of every unit in `plan`, once per unit.

    A unit asked for by several policies carries its strongest rank and its earliest position; merging repeated
    spans would come to the same, so the duplicates are never built.
    """

    def spans_of(found: Column) -> Column:
        return let(
            F.element_at(plan, found["unit"]),
            lambda rule: F.transform(
                found["at"],
                lambda m: F.struct(
                    m["start"].alias("start"),
                    (-m["end"]).alias("neg_end"),
                    rule["ord"].alias("ord"),
                    found["label"].alias("label"),
                    rule["rank"].alias("rank"),
                ),
            ),
        )

    # an organisation without a plan has no keys, so no expression runs on its texts
    asked = F.map_keys(plan)
    found = let(asked, lambda keys: F.flatten(F.transform(_placed(text, catalogue, lambda u: F.array_contains(keys, u)), spans_of)))
    return F.when(F.size(plan) > 0, found).otherwise(F.expr(f"cast(array() as array<{RAW}>)"))


def collect_findings(text: Column, entries: Column, catalogue: Catalogue = BUILT_IN) -> Column:
    """array<FINDING>: for each (unit, label, rank) entry of the policy list all matches, duplicates kept."""
    asked = F.transform(entries, lambda e: e["unit"])

    def of_entry(found: Column, e: Column) -> Column:
        same = F.filter(found, lambda h: h["unit"] == e["unit"])
        return F.flatten(
            F.transform(
                same,
                lambda h: F.transform(
                    h["at"],
                    lambda m: F.struct(
                        h["label"].alias("label"), m["start"].alias("start"), m["end"].alias("end"), e["rank"].alias("rank")
                    ),
                ),
            )
        )

    placed = let(asked, lambda units: _placed(text, catalogue, lambda u: F.array_contains(units, u)))
    return let(placed, lambda found: F.flatten(F.transform(entries, lambda e: of_entry(found, e))))


def blocked(raw: Column) -> Column:
    """True when any match, before merging, belongs to a blocking policy."""
    return F.exists(raw, lambda f: f["rank"] == BLOCK)


def as_raw(findings: Column) -> Column:
    """array<FINDING> in list order → array<RAW>."""
    return F.transform(
        findings,
        lambda f, i: F.struct(
            f["start"].alias("start"),
            (-f["end"]).alias("neg_end"),
            i.cast("int").alias("ord"),
            f["label"].alias("label"),
            f["rank"].alias("rank"),
        ),
    )


def coalesce_spans(raw: Column) -> Column:
    """Merge overlapping spans of array<RAW> into disjoint array<FINDING>, sorted.

    A span that starts before the running end joins the cluster; touching spans stay apart. The cluster keeps the
    label of its first span and the strongest rank.
    """
    zero = F.expr(f"cast(named_struct('done', array(), 'cur', null) as struct<done:array<array<{FINDING}>>,cur:{FINDING}>)")
    none = F.expr(f"cast(array() as array<{FINDING}>)")

    def finding(label: Column, start: Column, end: Column, r: Column) -> Column:
        return F.struct(label.alias("label"), start.alias("start"), end.alias("end"), r.alias("rank"))

    def state(done: Column, cur: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        fresh = finding(x["label"], x["start"], -x["neg_end"], x["rank"])
        wider = finding(cur["label"], cur["start"], F.greatest(cur["end"], -x["neg_end"]), stronger(cur["rank"], x["rank"]))
        return (
            F.when(cur.isNull(), state(acc["done"], fresh))
            .when(x["start"] < cur["end"], state(acc["done"], wider))
            .otherwise(state(F.array_append(acc["done"], cur), fresh))
        )

    def block(acc: Column, some: Column) -> Column:
        return F.aggregate(some, state(none, acc["cur"]), step, lambda b: state(F.array_append(acc["done"], b["done"]), b["cur"]))

    def closed(acc: Column) -> Column:
        done = F.flatten(acc["done"])
        return F.when(acc["cur"].isNull(), done).otherwise(F.array_append(done, acc["cur"]))

    merged = let(F.array_sort(raw), lambda all_: F.aggregate(in_blocks(all_), zero, block, closed))
    return F.when(F.size(raw) > 0, merged).otherwise(F.expr(f"cast(array() as array<{FINDING}>)"))


def mask(text: Column, spans: Column) -> Column:
    """Replace every one of the given disjoint, sorted spans by its label.

    Characters are counted from the start of a text, so the stretch of a block of spans is cut out once, and the spans
    are cut from the stretch.
    """

    def masked(s: Column) -> Column:
        def end_of(spans_: Column, i: Column, otherwise: Column) -> Column:
            return F.when(i < 0, otherwise).otherwise(F.get(spans_, i)["end"])

        def stretch(some: Column, b: Column) -> Column:
            return let(end_of(s, b.cast("int") * BLOCK_ITEMS - 1, F.lit(0)), lambda at: let(
                F.substr(text, at + 1, F.element_at(some, -1)["end"] - at), lambda part: F.array_join(F.transform(some, lambda x, i: piece(some, part, at, x, i)), "")
            ))

        def piece(some: Column, part: Column, at: Column, x: Column, i: Column) -> Column:
            before = end_of(some, i.cast("int") - 1, at)
            return F.concat(F.substr(part, before - at + 1, x["start"] - before), F.lit("[REDACTED:"), x["label"], F.lit("]"))

        tail = F.substr(text, F.element_at(s, -1)["end"] + 1)
        return F.when(F.size(s) == 0, text).otherwise(F.concat(F.array_join(F.transform(in_blocks(s), stretch), ""), tail))

    return let(spans, masked)


def redact(text: Column, findings: Column) -> Column:
    """Replace the spans whose final action is redact; flagged and blocked spans stay as they are."""
    return mask(text, F.filter(findings, lambda f: f["rank"] == REDACT))


def n_findings(findings: Column) -> Column:
    """Number of merged findings of any action."""
    return F.size(findings)


def accept_entities(raw: Column, entities: Column, min_score: float = MIN_ENTITY_SCORE) -> Column:
    """array<RAW> of the model entities to add to `raw`, taken in arrival order as redactions.

    Dropped: scores under `min_score`, and entities overlapping a raw finding or an entity accepted before.
    """
    as_raw_entity = F.transform(
        F.filter(entities, lambda e: e["score"] >= min_score),
        lambda e, i: F.struct(
            e["start"].cast("int").alias("start"),
            (-e["end"]).cast("int").alias("neg_end"),
            i.cast("int").alias("ord"),
            e["label"].alias("label"),
            F.lit(REDACT).alias("rank"),
        ),
    )

    none = F.expr(f"cast(array() as array<{RAW}>)")
    accepted = let(as_raw_entity, lambda found: _first_come(_clear_of(found, coalesce_spans(raw))))
    return F.when(F.size(as_raw_entity) > 0, accepted).otherwise(none)


def _clear_of(spans: Column, merged: Column) -> Column:
    """The RAW spans that overlap none of the disjoint, sorted findings.

    Ends of disjoint spans rise with their starts, so of those that start before a span ends the last reaches furthest:
    both sides are walked together, spans in the order of their ends.
    """
    places = F.concat(
        F.transform(merged, lambda m: F.struct(m["start"].alias("at"), F.lit(1).alias("kind"), m["end"].alias("edge"), F.expr(f"cast(null as {RAW})").alias("span"))),
        F.transform(spans, lambda s: F.struct((-s["neg_end"]).alias("at"), F.lit(0).alias("kind"), s["start"].alias("edge"), s.alias("span"))),
    )

    def step(reach: Column, x: Column) -> tuple[Column, Column, Column]:
        return F.when(x["kind"] == 1, x["edge"]).otherwise(reach), (x["kind"] == 0) & (x["edge"] >= reach), x["span"]

    return walk(F.array_sort(places), F.lit(-(2**31)), RAW, step)


def _first_come(spans: Column) -> Column:
    """The RAW spans that overlap none accepted before them, `ord` saying who came when. Spans are compared within groups
    that hang together by overlaps only."""
    group = f"struct<end:int,held:array<{RAW}>>"
    end = lambda s: -s["neg_end"]

    def step(cur: Column, x: Column) -> tuple[Column, Column, Column]:
        joins = x["start"] < cur["end"]
        wider = F.struct(F.greatest(cur["end"], end(x)).alias("end"), F.array_append(cur["held"], x).alias("held"))
        fresh = F.struct(end(x).alias("end"), F.array(x).alias("held"))
        return F.when(joins, wider).otherwise(fresh).cast(group), ~joins, cur["held"]

    def accepted(some: Column) -> Column:
        in_turn = F.array_sort(some, lambda a, b: a["ord"] - b["ord"])
        clash = lambda acc, e: F.exists(acc, lambda s: overlaps(e["start"], end(e), s["start"], end(s)))
        return F.aggregate(in_turn, F.expr(f"cast(array() as array<{RAW}>)"), lambda acc, e: F.when(clash(acc, e), acc).otherwise(F.array_append(acc, e)))

    # a last span that nothing joins closes the last group
    closing = F.expr(f"cast(named_struct('start', {2**31 - 1}, 'neg_end', 0, 'ord', 0, 'label', '', 'rank', 0) as {RAW})")
    start = F.expr(f"cast(named_struct('end', {-(2**31)}, 'held', array()) as {group})")
    groups = walk(F.array_append(F.array_sort(spans), closing), start, f"array<{RAW}>", step)
    late = F.flatten(F.transform(groups, accepted))
    return F.transform(late, lambda s: F.struct(s["start"].alias("start"), s["neg_end"].alias("neg_end"), F.lit(2**31 - 1).alias("ord"), s["label"].alias("label"), s["rank"].alias("rank")))


def scan_text(text: Column, plan: Column, entities: Column | None = None, catalogue: Catalogue = BUILT_IN) -> Column:
    """struct<text, findings, n_findings, blocked> of one text under one plan.

    With `entities`, model spans are added unless the text is blocked already; null means the model gave nothing.
    """

    def result(raw: Column, stop: Column) -> Column:
        return let(
            coalesce_spans(raw),
            lambda f: F.struct(
                redact(text, f).alias("text"),
                f.alias("findings"),
                n_findings(f).alias("n_findings"),
                stop.alias("blocked"),
            ),
        )

    def with_entities(raw: Column) -> Column:
        if entities is None:
            return result(raw, blocked(raw))
        return let(
            F.when(blocked(raw), raw).otherwise(F.concat(raw, accept_entities(raw, entities))),
            lambda all_raw: result(all_raw, blocked(all_raw)),
        )

    return let(raw_findings(text, plan, catalogue), with_entities)


def release_cut(pending: Column, findings: Column, flush: Column, tail: int = STREAM_TAIL) -> Column:
    """How many characters of `pending` may go out: all but the tail, and never part of a finding."""
    size = F.length(pending)
    target = F.when(flush, size).otherwise(F.greatest(size - tail, F.lit(0)))
    return let(
        target,
        lambda t: F.coalesce(
            F.array_min(
                F.transform(F.filter(findings, lambda f: (f["start"] < t) & (f["end"] > t)), lambda f: f["start"])
            ),
            t,
        ),
    )


def release_prefix(pending: Column, findings: Column, flush: Column, tail: int = STREAM_TAIL) -> Column:
    """struct<emitted, kept>: the settled prefix with every finding in it masked, and what stays pending."""

    def split_at(cut: Column) -> Column:
        done = F.filter(findings, lambda f: f["end"] <= cut)
        return F.struct(
            mask(F.substr(pending, F.lit(1), cut), done).alias("emitted"), F.substr(pending, cut + 1).alias("kept")
        )

    return let(release_cut(pending, findings, flush, tail), split_at)
