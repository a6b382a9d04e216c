"""Secret scans: base patterns, and weak parts of a credential linked by an interval join within scopes.

Some parts of a credential prove nothing alone: a labelled account name, a long random-looking word, a service address.
They are reported only where complementary parts stand together: within `reach` code points of each other and in one
scope (text between blank lines). A weak secret needs an access identifier, a weak identifier needs a secret, an
endpoint needs a reported identifier or secret.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .common import map_lists, register, table, texts

#: The base kinds in the order of the report, then the linked ones.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
REACH = 300

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
# A greedy run of the class that is too short has no longer one inside, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WEAK_ACCESS = re.compile(
    r"""(?<![A-Za-z0-9])(?:(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}|ASIA[A-Z0-9]{12,})""", re.A
)
_WEAK_ACCESS_WORDS = ("access", "client", "account", "user", "login", "asia")
# "=" may stand before the run (name=value, query strings); after it, it is padding only.
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]+|(?<![\w.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:\d{2,5}\b""")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str, low: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, by start, then kind."""
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [Span(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [Span(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _random_looking(word: str) -> bool:
    digits = 1 if len(word) == 40 else 2  # one is enough at the length of AWS secret keys
    return any(c.isupper() for c in word) and any(c.islower() for c in word) and sum(c.isdigit() for c in word) >= digits and len(set(word)) >= 12


class Side:
    """One side of the interval join: per scope the spans by start, to ask whether any comes near enough."""

    def __init__(self, spans: list[Span], cuts: list[int]):
        self.cuts = cuts
        self.starts: dict[int, list[int]] = {}
        self.reaches: dict[int, list[int]] = {}  # running maximum of the ends, so that a long early span is not missed
        for s in sorted(spans):
            scope = bisect_right(cuts, s.start)
            ends = self.reaches.setdefault(scope, [])
            self.starts.setdefault(scope, []).append(s.start)
            ends.append(max(s.end, ends[-1]) if ends else s.end)

    def near(self, span: Span, reach: int) -> bool:
        """Is one of these spans within `reach` of `span`, in its scope? -1: does one overlap it?"""
        scope = bisect_right(self.cuts, span.start)
        if scope not in self.starts:
            return False
        i = bisect_right(self.starts[scope], span.end + reach)
        return i > 0 and self.reaches[scope][i - 1] >= span.start - reach


def linked_spans(text: str, low: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts with a complement near them: joins of the sorted parts, each a search in a sorted list."""
    taken = Side(base, [])
    free = lambda m: not taken.near(Span(m.start(), 0, m.end()), -1)
    weak_ids = []
    if any(w in low for w in _WEAK_ACCESS_WORDS):
        weak_ids = [Span(m.start(), 3, m.end()) for m in _WEAK_ACCESS.finditer(text) if free(m)]
    ids = [s for s in base if s.kind == 1] + weak_ids
    secrets = [s for s in base if s.kind != 1]
    if not ids and not secrets:
        return []
    cuts = [m.end() for m in _BLANK_LINE.finditer(text)]
    # random-looking words are looked for only where an identifier can stand beside them
    weak_secrets = [Span(m.start(), 4, m.end()) for m in _WEAK_SECRET.finditer(text) if free(m) and _random_looking(m[0])] if ids else []
    id_side = Side(ids, cuts)
    weak_secrets = [s for s in weak_secrets if id_side.near(s, reach)]
    secret_side = Side(secrets + weak_secrets, cuts)
    weak_ids = [s for s in weak_ids if secret_side.near(s, reach)]
    known = Side([s for s in base if s.kind == 1] + weak_ids + secrets + weak_secrets, cuts)
    ends = [Span(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text) if free(m)] if ":" in text else []
    return weak_ids + weak_secrets + [s for s in ends if known.near(s, reach)]


def find_secrets(text: str, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by start, then kind."""
    low = text.lower()
    base = base_spans(text, low)
    return base, sorted(base + linked_spans(text, low, base, reach))


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with every identifier and secret masked; endpoints stay, as they open nothing alone."""
    out, at = [], 0
    for s in find_secrets(text)[1]:
        if s.kind == 5 or s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], mask]
        at = s.end
    return text if not at else "".join([*out, text[at:]])


def _line(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_linked, base (base spans), spans (all of them).

    Spans read kind:start:end in code points, end exclusive, joined by commas. Null text counts as empty and has none.
    Repeated rows come once each; other columns are left out. The parts of a credential stand in one text, so the join
    is done where the text is: nothing is shuffled, and work is linear in the text but for searches in sorted lists.
    """

    def make() -> Callable:
        def step(ids: list, all_texts: list) -> list[list]:
            found = [find_secrets(t, reach) for t in all_texts]
            counts = [[sum(s.kind == k for s in base) for base, _ in found] for k in range(3)]
            return [ids, *counts, [len(full) - len(base) for base, full in found], [_line(base) for base, _ in found], [_line(full) for _, full in found]]

        return step

    return map_lists(texts(docs, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base string, spans string")


@register("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "sha2(base, 256) AS base_sha256", "spans")
