"""URL filters: a weighted vocabulary found by Aho-Corasick, behind prefix rules on host and path.

Strict terms reject alone; soft terms add up their weights, each distinct term once, and reject from `limit` on, which no
weight reaches alone. A term
counts only where no letter or digit touches it, so that "sex" is not found in "essex".
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from ..plans.session import spread
from .common import map_lists, pick, register, table

#: Reject on one hit.
STRICT = ("porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirls", "casino", "viagra", "cialis", "warez", "malware", "phishing", "nsfw")

#: Weights; several distinct hits reject together.
SOFT = {
    "adult": 1.5, "sex": 1.0, "sexy": 1.0, "nude": 1.0, "x": 0.5, "dating": 1.0, "bets": 1.0, "bet": 1.0, "betting": 1.0, "poker": 1.0,
    "free": 1.0, "cheap": 1.0, "pills": 1.0, "loans": 1.0, "crack": 1.0, "keygen": 1.0, "torrent": 1.0, "spam": 1.0, "farm": 1.0,
    "ads": 1.0, "ad": 1.0, "track": 1.0, "tracker": 1.0, "click": 1.0, "popup": 1.0, "banner": 1.0,
}

#: (verdict, host/path): a rule holds for its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

LIMIT = 2.0

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null and without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_index(rules: Sequence[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """host → [(path, verdict)], longest path first."""
    index: dict[str, list[tuple[str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        index.setdefault(host.translate(_LOWER), []).append((slash + path, verdict))
    for paths in index.values():
        paths.sort(key=lambda p: -len(p[0]))
    return index


def match_rule(host: str, path: str, index: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, equal lengths to the longer host."""
    best = None
    labels = host.split(".") if host else []
    for i in range(len(labels)):  # from the longest host on
        tail = ".".join(labels[i:])
        for start, verdict in index.get(tail, ()):
            if path.startswith(start):
                if best is None or len(tail) + len(start) > len(best[0]):
                    best = (tail + start, verdict)
                break
    return best


def automaton(strict: Sequence[str], soft: dict[str, float]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, weight in soft.items():
        a.add_word(term, (term, weight, False))
    for term in strict:
        a.add_word(term, (term, 0.0, True))
    a.make_automaton()
    return a


def term_hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int, float]:
    """(strict hits, distinct soft hits, weight of the distinct soft hits) with boundary checks on both sides."""
    low = url.translate(_LOWER)
    strict, soft = 0, {}
    for end, (term, weight, is_strict) in terms.iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
            continue
        if is_strict:
            strict += 1
        else:
            soft[term] = weight
    return strict, len(soft), float(sum(soft.values()))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT, soft: dict[str, float] | None = None, limit: float = LIMIT,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    The longest fitting rule decides; without one the vocabulary does. A null or malformed url has empty host and path,
    no rule, and is judged by its terms (null: none, so allowed). Repeated rows are judged each; other columns are left
    out, whatever their names. Row-local: no shuffle, and a batch of urls is all a task holds.
    """
    soft = SOFT if soft is None else soft
    rows = spread(pick(pages, page_id=id_col, url=url_col))
    rows = rows.select(rows["page_id"].cast("long").alias("page_id"), rows["url"].cast("string").alias("url"))

    def make() -> Callable:
        index, terms = rule_index(rules), automaton(strict, soft)

        def step(ids: list, urls: list) -> list[list]:
            hosts, paths, named, verdicts, hard, weak, weights = [], [], [], [], [], [], []
            for url in urls:
                host, path = split_url(url)
                hits = term_hits(url or "", terms)
                rule = match_rule(host, path, index)
                hosts.append(host), paths.append(path), named.append(rule and rule[0])
                verdicts.append(rule[1] if rule else "block" if hits[0] or hits[2] >= limit else "allow")
                hard.append(hits[0]), weak.append(hits[1]), weights.append(hits[2])
            return [ids, hosts, paths, named, verdicts, hard, weak, weights]

        return step

    return map_lists(rows, make, "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, soft_weight double")


def _check_sql() -> str:
    host = "translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        whens.append(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{verdict} {rule}'")
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    soft = " + ".join(f"case when regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') then {w} else 0.0 end" for t, w in SOFT.items())
    strict = " + ".join(f"case when regexp_matches({low}, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') then 1 else 0 end" for t in STRICT)
    return f"""
    with parts as (select page_id, url, coalesce({host}, '') as host, coalesce({path}, '') as path from pages),
    judged as (select *, case {' '.join(whens)} end as fit, cast({soft} as double) as soft_weight, cast({strict} as bigint) as strict_hits from parts)
    select cast(page_id as bigint) as page_id, host, path, substr(fit, strpos(fit, ' ') + 1) as rule,
      coalesce(split_part(fit, ' ', 1), case when strict_hits > 0 or soft_weight >= {LIMIT} then 'block' else 'allow' end) as verdict
    from judged"""


@register("op10_url_filter", _check_sql())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
