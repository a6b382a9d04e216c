"""The join against all pairs, on the given documents and on planted groups."""

from __future__ import annotations

import random
import re

import pytest

from cloakwork.llm import jaccard_join
from cloakwork.llm.common import table
from cloakwork.llm.jaccard_join import near_duplicates, op2_jaccard_join

SCHEMA = "doc_id long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def plain(rows, num, den, n):
    """(doc_id, n_shingles, component_id) by comparing all pairs of sets that share anything."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t, n), []).append(i)
    keys = [s for s in sets if s]
    holders = {}
    for k, s in enumerate(keys):
        for x in s:
            holders.setdefault(x, []).append(k)
    parent = list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, s in enumerate(keys):
        near = {j for x in s for j in holders[x] if j > k and min(len(s), len(keys[j])) * den >= max(len(s), len(keys[j])) * num}
        for j in near:
            if den * len(s & keys[j]) >= num * len(s | keys[j]):
                parent[root(j)] = root(k)
    low = {}
    for k, s in enumerate(keys):
        for i in sets[s]:
            if i is not None and i < low.get(root(k), i + 1):
                low[root(k)] = i
    out = [(i, len(s), low.get(root(k))) for k, s in enumerate(keys) for i in sets[s]]
    return out + [(i, 0, i) for i in sets.get(frozenset(), [])]


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    same(op2_jaccard_join(spark, sf_dir).collect(), plain(rows, 9, 10, 3))


@pytest.mark.parametrize(("num", "den", "n"), [(9, 10, 3), (4, 5, 5)])
def test_planted_groups(spark, num, den, n):
    """Chains and stars around the bound, a passage that most documents share, copies, short texts, nulls."""
    rng = random.Random(num)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    passage = [word() for _ in range(25)]
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (1, None), (2, ""), (3, "  \t"), (4, "a"), (5, "A"), (6, "a b"), (7, "x y z"), (8, "X y z")]
    i = 10
    for group in range(8):
        base = [word() for _ in range(rng.choice([12, 30, 60, 150]))] + (passage if group % 2 else [])
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                base = text  # a chain: the next is made from this one
            rows.append((i, " ".join(text)))
            i += 1
        rows.append((i, rows[-1][1]))
        i += 1
    for _ in range(30):
        rows.append((i, " ".join([word() for _ in range(rng.randint(1, 20))] + passage)))
        i += 1
    rows.append(rows[-1])
    df = spark.createDataFrame([(*r, "n", 5) for r in rows], SCHEMA + ", node string, `Doc_Id` int")
    got = near_duplicates(df, similarity=(num, den), shingle=n).select("doc_id", "n_shingles", "component_id").collect()
    same(got, plain(rows, num, den, n))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def templated(n, rng):
    """Documents of one template of 70 words with four fields of 30 values each."""
    base = [f"t{i}" for i in range(70)]
    for i in range(n):
        words = list(base)
        for field, at in enumerate((9, 27, 45, 63)):
            words[at] = f"v{field}x{rng.randrange(30)}"
        yield i, " ".join(words)


def test_templates_are_not_paired_throughout(spark, monkeypatch):
    """What all documents share brings no pairs: widely shared tokens stay behind the fields, by their true frequency."""
    met = []

    def counted(pairs, *more):
        met.append(pairs.count())
        return verified(pairs, *more)

    verified = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", counted)
    few, many = list(templated(750, random.Random(1))), list(templated(3000, random.Random(2)))
    took = []
    for rows in (few, many):
        met.clear()
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA), similarity=(9, 10), shingle=3, slack=1).select("doc_id", "n_shingles", "component_id").collect()
        took.append(sum(met))
        if rows is few:
            same(got, plain(rows, 9, 10, 3))
    assert took[1] <= 300_000 and took[1] <= 20 * max(took[0], 1000), took
