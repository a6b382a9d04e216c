"""Spelling variants: machines, parts and whole tables against plain loops."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from cloakwork.llm import spelling
from cloakwork.llm.common import table


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words, pairs=None):
    near_of = {w: [] for w in words}
    for a, b in pairs if pairs is not None else ((a, b) for a in words for b in words if near(a, b)):
        near_of[a].append(b)
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near_of[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows)


def test_composition():
    rnd = random.Random(3)
    for _ in range(150):
        letters = "abcé"[: rnd.randrange(1, 5)]
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 7))) for _ in range(rnd.randrange(0, 40))})
        assert set(spelling.one_edit_pairs(words)) == {(a, b) for a in words for b in words if near(a, b)}


def test_acceptor_is_minimal():
    words = sorted({a + b for a in ("ab", "cd", "e", "") for b in ("ing", "ed", "s")})
    machine = spelling.Acceptor(words)

    def language(state):
        own = {""} if machine.final[state] else set()
        return frozenset(own | {c + rest for c, to in machine.arcs[state].items() for rest in language(to)})

    languages = [language(s) for s in range(len(machine.arcs))]
    assert languages[machine.start] == frozenset(words)
    assert len(set(languages)) == len(languages)


def alike(rnd, n):
    """Words that share beginnings and ends, many of them near one another, and a few very long ones."""
    stems = ["abcdefg", "abcdefgh", "aaaaaaaa", "ciónción"]
    words = {}
    for _ in range(n):
        w = rnd.choice(stems) + "".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 6)))
        if rnd.random() < 0.5:
            at = rnd.randrange(len(w))
            w = w[:at] + rnd.choice(["", "a", "zz", "é"]) + w[at + 1 :]
        if len(w) >= 7:
            words[w] = rnd.choice([2, 3, 25, 40, 400, 400, 5000])
    long = "".join(rnd.choice("abcdef") for _ in range(3000))
    for w in (long, long[:1500] + long[1501:], long[:1500] + "z" + long[1501:], "z" + long, long[1:], long + "z"):
        words[w] = rnd.choice([2, 30, 400])
    return words


@pytest.mark.parametrize("part_words", [2, 20, 4096])
def test_parts_lose_no_pair(spark, part_words):
    words = alike(random.Random(part_words), 500)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(df, part_words=part_words)) == plain_variants(words)
    if part_words < 4096:
        rows = spelling.parts(df, part_words).filter("size - low - high > 1").groupBy("part").count()
        assert rows.filter(f"count > {part_words}").count() == 0


def test_chain_of_forms_and_ties(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "lonely-w": 9}
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, WORD string")
    rows = {r[0]: r for r in got(spelling.variants(df))}
    assert rows["abcdefg"][1:3] == ("abcdefgh", "abcdefghij")
    assert rows["zzzzzzz"][1:] == ("zzzzzzx", "zzzzzzx", 5, 2, 50)
    assert rows["lonely-w"][1:] == (None, "lonely-w", 9, 0, None)


def test_odd_words(spark):
    df = spark.createDataFrame([(None, 3), ("abcdefg", None), ("abcdefgh", 2), ("abcdefgh", 3)], "word string, n long")
    rows = {r["word"]: tuple(r)[1:] for r in spelling.variants(df).collect()}
    assert rows == {None: (None, None, 3, 0, None), "abcdefg": ("abcdefgh", "abcdefgh", 0, 1, 5), "abcdefgh": (None, "abcdefgh", 5, 1, None)}
    assert spelling.variants(df.limit(0)).collect() == []


def test_vocabulary(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["Sommeil", "ÀÉÎÕÜÿþ", "ordinary", "shorts", "Ordinary×÷", "naïveté-x1elsewhere"]) for _ in range(30))) for i in range(200)]
    rows += [(None, "ordinary ordinary elsewhere"), (7, None), (8, ""), (9, "x" * 5000), (9, "x" * 5000), rows[0], rows[1]]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, TEXT int")
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()} == plain_vocabulary(rows)
    assert spelling.vocabulary(df.limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    """Against an index of all one-letter deletions, which finds the same pairs in another way."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    words = plain_vocabulary(docs)
    holes: dict[tuple, list] = {}
    shorter = set()
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in words:
                shorter |= {(w, w[:i] + w[i + 1 :]), (w[:i] + w[i + 1 :], w)}
    pairs = {(a, b) for group in holes.values() for a in group for b in group if a != b} | shorter
    assert got(spelling.op11_spelling(spark, sf_dir)) == plain_variants(words, pairs)
