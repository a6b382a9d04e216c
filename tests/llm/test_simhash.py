"""Fingerprints, the edited-text comparison against plain loops, and the block tables against all pairs."""

from __future__ import annotations

import hashlib
import random

import pytest

from cloakwork.llm.hashing import CHUNK, run_hashes, word_hashes
from cloakwork.llm.simhash import compare_with_next, fingerprint, fingerprint_documents, likeness, near_fingerprints, op5_simhash

SCHEMA = "doc_id long, text string"


def plain(rows):
    """doc_id → (n_chars, edited text, next text) by the definition."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    out = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + n[:half], t, n))
    return out


def check(got, rows):
    want = []
    for i, n, edited, t, following in plain(rows):
        f, e, g = fingerprint(t), fingerprint(edited), fingerprint(following)
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), f.hex(), e.hex(), likeness(f, e), likeness(f, g)))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op5_simhash(spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("stretch", [1, 2, 5, 1000])
def test_stretches_nulls_and_repeats(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.choice([None, *range(-5, 20)]), rng.choice([None, "", " ", "é" * 7, "a b c d", "A B c D", "x y z " * rng.randint(1, 30)])) for _ in range(40)]
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", `Text` int, part int") if stretch == 2 else spark.createDataFrame(rows, SCHEMA)
    check(compare_with_next(df, stretch=stretch).collect(), rows)


def test_empty_and_single(spark):
    assert compare_with_next(spark.createDataFrame([], SCHEMA)).collect() == []
    assert fingerprint_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    check(compare_with_next(spark.createDataFrame([(3, "a b c")], SCHEMA)).collect(), [(3, "a b c")])


def test_equal_texts_and_likeness():
    assert fingerprint("a b c") == fingerprint("A  b\tc") != fingerprint("a b d e")
    assert likeness(fingerprint("x y z"), fingerprint("x y z")) == 1.0
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    a = [word() for _ in range(400)]
    b = a[:200] + [word() for _ in range(200)]
    c = [word() for _ in range(400)]
    fa, fb, fc = (fingerprint(" ".join(x)) for x in (a, b, c))
    assert likeness(fa, fb) > 0.25 > likeness(fa, fc)


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(5)
    prints = []
    for i in range(60):
        base = rng.getrandbits(64)
        prints.append((2 * i, f"{base:016x}"))
        for _ in range(rng.randint(0, 5)):
            base ^= 1 << rng.randrange(64)
        prints.append((2 * i + 1, f"{base:016x}"))
    prints += [(1000, prints[0][1]), (1001, None)]
    members, pairs = near_fingerprints(spark.createDataFrame(prints, "doc_id long, fingerprint string"), 3)
    values = sorted({p for _, p in prints if p})
    want = {(a, b, d) for a in values for b in values if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert {tuple(r) for r in pairs.collect()} == want and want
    assert members.count() == len(prints)


def test_word_hashes_do_not_depend_on_place():
    rng = random.Random(7)
    seen: dict[bytes, int] = {}

    def check_text(t):
        words = t.encode().lower().split()
        hashes = word_hashes(t).tolist()
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes):
            assert seen.setdefault(w, h) == h

    for _ in range(200):
        check_text("".join(rng.choice("abAB  \n\té\x0b\x1c\xa0") for _ in range(rng.randint(0, 60))))
    for size in (CHUNK - 2, CHUNK - 1, CHUNK, 2 * CHUNK + 3):
        check_text("b " + "x" * size + " c " + "ab cd " * 30000)
        check_text("x" * size)
    assert len(set(seen.values())) == len(seen)
    assert len(run_hashes(word_hashes("a b"), 3)) == 1 and len(run_hashes(word_hashes(" "), 3)) == 0
