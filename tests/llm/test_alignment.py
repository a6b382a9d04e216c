"""Cross-tokenizer alignment: against plain loops over the libraries' tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cloakwork.llm import alignment
from cloakwork.llm.common import table

from .test_rowwise import ODD

TOK_A = Tokenizer.from_file(public_tokenizers.path(alignment.SIDE_A))
TOK_A.encode_special_tokens = True
TOK_B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.SIDE_B))
SYMBOL = {s: b for b, s in enumerate(alignment._byte_symbols())}


def tokens(text):
    a = [(i, bytes(SYMBOL[c] for c in TOK_A.id_to_token(i))) for i in TOK_A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in TOK_B.encode(text):
        piece = TOK_B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if TOK_B.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def groups_of(text):
    """[(ids of a, ids of b)] of each group."""
    if not text:
        return []
    a, b = tokens(text)
    said = (" " + text).encode()
    if b"".join(t for _, t in a) != said or b"".join(t for _, t in b) != said:
        return []
    out, at_a, at_b, end_a, end_b, cur = [], 0, 0, 0, 0, ([], [])
    while at_a < len(a) or at_b < len(b):
        if end_a <= end_b:
            cur[0].append(a[at_a][0])
            end_a += len(a[at_a][1])
            at_a += 1
        else:
            cur[1].append(b[at_b][0])
            end_b += len(b[at_b][1])
            at_b += 1
        if end_a == end_b:
            out.append(cur)
            cur = ([], [])
    return out


def plain(rows):
    found = [(i, groups_of(t)) for i, t in rows]
    counts = Counter()
    for _, groups in found:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        spelt = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(spelt.encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == most[p[0]] for p in links)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), n_best, sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def odd_rows():
    rnd = random.Random(4)
    parts = ["the ", "a▁b", "  ", "\n\n", "你好嗎", "é", "<|endoftext|>", "<s>", "　", "１２", "😀🏽", "\x00", "​", "ing", "xyzzy ", "\r\n", "\t", "<0x0A>"]
    rows = list(enumerate(ODD))
    rows += [(100 + i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))) for i in range(300)]
    return rows + [(None, "some text"), (3, "some text"), (3, "some text"), (500, "word " * 3000), (501, "ab" * 3000), (502, "你好嗎世界" * 400)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, monkeypatch, small):
    """Also with many small runs, dealt over many splits."""
    rows = odd_rows()
    if small:
        monkeypatch.setattr(alignment, "SPLIT_RECORDS", 5)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, TEXT int")
    assert rows_of(alignment.align_documents(df, run_records=50 if small else alignment.RUN_RECORDS)) == plain(rows)


def test_no_documents(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_are_kept_if_asked_for(spark):
    df = spark.createDataFrame([(1, "Haanth reoush"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.align_documents(df, keep_groups=True).collect()}
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"]
    assert rows[2]["groups"] == ""


def test_wide_groups_and_blocks(monkeypatch):
    both = alignment.Aligner(public_tokenizers.path(alignment.SIDE_A), public_tokenizers.path(alignment.SIDE_B))
    assert both.can_cut
    texts = [t for _, t in odd_rows() if t]
    want = [both.groups(t) for t in texts]
    links = [both.links(*g) for g in want if g]
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 20)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    for t, g in zip(texts, want):
        again = both.groups(t)
        assert (again is None) == (g is None)
        assert g is None or all(np.array_equal(x, y) for x, y in zip(g, again))
    for one, g in zip(links, (g for g in want if g)):
        two = both.links(*g)
        assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])


def test_runs_say_their_records():
    rnd = np.random.default_rng(1)
    held = [(d, p := np.unique(rnd.integers(0, 5000 * 32000, 300)), rnd.integers(1, 70000, len(p))) for d in range(200)]
    want = sorted((int(p), d, int(t)) for d, pairs, times in held for p, t in zip(pairs, times))
    got = []
    for radix, records, block in alignment._run_blocks(held, 32000):
        pairs, documents, docs, times = alignment._block_records(block)
        assert records == len(docs) and set(pairs // 32000 % alignment.RADIXES) == {radix}
        assert all(np.array_equal(x, y) for x, y in zip(alignment._block_pairs(block), (pairs, documents)))
        got += zip(np.repeat(pairs, documents).tolist(), docs.tolist(), times.tolist())
    assert sorted(got) == want


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert rows_of(alignment.op12_alignment(spark, sf_dir)) == plain(docs)


@pytest.mark.parametrize("wide", [1, alignment.WIDE_GROUP])
def test_small_texts_are_grouped_together(monkeypatch, wide):
    both = alignment.Aligner(public_tokenizers.path(alignment.SIDE_A), public_tokenizers.path(alignment.SIDE_B))
    texts = ["one two  three", "", "a\tb", "...... the end ......", "naïve 漢字 \U0001f600", "ab cd. ef" * 30] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(alignment, "WIDE_GROUP", wide)
    calls, grouped = [], alignment.Aligner.grouped
    monkeypatch.setattr(alignment.Aligner, "grouped", lambda self, a, b: calls.append(len(a)) or grouped(self, a, b))
    got = [row for part in alignment._joined(both, batch) for row in part]
    assert len(calls) == 1 and [row[0] for row in got] == list(range(len(texts)))
    for text, (_, stats, said, pairs, times) in zip(texts, got):
        found = both.groups(text)
        if found is None:
            assert (stats, said.tobytes(), len(pairs)) == ((0, 0, 0, 0), b"", 0)
            continue
        a, in_a, b, in_b = found
        of = lambda ids, group, g: ",".join(map(str, ids[group == g].tolist()))
        assert said.tobytes().decode() == ";".join(f"{of(a, in_a, g)}|{of(b, in_b, g)}" for g in range(in_a[-1] + 1))
        assert stats == (len(a), len(b), in_a[-1] + 1, times.sum())
        assert all(np.array_equal(x, y) for x, y in zip((pairs, times), both.links(*found)))
