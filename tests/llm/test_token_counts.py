"""Token counts by merging arrays: against the library, with odd and long words."""

from __future__ import annotations

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakwork.llm import token_counts
from cloakwork.llm.common import table

from .test_rowwise import ODD, odd_docs

PATH = public_tokenizers.path(token_counts.BYTE_BPE)
PARTS = ["ab", "aab ", "  \n", "<|endoftext|>", "你好嗎", "é", "'s", "'t 12", "😀", "́x", "\x85\x1c", "the", "ing", " ", "a", "aa", "՘"]


def library(texts):
    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    long_words = ["a" * n for n in range(0, 3000, 97)] + ["".join(rnd.choice(al) for _ in range(4000)) for al in ("ab", "abcdefghijklmnop", "你好嗎世界")]
    return [t for t in ODD if t is not None] + made + long_words + [" " * 5000]


def test_counts_are_the_librarys():
    texts = odd_texts()
    assert token_counts.RankMerger(PATH).count(texts) == library(texts)


def test_blocks_and_one_place_a_round(monkeypatch):
    """Texts cut into blocks, tables that start anew, and merging only the first place of a rank give the same counts."""
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 50)
    monkeypatch.setattr(token_counts, "TABLE_CHARS", 200)
    rules = token_counts.RankMerger(PATH)
    texts = odd_texts()[:400] + ["a" * 1500, "word " * 300]
    assert rules.count(texts) == library(texts)
    rules.all_places, rules.known = False, {}
    assert rules.count(texts) == library(texts)


def test_long_and_short_words_merge_alike():
    rules = token_counts.RankMerger(PATH)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("thehiningaé") for _ in range(rnd.randrange(1, 300))).encode() for _ in range(100)]
    assert rules.merge(words).tolist() == [rules.merge_long(w) for w in words]


def test_rows(spark):
    docs, pairs = odd_docs(spark)
    rows = [(i, t or "") for i, t in pairs]
    want = [(i, len(t.encode()), n, n > 5) for (i, t), n in zip(rows, library([t for _, t in rows]))]
    got = token_counts.count_tokens(docs, limit=5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def test_whole_table(spark, sf_dir):
    rows = {r["doc_id"]: r for r in token_counts.op13_token_counts(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d, n in zip(docs, library([d["text"] or "" for d in docs])):
        assert tuple(rows[d["doc_id"]])[1:] == (len((d["text"] or "").encode()), n, n > 512)


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        token_counts.RankMerger(str(path))
