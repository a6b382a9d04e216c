"""BPE encoding by forced boundaries, and decoding.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge, so a word may be cut there
before any merge runs. The fragments are encoded independently - each once per task, then from a table - and their ids
concatenated. The cuts make fragments shorter and more often equal than words.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from operator import add

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models

from .common import map_lists, register, table, texts

WORD_BPE = "word_bpe_49k.json"
#: Fragments and words a worker keeps encoded, per generation; beyond it the older are encoded anew, which changes nothing.
TABLE_ENTRIES = 150_000

# Below this code point composition and lower-casing work on each character by itself, in any version of Unicode.
_PLAIN_END = 0x250
_LETTERS = "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == "L")
_NUMBERS = "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] == "N")
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0"  # Python's own class holds four more
_NOT_PLAIN = re.compile(r"[^\x00-ɏ]")
# The words of the tokenizer's own expression, for plain text.
_PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


class _Table(dict):
    """A bounded table of what `make` gives for a key, in two generations, so that frequent keys outlive a renewal."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ForcedBoundaryBpe:
    """Encoder and decoder of a BPE tokenizer with byte-level words and a word-end suffix."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pieces = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces.update({i: t for t, i in self.added.items()})
        self.last = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix or None, cache_capacity=0)
        self.inner = models.BPE(vocab=vocab, merges=merges, cache_capacity=0)
        inside = {a + b for t in vocab for a, b in zip(t.removesuffix(suffix), t.removesuffix(suffix)[1:])}
        self.inside = frozenset(inside)
        self.byte_symbols = _byte_symbols()
        self.fragments = _Table(self._fragment, entries)
        self.words = _Table(self._word, entries)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def cut(self, symbols: str) -> list[str]:
        """The fragments between the certain cuts of a word given as byte symbols."""
        inside = self.inside
        if inside.issuperset(map(add, symbols, symbols[1:])):
            return [symbols]
        at, out = 0, []
        for i in range(1, len(symbols)):
            if symbols[i - 1 : i + 1] not in inside:
                out.append(symbols[at:i])
                at = i
        out.append(symbols[at:])
        return out

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ids of one word given as byte symbols."""
        fragments = self.cut(symbols)
        if len(fragments) == 1:
            return self._fragment((symbols, True))
        ids: list[int] = []
        for fragment in fragments[:-1]:
            ids += self.fragments[fragment, False]
        ids += self.fragments[fragments[-1], True]
        return ids

    def _fragment(self, key: tuple[str, bool]) -> list[int]:
        """Ids of a fragment; the flag says whether it ends the word."""
        symbols, final = key
        return [t.id for t in (self.last if final else self.inner).tokenize(symbols)]

    def _word(self, word: str) -> tuple[bytes, int, str]:
        """(ids as little-endian 32-bit, their number, their tokens joined by spaces) of one word."""
        if word.isascii() and word.isprintable():
            symbols = word  # printable ASCII stands for itself, and no word holds a space
        else:
            symbols = word.encode().decode("latin-1").translate(self.byte_symbols)
        return self._packed(self.encode_symbols(symbols))

    def _packed(self, ids: list[int]) -> tuple[bytes, int, str]:
        return struct.pack(f"<{len(ids)}I", *ids), len(ids), " ".join([self.pieces[i] for i in ids])

    def split_words(self, text: str) -> list[str]:
        if _NOT_PLAIN.search(text) is None:
            return _PLAIN_WORDS.findall(text.lower())
        # other scripts: the tokenizer's own normalizer and words; its byte symbols are turned back into text
        clean = self.tokenizer.normalizer.normalize_str(text)
        back = {v: k for k, v in self.byte_symbols.items()}
        return [w.translate(back).encode("latin-1").decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]

    def encode(self, text: str) -> tuple[bytes, int, str]:
        """(ids as little-endian 32-bit, their number, decoded text)."""
        parts: list[tuple[bytes, int, str]] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            parts += map(self.words.__getitem__, self.split_words(text[at : m.start()]))
            parts.append(self._packed([self.added[m[0]]]))
            at = m.end()
        parts += map(self.words.__getitem__, self.split_words(text[at:] if at else text))
        if not parts:
            return b"", 0, ""
        ids, counts, pieces = zip(*parts)
        return b"".join(ids), sum(counts), " ".join(pieces)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as a tokenizer without a decoder does; special tokens are kept."""
        return " ".join([self.pieces[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBpe:
    """The encoder of a vocabulary file, with its tables, once per worker process."""
    return ForcedBoundaryBpe(path)


def _byte_symbols() -> dict[int, int]:
    """Byte → the visible character that stands for it in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: b for b in shown}, **{b: 256 + i for i, b in enumerate(hidden)}}


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (text).

    Whole texts; null counts as empty and gives no ids and an empty text. Repeated rows come once each, equal texts give
    equal ids; other columns are left out. `path` names the vocabulary file, which every worker has. Row-local.
    """
    path = path or public_tokenizers.path(WORD_BPE)

    def make() -> Callable:
        bpe = encoder(path)

        def step(doc_ids: list, all_texts: list) -> list[list]:
            found = [bpe.encode(t) for t in all_texts]
            return [doc_ids, [n for _, n, _ in found], [i for i, _, _ in found], [d for _, _, d in found]]

        return step

    return map_lists(texts(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids binary, decoded string")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As `encode_documents`, but with the SHA-256 of ids and decoded text instead of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_tokenizers.path(WORD_BPE)

    def make() -> Callable:
        bpe = encoder(path)

        def step(doc_ids: list, all_texts: list) -> list[list]:
            counts, of_ids, of_text = [], [], []
            for t in all_texts:
                ids, n, decoded = bpe.encode(t)
                counts.append(n)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            return [doc_ids, counts, of_ids, of_text]

        return step

    return map_lists(texts(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@register("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
