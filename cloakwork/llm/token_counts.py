"""Token counts by rank-synchronous merging of arrays.

The pre-tokens of a batch that have not been counted before lie behind one another in one flat array of symbols. In
each round every pre-token applies its own pair of lowest rank, at all places it occurs in it, and all pre-tokens do so
in the same numpy steps; a pre-token without a mergeable pair is done, and its surviving symbols are its tokens. There
are as many rounds as the pre-token with the most distinct merges needs, so a few very long ones are merged apart, by
the same rule but with the places of each rank kept in buckets.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import map_lists, register, table, texts

BYTE_BPE = "byte_bpe_50k.json"
#: Tokens above which a document is over the limit.
LIMIT = 512
#: Characters of distinct pre-tokens a worker keeps counts of; beyond it the table starts anew, which changes nothing.
TABLE_CHARS = 16 << 20
#: Characters of text whose pre-tokens are held at once.
BLOCK_CHARS = 1 << 20
#: Symbols above which a pre-token is merged apart, and below which blocks of text are not cut.
LONG = 1024

_NONE = np.int64(2**62)
# Up to here the two expression engines agree on what is a letter, a number or a space.
_NOT_PLAIN = re.compile(r"[^\x00-ɏ‐-‧‰-⁞]")
_WORDS = regex.compile(public_tokenizers.PATTERN)
# No pre-token goes on over white space that follows something else, so a text may be cut there.
_CUT = re.compile(r"(?<=[0-9A-Za-z.,])(?= [0-9A-Za-z])")


class RankMerger:
    """Merge rules of a byte-level BPE file, and the number of tokens of pre-tokens under them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if spec["normalizer"] or not plain or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        self.order = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.order]
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.of_byte = np.array([vocab[s] for s in _byte_symbols()], dtype=np.int64)
        # If no merge uses a symbol that a later one makes, a merge can only bring about pairs of higher rank, and all
        # places of a rank may be merged at once; otherwise only the first is.
        rank_of = {}
        for rank, (a, b) in enumerate(merges):
            rank_of.setdefault(a + b, rank)
        self.all_places = len(rank_of) == len(merges) and all(rank_of.get(s, -1) < rank for rank, m in enumerate(merges) for s in m)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.known: dict[str, int] = {}
        self.known_chars = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, `_NONE` where there is no such merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.order[at], _NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Number of surviving symbols of each (not empty) word, all merged in step."""
        counts = np.zeros(len(words), dtype=np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = np.full(len(symbols), _NONE)  # of the pair that starts here
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(symbols))
            done = lowest == _NONE
            if done.any():
                counts[owner[starts[done]]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbols, rank, owner = symbols[stay], rank[stay], owner[stay]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = at[self._apart(at, owner)]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, rank, owner = symbols[keep], rank[keep], owner[keep]
            at = place[at]
            self._rerank(symbols, rank, owner, np.concatenate([at, at[at > 0] - 1]))
        return counts

    def _apart(self, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which of the places with the word's lowest rank are merged: from the left, none that shares a symbol with the one before."""
        if not self.all_places:
            return np.diff(owner[at], prepend=-1) != 0
        run = np.cumsum(np.diff(at, prepend=-2) != 1)  # places in a row overlap: of those, every other one
        first = np.searchsorted(run, run)
        return (np.arange(len(at)) - first) % 2 == 0

    def _rerank(self, symbols: np.ndarray, rank: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        rank[at] = _NONE
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        rank[at] = self.ranks(symbols[at], symbols[at + 1])

    def merge_long(self, word: bytes) -> int:
        """As `merge` for one long word: the places of each rank wait in a bucket, so a round touches only its own."""
        symbols = self.of_byte[np.frombuffer(word, dtype=np.uint8)].copy()
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1 stand for the ends
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        buckets: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank != _NONE], rank[rank != _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.diff(rank, prepend=-1))
            for places, r in zip(np.split(at, edges[1:]), rank[edges].tolist()):
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(queue, r)
                buckets[r].append(places)

        wait(np.arange(n - 1))
        left = n
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(buckets.pop(rank)))
            at = at[alive[at]]
            at = at[after[at] < n]
            at = at[self.ranks(symbols[at], symbols[after[at]]) == rank]
            if not len(at):
                continue
            if self.all_places:
                run = np.cumsum(np.concatenate([[True], after[at[:-1]] != at[1:]]))
                at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            elif len(at) > 1:
                buckets[rank] = [at[1:]]
                heapq.heappush(queue, rank)
                at = at[:1]
            gone = after[at]
            symbols[at] = self.made[rank]
            alive[gone] = False
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            ahead = before[at]
            wait(np.unique(np.concatenate([at, ahead[ahead >= 0]])))
        return left

    def learn(self, words: set[str]) -> None:
        """Put the counts of words not met before into the table."""
        fresh = [w for w in words if w not in self.known]
        if self.known_chars > TABLE_CHARS:
            self.known, self.known_chars, fresh = {}, 0, list(words)
        coded = [w.encode() for w in fresh]
        short = [i for i, w in enumerate(coded) if len(w) <= LONG]
        if short:
            self.known.update(zip([fresh[i] for i in short], self.merge([coded[i] for i in short]).tolist()))
        for w, c in zip(fresh, coded):
            if len(c) > LONG:
                self.known[w] = self.merge_long(c)
        self.known_chars += sum(map(len, fresh))

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if _NOT_PLAIN.search(text) is None:
            return _WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _blocks(self, text: str) -> Iterator[tuple[str, int]]:
        """(block without added tokens, added tokens before it); blocks of a long text are cut between pre-tokens."""
        parts = self.added.split(text) if self.added and self.added.search(text) else [text]
        for i in range(0, len(parts), 2):
            part, at, met = parts[i], 0, int(i > 0)
            while len(part) - at > BLOCK_CHARS and (cut := _CUT.search(part, at + BLOCK_CHARS)):
                yield part[at : cut.start()], met
                at, met = cut.start(), 0
            yield part[at:], met

    def count(self, all_texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        counts = [0] * len(all_texts)
        held: list[tuple[int, list[str]]] = []
        chars = 0

        def settle() -> None:
            self.learn(set().union(*[words for _, words in held]))
            for i, words in held:
                counts[i] += sum(map(self.known.__getitem__, words))
            held.clear()

        for i, text in enumerate(all_texts):
            for block, met in self._blocks(text):
                counts[i] += met
                held.append((i, self.words(block)))
                chars += len(block)
                if chars >= BLOCK_CHARS:
                    settle()
                    chars = 0
        settle()
        return counts


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    """The rules of a vocabulary file, with the table of counts, once per worker process."""
    return RankMerger(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than `limit`).

    Whole texts; null counts as empty and has no tokens. Strings of added tokens inside a text count as one token each.
    Repeated rows come once each, null ids stay null, other columns are left out; equal texts have equal counts, so
    there are no ties to settle. Long texts are read block by block. `path` names a vocabulary file of byte-level BPE
    that every worker has. Row-local: nothing is shuffled, and a task that runs again gives the same rows.
    """
    path = path or public_tokenizers.path(BYTE_BPE)

    def make() -> Callable:
        rules = merger(path)

        def step(doc_ids: list, all_texts: list) -> list[list]:
            counts = rules.count(all_texts)
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in all_texts]
            return [doc_ids, sizes, counts, [n > limit for n in counts]]

        return step

    return map_lists(texts(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@register("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
