"""Packing by minimum bin slack: fixed-size sequences filled with pieces of documents.

Full runs of `capacity` ids leave a document as sequences of their own. What remains of each document is one item; items
of a window are packed bin by bin: the longest item opens the bin and a subset-sum over the multiset of the other
lengths (a bitset: bit s is set if some choice sums to s) finds the choice that fills it closest to capacity. Items of
bins that stay short are strung together and cut at capacity, and the last stretch into powers of two, which need no
padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from .common import register, table, texts

BYTE_BPE = "byte_bpe_50k"
CAPACITY = 1024
#: Id after each document.
END = 0
#: Items packed together; their ids are held in memory meanwhile (at most 4 * capacity bytes each).
WINDOW = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Up to here every library agrees on what is a letter, a number or a space.
_OTHER = re.compile(r"[^\x00-ɏ‐-‧‰-⁞]")


class ByteBpe:
    """Ids as the tokenizers file gives them, by the faster reader of the same vocabulary where both agree for sure."""

    def __init__(self, name: str):
        self.exact = Tokenizer.from_file(public_tokenizers.path(name + ".json"))
        with open(public_tokenizers.path(name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        added = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.added = tuple(added)
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if _OTHER.search(text) or any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)


@lru_cache(maxsize=2)
def byte_bpe(name: str) -> ByteBpe:
    return ByteBpe(name)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most `counts` of each, whose sum is closest to `room` without exceeding it.

    Subset sums as bits of one integer. A length with count c enters as 1, 2, 4 ... and the rest copies of itself, so
    that any number up to c can be made; the sums before each step are kept to trace the choice back.
    """
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((sums, length, copies))
            sums |= (sums << (length * copies)) & mask
            left -= copies
            copies *= 2
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return chosen


def pack_items(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """(full bins as lists of item numbers, the items of bins that stayed short)."""
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    counts = {n: len(v) for n, v in by_length.items()}

    def take(length: int) -> int:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return by_length[length].pop()

    bins, rest = [], []
    while counts:
        longest = max(counts)
        items = [take(longest)]
        chosen = fill(counts, capacity - longest)
        for length, copies in chosen.items():
            items += [take(length) for _ in range(copies)]
        full = longest + sum(n * c for n, c in chosen.items()) == capacity
        (bins.append if full else rest.extend)(items)
    return bins, rest


def stretches(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences that `total` ids are cut into: full ones, then falling powers of two."""
    tail = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1]


class Packer:
    """Packs one task's documents, a window of items at a time; rows of pieces gather in `out`."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, window: int = WINDOW):
        self.next_id, self.capacity, self.window = first_id, capacity, window
        self.items: list[tuple[int | None, int, np.ndarray, int]] = []
        self.out: list[tuple] = []

    def _piece(self, doc_id: int | None, start: int, ids: np.ndarray, total: int, offset: int) -> None:
        self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._piece(doc_id, start, ids[start : start + self.capacity], len(ids), 0)
            self.next_id += 1
        if whole < len(ids):
            self.items.append((doc_id, whole, ids[whole:].copy(), len(ids)))
            if len(self.items) >= self.window:
                self.flush(False)

    def flush(self, last: bool) -> None:
        """Pack the window; items of short bins wait for the next one unless this is the last."""
        bins, rest = pack_items([len(i[2]) for i in self.items], self.capacity)
        for numbers in bins:
            offset = 0
            for doc_id, start, ids, total in (self.items[n] for n in numbers):
                self._piece(doc_id, start, ids, total, offset)
                offset += len(ids)
            self.next_id += 1
        left = [self.items[n] for n in rest]
        if last or len(left) > self.window // 2:
            self._string(left)
            left = []
        self.items = left

    def _string(self, items: list[tuple]) -> None:
        """Items one after the other, cut where sequences end."""
        sizes = iter(stretches(sum(len(i[2]) for i in items), self.capacity))
        room, offset = 0, 0
        for doc_id, start, ids, total in items:
            at = 0
            while at < len(ids):
                if not room:
                    room, offset = next(sizes), 0
                n = min(room, len(ids) - at)
                self._piece(doc_id, start + at, ids[at : at + n], total, offset)
                at, room, offset = at + n, room - n, offset + n
                if not room:
                    self.next_id += 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id; null or empty text is the end id alone. Sequences hold at most `capacity` ids;
    the only ones that are shorter have a power of two as their length. Repeated rows are packed each. Every task packs
    its own documents, so nothing is shuffled, and a task that runs again replaces all pieces of its sequences; the
    sequence ids of a task follow from its partition number.
    """
    struct = T._parse_datatype_string(PIECES)
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, window)
        end = np.array([END], dtype="<u4")

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out)) or [()] * len(out)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, np.concatenate([bpe.encode(text), end]))
            if packer.out:
                yield rows()
        packer.flush(True)
        if packer.out:
            yield rows()

    return texts(docs, id_col, text_col).mapInArrow(run, struct)


@register("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
