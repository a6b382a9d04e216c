"""Cross-tokenizer alignment with spill counting of id pairs.

Two tokenizers cut the same bytes. Offsets where tokens of both end cut a text into groups, and every token of one side
is linked to every token of the other in its group. How many documents hold a pair of ids linked is counted over the
corpus, and each document gets back how its links stand among those counts.

Tasks hold their documents' (pair, document) records up to a bound, sort them side-major - by the first id, then the
second - and hand them on as runs: zstd blocks, one for each radix of the first id. A k-way heap merge of the runs of a
radix counts each pair; all pairs of an id of the first side come together, which gives its maximum. Then the
counts stream past the runs, and what each record contributes is summed per document. Runs of a radix with many
records are dealt over as many splits as its size asks for, so a frequent id does not end in one task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..plans.session import fresh_path
from .common import register, table, texts, written

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Blocks that a run is cut into by the first id.
RADIXES = 64
#: Records held by a task before they leave as a run; a document's records stay in one run.
RUN_RECORDS = 1 << 21
#: Records of a radix that one split takes.
SPLIT_RECORDS = 1 << 24
#: Pairs held by a task before the runs it has read are merged.
MERGE_PAIRS = 1 << 21
#: Characters encoded at a time, where a text can be cut.
BLOCK_CHARS = 1 << 18
#: Tokens of texts that are grouped together; a text is not cut for it.
JOINED_TOKENS = 1 << 16
#: Links of a group above which it is counted by distinct ids.
WIDE_GROUP = 1 << 16

_STATS = ("n_a", "n_b", "n_groups", "n_links")
SPILLED = "run long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, radix int, records long, block binary"
COUNTED = "pair long, n long"
GIVEN_BACK = "run long, doc int, count_sum long, n_best long"

_INT, _LONG, _TEXT, _BYTES = pa.int32(), pa.int64(), pa.string(), pa.binary()
_SPILLED = pa.schema([("run", _LONG), ("doc", _INT), ("doc_id", _LONG), *((c, _LONG) for c in _STATS), ("groups_sha256", _TEXT), ("groups", _TEXT), ("radix", _INT), ("records", _LONG), ("block", _BYTES)])
_COUNTED = pa.schema([("pair", _LONG), ("n", _LONG)])
_GIVEN_BACK = pa.schema([("run", _LONG), ("doc", _INT), ("count_sum", _LONG), ("n_best", _LONG)])

# Up to here every library agrees on what is a letter, a number or a space.
_NOT_PLAIN = re.compile(r"[^\x00-ɏ‐-‧‰-⁞]")
# Neither side has a token that goes on over a blank after one of these.
_CUT = re.compile(r"(?<=[0-9A-Za-z.,])(?= [0-9A-Za-z])")


# --- tokens of one text


class Aligner:
    """Both tokenizers, and the groups of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.exact = Tokenizer.from_file(path_a)
        self.exact.encode_special_tokens = True  # their strings in a text are plain text
        self.fast = _fast_reader(path_a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab = self.exact.get_vocab(with_added_tokens=True)
        back = {s: bytes([b]) for b, s in enumerate(_byte_symbols())}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = b"".join([back.get(c) or c.encode() for c in token])
        b = self.pieces
        self.bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(len(b))]
        self.size_a, self.size_b = (np.array([len(t) for t in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.width = len(self.bytes_b)
        # the digits of each id, with room for the sign after them
        shown = [str(i).encode() for i in range(max(len(self.bytes_a), self.width))]
        self.n_digits = np.array([len(x) for x in shown], dtype=np.int64)
        room = len(shown[-1]) + 1
        self.digits = np.frombuffer(b"".join([x.ljust(room) for x in shown]), np.uint8).reshape(-1, room)
        probe = "ab  cd. ef"
        joins = any(" " in t.decode("utf-8", "replace").lstrip(" ") for t in self.bytes_b)
        self.can_cut = not joins and b"".join([self.bytes_b[i] for i in b.encode(probe)]) == b" " + probe.encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for a blank and the text; the second tokenizer puts the blank there itself. None if a side
        does not say the text byte by byte, or there is no text."""
        if not text:
            return None
        parts_a, ids_b, fast = [], [], self.fast is not None
        for block in self._blocks(text):
            spaced = " " + block
            if self.fast is None or not block.isascii() and _NOT_PLAIN.search(block):
                parts_a.append(np.array(self.exact.encode(spaced, add_special_tokens=False).ids, dtype=np.int64))
                fast = False
            else:
                parts_a.append(self.fast.encode_to_numpy(spaced, disallowed_special=()).astype(np.int64))
            ids_b += self.pieces.encode(block, num_threads=1)
        a, said = np.concatenate(parts_a), b" " + text.encode()
        if b"".join(map(self.bytes_b.__getitem__, ids_b)) != said:
            return None
        # the fast reader gives bytes of the text in their order: all of them, if they are as many
        whole = int(self.size_a[a].sum()) == len(said) if fast else b"".join(map(self.bytes_a.__getitem__, a.tolist())) == said
        return (a, np.array(ids_b, dtype=np.int64)) if whole else None

    def _blocks(self, text: str) -> Iterator[str]:
        """The text cut at blanks where no token of either side crosses; the blank itself is left out."""
        at = 0
        while self.can_cut and len(text) - at > BLOCK_CHARS and (cut := _CUT.search(text, at + BLOCK_CHARS)):
            yield text[at : cut.start()]
            at = cut.start() + 1
        yield text[at:]

    def groups(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, group of each id) of both sides; None where `encode` gives none."""
        found = self.encode(text)
        return found and self.grouped(*found)

    def grouped(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, group of each id) of both sides, which say the same bytes: of one text, or of several joined, as no group
        goes over the end of a text. Every token has bytes."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, dtype=bool)
        ends[ends_a] = True
        shared = ends_b[ends[ends_b]]
        return a, np.searchsorted(shared, ends_a), b, np.searchsorted(shared, ends_b)

    def spell(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups as bytes of `a1,a2|b1;a3|b2,b3;`, and where each token of this order ends in them."""
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids, signs = np.empty(len(a) + len(b), dtype=np.int64), np.empty(len(a) + len(b), dtype=np.uint8)
        ids[at_a], ids[at_b] = a, b
        signs[at_a], signs[at_b] = np.where(_ends(group_a), ord("|"), ord(",")), np.where(_ends(group_b), ord(";"), ord(","))
        said, n = self.digits[ids], self.n_digits[ids]
        said[np.arange(len(ids)), n] = signs
        return said[np.arange(said.shape[1]) <= n[:, None]], np.cumsum(n + 1)

    def links_of_texts(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, edges_a: np.ndarray, edges_b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """What `links` gives for each of several texts joined; text i has the tokens edges[i] to edges[i + 1] of a side."""
        if not len(a):
            return [(a, a)] * (len(edges_a) - 1)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        if (in_a * in_b > WIDE_GROUP).any():
            sides = (zip(e, e[1:]) for e in (edges_a.tolist(), edges_b.tolist()))
            return [self.links(a[i:j], group_a[i:j] - group_a[i], b[m:n], group_b[m:n] - group_b[m]) if i < j else (a[:0], a[:0]) for (i, j), (m, n) in zip(*sides)]
        partners = in_b[group_a]
        before = np.cumsum(partners) - partners
        at = np.arange(partners.sum()) + np.repeat((np.cumsum(in_b) - in_b)[group_a] - before, partners)
        span = len(self.bytes_a) * self.width
        text = np.repeat(np.arange(len(edges_a) - 1), np.diff(edges_a))
        found, times = np.unique(np.repeat(text * span + a * self.width, partners) + b[at], return_counts=True)
        edges = np.searchsorted(found, np.arange(len(edges_a)) * span).tolist()
        pairs = found % span
        return [(pairs[i:j], times[i:j]) for i, j in zip(edges, edges[1:])]

    def links(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, number of links of each): a pair is its first id times the width of the second side, plus its second id."""
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        first_b = np.cumsum(in_b) - in_b
        wide = in_a * in_b > WIDE_GROUP
        plain = ~wide[group_a]
        some, partners = a[plain], in_b[group_a[plain]]
        before = np.cumsum(partners) - partners
        at = np.arange(partners.sum()) + np.repeat(first_b[group_a[plain]] - before, partners)
        found = [np.unique(np.repeat(some, partners) * self.width + b[at], return_counts=True)]
        for g in np.flatnonzero(wide):
            ids_a, times_a = np.unique(a[group_a == g], return_counts=True)
            ids_b, times_b = np.unique(b[group_b == g], return_counts=True)
            found.append(((ids_a[:, None] * self.width + ids_b).ravel(), (times_a[:, None] * times_b).ravel()))
        if len(found) == 1:
            return found[0]
        pairs, back = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        times = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(times, back, np.concatenate([t for _, t in found]))
        return pairs, times


def _ends(group: np.ndarray) -> np.ndarray:
    """Which tokens are the last of their group."""
    return np.diff(group, append=-1) != 0


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _fast_reader(path: str) -> tiktoken.Encoding | None:
    """A faster reader of the same vocabulary, if its file of ranks lies beside."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as f:
        found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """Both tokenizers, once per worker process."""
    return Aligner(path_a, path_b)


# --- runs


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, each in as few bytes as it needs, as one zstd block."""
    parts = []
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(c) or int(c.max()) < 1 << (8 * w))
        parts += [struct.pack("<QB", len(c), width), c.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(block: bytes) -> list[np.ndarray]:
    data, at, columns = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(data):
        n, width = struct.unpack_from("<QB", data, at)
        columns.append(np.frombuffer(data, dtype=f"<u{width}", count=n, offset=at + 9).astype(np.int64))
        at += 9 + n * width
    return columns


def _block_pairs(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pairs in rising order, documents of each)."""
    steps, documents, *_ = _unpack(block)
    return np.cumsum(steps), documents


def _block_records(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, documents of each pair, and of each record its document in the run and its links)."""
    steps, documents, docs, times = _unpack(block)
    return np.cumsum(steps), documents, docs, times


def _run_blocks(held: list[tuple[int, np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[int, int, bytes]]:
    """(radix, records, block) of the held records (document, pairs, links), sorted by radix and pair."""
    pairs = np.concatenate([p for _, p, _ in held])
    docs = np.repeat([d for d, _, _ in held], [len(p) for _, p, _ in held])
    times = np.concatenate([t for _, _, t in held])
    order = np.argsort(pairs, kind="stable")  # documents stay in rising order within a pair
    pairs, docs, times = pairs[order], docs[order], times[order]
    radix = pairs // width % RADIXES
    for r in range(RADIXES):
        mine = np.flatnonzero(radix == r)
        if len(mine):
            own, documents = np.unique(pairs[mine], return_counts=True)
            yield r, len(mine), _pack(np.diff(own, prepend=0), documents, docs[mine], times[mine])


def _joined(both: Aligner, batch: pa.RecordBatch) -> Iterator[Iterator[tuple]]:
    """(doc_id, numbers of `_STATS`, groups as text, pairs, links of each) of the documents of a batch, in parts: numpy
    takes the tokens of as many documents at once as have JOINED_TOKENS."""
    none = np.empty(0, dtype=np.int64)
    ids: list = []
    tokens: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        ids.append(doc_id)
        tokens.append(both.encode(text) or (none, none))
        size += len(tokens[-1][0]) + len(tokens[-1][1])
        if size >= JOINED_TOKENS:
            yield _of_part(both, ids, tokens)
            ids, tokens, size = [], [], 0
    if ids:
        yield _of_part(both, ids, tokens)


def _of_part(both: Aligner, ids: list, tokens: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    edges_a, edges_b = (np.cumsum([0, *(len(t[side]) for t in tokens)]) for side in (0, 1))
    found = both.grouped(*(np.concatenate([t[side] for t in tokens]) for side in (0, 1)))
    links = both.links_of_texts(*found, edges_a, edges_b)
    said, ends = both.spell(*found)
    places = np.concatenate([[0], ends])[edges_a + edges_b].tolist()
    groups = np.concatenate([[0], found[1] + 1])[edges_a].tolist()  # groups up to each edge; texts end with a group
    for i, (doc_id, (a, b), (pairs, times)) in enumerate(zip(ids, tokens, links)):
        stats = len(a), len(b), groups[i + 1] - groups[i], int(times.sum())
        yield doc_id, stats, said[places[i] : max(places[i + 1] - 1, places[i])], pairs, times


def _spill(path_a: str, path_b: str, keep_groups: bool, run_records: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents and rows of runs, told apart by `radix`."""
        both = aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        doc = records = 0

        def leave() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(_SPILLED)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPILLED)], schema=_SPILLED)

        def close_run() -> None:
            rows.extend((number, *[None] * 8, r, n, block) for r, n, block in (_run_blocks(held, both.width) if held else ()))
            held.clear()

        for batch in batches:
            for part in _joined(both, batch):
                for doc_id, stats, said, pairs, times in part:
                    spelt = said.tobytes()
                    sha256 = hashlib.sha256(spelt).hexdigest() if stats[0] else ""
                    rows.append((number, doc, doc_id, *stats, sha256, spelt.decode() if keep_groups else None, None, None, None))
                    if stats[0]:
                        held.append((doc, pairs, times))
                        records += len(pairs)
                    doc += 1
                    if records >= run_records:
                        close_run()
                        yield leave()
                        number, doc, records = number + 1, 0, 0
            yield leave()
        close_run()
        yield leave()

    return run


# --- counting and giving back


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of documents of each pair in the runs of a task: per radix, a heap merge of its runs."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merge() -> Iterator[pa.RecordBatch]:
        for r in sorted(held):
            runs = [zip(pairs.tolist(), documents.tolist()) for pairs, documents in held[r]]
            counts = [(pair, sum(n for _, n in same)) for pair, same in groupby(heapq.merge(*runs, key=itemgetter(0)), key=itemgetter(0))]
            yield pa.RecordBatch.from_arrays([pa.array(c, _LONG) for c in zip(*counts)], schema=_COUNTED)
        held.clear()

    for batch in batches:
        for radix, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            pairs, documents = _block_pairs(block)
            held.setdefault(radix, []).append((pairs, documents))
            size += len(pairs)
        if size >= MERGE_PAIRS:
            yield from merge()
            size = 0
    yield from merge()


def pair_counts(runs: DataFrame, width: int) -> DataFrame:
    """(id_a, pair, n, best): how many documents hold a pair, and whether no pair of its first id is held by more.

    Tasks merge the runs they read, so only one row per pair and task is shuffled. The pairs of an id are at most as
    many as the second vocabulary has tokens.
    """
    counted = runs.select("radix", "block").mapInArrow(_merged, COUNTED).groupBy("pair").agg(F.sum("n").alias("n"))
    of_id = counted.withColumn("id_a", F.floor(F.col("pair") / width).cast("int"))
    return of_id.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("id_a")))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the records of each run contribute to its documents; the counts of a cell come before its runs."""
    cell = None
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cells = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if cells[lo] != cell:
                cell, parts = cells[lo], []
            rows = batch.slice(lo, hi - lo)
            n_counts = rows.column(2).null_count  # rows of counts have no block, and stand first
            if n_counts:
                parts.append(tuple(rows.column(c).slice(0, n_counts).to_numpy(zero_copy_only=False) for c in (3, 4, 5)))
            if n_counts == len(rows):
                continue
            if len(parts) > 1:
                parts = [tuple(np.concatenate(c) for c in zip(*parts))]
            pair, n, best = parts[0]
            for run, block in zip(rows.column(1).slice(n_counts).to_pylist(), rows.column(2).slice(n_counts).to_pylist()):
                pairs, documents, docs, times = _block_records(block)
                at = np.searchsorted(pair, pairs)
                sums = np.zeros((2, int(docs.max()) + 1), dtype=np.int64)
                np.add.at(sums[0], docs, times * np.repeat(n[at].astype(np.int64), documents))
                np.add.at(sums[1], docs, times * np.repeat(best[at].astype(np.int64), documents))
                some = np.flatnonzero(sums[0])
                columns = [np.full(len(some), run), some.astype(np.int32), sums[0][some], sums[1][some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GIVEN_BACK)], schema=_GIVEN_BACK)


def contributions(runs: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(run, doc, count_sum, n_best): per document, the counts of its links summed, and its links of best count."""
    splits = F.ceil(F.sum("records") / SPLIT_RECORDS).cast("int").alias("splits")
    sizes = written(runs.groupBy("radix").agg(splits), "alignment-splits")  # one row per radix
    cell = (F.col("radix").cast("long") * 2**32 + F.col("split")).alias("cell")
    none = F.lit(None)
    of_runs = runs.join(F.broadcast(sizes), "radix").withColumn("split", F.pmod(F.xxhash64("run"), F.col("splits")))
    of_counts = counts.withColumn("radix", (F.col("id_a") % RADIXES)).join(F.broadcast(sizes), "radix").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    rows = of_counts.select(cell, none.cast("long").alias("run"), none.cast("binary").alias("block"), "pair", "n", "best").unionByName(
        of_runs.select(cell, "run", "block", none.cast("long").alias("pair"), none.cast("long").alias("n"), none.cast("boolean").alias("best"))
    )
    dealt = rows.repartition("cell").sortWithinPartitions("cell", F.col("block").isNotNull(), "pair")
    return dealt.mapInArrow(_contributions, GIVEN_BACK).groupBy("run", "doc").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def spilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False, run_records: int = RUN_RECORDS) -> tuple[DataFrame, DataFrame, int]:
    """(rows of documents, rows of runs, width of the second vocabulary), read from one written table."""
    path_a, path_b = path_a or public_tokenizers.path(SIDE_A), path_b or public_tokenizers.path(SIDE_B)
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "alignment")
    texts(docs, id_col, text_col).mapInArrow(_spill(path_a, path_b, keep_groups, run_records), SPILLED).write.parquet(path)
    rows = spark.read.schema(SPILLED).parquet(path)
    of_docs = rows.filter(F.col("radix").isNull()).select("run", "doc", "doc_id", *_STATS, "groups_sha256", *["groups"] * keep_groups)
    return of_docs, rows.filter(F.col("radix").isNotNull()).select("run", "radix", "records", "block"), aligner(path_a, path_b).width


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False, run_records: int = RUN_RECORDS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups (text) if asked for.

    Whole texts. A text that is null, empty, or not said byte by byte by both tokenizers has no tokens: zeros and ''.
    Repeated rows are documents of their own and count each; pairs that tie for an id's highest count are all best. Long
    texts are encoded block by block, cut where no token crosses. Other columns are left out; null ids stay null.
    `path_a` names a file of byte-level BPE, `path_b` a sentencepiece model that puts a blank in front; every worker has
    both.
    """
    of_docs, runs, width = spilled(docs, id_col, text_col, path_a, path_b, keep_groups, run_records)
    counts = written(pair_counts(runs, width), "alignment-counts")
    back = contributions(runs, counts, width)
    of_link = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return of_docs.join(back, ["run", "doc"], "left").select("doc_id", *_STATS, *of_link, "groups_sha256", *["groups"] * keep_groups)


@register("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
