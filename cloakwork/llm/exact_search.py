"""Exact top-k search by vector approximation: scan quantised cells for bounds, then read exact vectors until certain.

Vectors travel in blocks. A block holds each component's cell on the block's own grid (1 byte) and, in the narrowest type,
how far the component lies above the cell's corner: both together are the exact whole-number vector. A query's product with
the cells' corners bounds every exact score from below and above; exact vectors are then read by falling upper bound until
the kth score found exceeds every bound that is left.

Groups of queries meet shares of the candidates, each pair in a task of its own that holds the group and lets the share
stream by. No row of either goes through the driver, and neither is copied more often than the other side needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.session import spread
from .common import pick, register, table, written

K = 5
#: Cells per component: 2**CELL_BITS, at most one byte.
CELL_BITS = 6
#: Candidates and queries that are multiplied at a time, as soon as there are as many.
CANDIDATE_ROWS = 4096
QUERY_ROWS = 512
#: Exact vectors read at first, for each query; and components of pairs of exact vectors in memory at a time.
READ = 32
PAIR_COMPONENTS = 1 << 22
#: Most cells of a block, unless one vector has more: blocks are rows, and many rows are in memory at once.
BLOCK_CELLS = 1 << 15
#: Components of a group of queries, about; each of the k best counts as BEST of them.
GROUP_COMPONENTS = 1 << 24
BEST = 8
#: Hits given out at a time.
OUT_ROWS = 1 << 16
#: Whole numbers below these are exact in a float32 and a float64, with room for one more bit.
EXACT32, EXACT64 = 2.0**23, 2.0**52

_BLOCK = "share_of long, dim int, kind int, ids binary, keys binary, cells binary, above binary, low binary, width binary"
_HIT = "query_id long, q_key long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<long>): floor(256 * x) of each component. Rows without id or vector, and vectors holding
    null or non-finite components or none at all, take no part."""
    rows = spread(pick(vectors, vec_id=id_col, v=vector_col))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(finite)
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x * 256)).cast("array<long>").alias("v"))


def approximate(exact: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, low, width): component j of a vector in cell c lies in [low[j] + c * width[j], low[j] + (c + 1) * width[j])."""
    low = exact.min(axis=0)
    apart = (exact - low).astype(np.uint64)  # right for any two longs
    width = apart.max(axis=0) // np.uint64(1 << bits) + np.uint64(1)
    return (apart // width).astype(np.uint8), low, width.astype(np.int64)


def _narrow(whole: np.ndarray, kinds: str) -> np.ndarray:
    """The same whole numbers in the first of the types that holds them all."""
    least, most = (int(whole.min()), int(whole.max())) if whole.size else (0, 0)
    return whole.astype(next(t for t in kinds if np.iinfo(t).min <= least and most <= np.iinfo(t).max))


def cut(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, above, low, width): `approximate`, and how far each component lies above its cell's corner."""
    cells, low, width = approximate(exact)
    return cells, _narrow(exact - (low + cells.astype(np.int64) * width), "BHIQ"), low, width


def _matrix(data: bytes | pa.Buffer, rows: int, dim: int, sign: str) -> np.ndarray:
    """What `_narrow` made, from its bytes."""
    return np.frombuffer(data, f"{sign}{len(memoryview(data)) // (rows * dim)}").reshape(rows, dim)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The product of row i[n] of `a` with row j[n] of `b` for each n, whose rows are brought together for some n at a time."""
    out, some = np.empty(len(i), np.int64), max(1, PAIR_COMPONENTS // a.shape[1])
    for at in range(0, len(i), some):
        out[at : at + some] = np.einsum("ij,ij->i", a[i[at : at + some]], b[j[at : at + some]])
    return out


class Group:
    """Queries of one length, and the k best candidates so far of each; equal scores to smaller ids."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.keys, self.vectors, self.k = ids[order], keys[order], vectors[order], k
        self.found = np.zeros(len(ids), np.int64)
        self.best_ids, self.scores = (np.zeros((len(ids), k), np.int64) for _ in range(2))
        self.rooms: dict[type, np.ndarray] = {}

    def _room(self, kind: type, rows: int, columns: int) -> np.ndarray:
        """A matrix to write into, the same memory each time: new pages take as long as a good part of the product."""
        if kind not in self.rooms or self.rooms[kind].size < rows * columns:
            self.rooms[kind] = np.empty(rows * columns, kind)
        return self.rooms[kind][: rows * columns].reshape(rows, columns)

    def search(self, blocks: list[tuple[np.ndarray, ...]]) -> None:
        """Take in candidates: (ids, cells, above, low, width) of each block."""
        ids = np.concatenate([b[0] for b in blocks])
        corners = [low + cells.astype(np.int64) * width for _, cells, _, low, width in blocks]
        exact = np.concatenate([c + above.astype(np.int64) for c, (_, _, above, _, _) in zip(corners, blocks)])
        corners = np.concatenate(corners)
        wide = np.stack([width - 1 for *_, width in blocks]).astype(np.float64)
        edges = np.cumsum([0] + [len(b[0]) for b in blocks])
        reach = max(np.abs(corners.astype(np.float64)).max() + wide.max() + 1, 1.0)
        first, last = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        as_type = {}
        for at in range(0, len(self.ids), QUERY_ROWS):
            queries = self.vectors[at : at + QUERY_ROWS]
            largest = np.abs(queries.astype(np.float64)).sum(axis=1) * reach
            kind = np.float32 if largest.max() < EXACT32 else np.float64
            if kind not in as_type:
                as_type[kind] = np.ascontiguousarray(corners.astype(kind).T), exact.astype(kind), wide.astype(kind)
            # a query's own rows are none of its candidates
            n = len(queries)
            a, b = np.clip(first - at, 0, n), np.clip(last - at, 0, n)
            has = np.flatnonzero(b > a)
            times = (b - a)[has]
            own = np.repeat(a[has] - np.cumsum(times) + times, times) + np.arange(times.sum()), np.repeat(has, times)
            self._meet(at, queries, largest, ids, edges, exact, own, *as_type[kind])

    def _meet(self, at: int, queries: np.ndarray, largest: np.ndarray, ids: np.ndarray, edges: np.ndarray, exact: np.ndarray, own: tuple, corners: np.ndarray, near_exact: np.ndarray, wide: np.ndarray) -> None:
        q = queries.astype(corners.dtype)
        score = np.matmul(q, corners, out=self._room(corners.dtype.type, len(q), len(ids)))
        score[own] = -np.inf
        above, below = np.maximum(q, 0) @ wide.T, np.minimum(q, 0) @ wide.T
        # products of whole numbers are exact below EXACT64; beyond that the bounds are widened by what may be lost
        slip = np.where(largest < EXACT64, 0.0, largest * max(2.0**-44, (len(corners) + 8) * 2.0**-52))
        block = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        kth = self._kth(at, len(q))
        if len(few := np.flatnonzero(kth == -np.inf)) and len(ids) >= self.k:
            # the kth best lower bound: whatever cannot reach it is out
            lower = score[few] + below[few][:, block]
            kth[few] = np.partition(lower, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - slip[few]
        alike = (wide.max(axis=0) <= 2 * wide.min(axis=0) + 1).all()  # then one comparison does for all blocks
        needed = kth[:, None] - (above.max(axis=1, keepdims=True) if alike else above) - slip[:, None]
        if score.dtype == np.float32:  # no score is as large as EXACT32
            needed = np.clip(needed, -2 * EXACT32, 2 * EXACT32).astype(np.float32)
        reaches = self._room(np.bool_, len(q), -(-len(ids) // 8) * 8)
        reaches[:, len(ids) :] = False
        for b, (start, stop) in enumerate([(0, len(ids))] if alike else zip(edges[:-1], edges[1:])):
            np.greater_equal(score[:, start:stop], needed[:, b, None], out=reaches[:, start:stop])
        # few do: looked for in eights
        eights = np.flatnonzero(reaches.view(np.uint64))
        which, j = np.nonzero(reaches.reshape(-1, 8)[eights])
        i, j = np.divmod(eights[which] * 8 + j, reaches.shape[1])
        bound = score[i, j].astype(np.float64) + above[i, block[j]] + slip[i]
        there = (bound >= kth[i]) & (bound > -np.inf) & self._may_enter(at, i, ids[j], bound)
        i, j, bound = i[there], j[there], bound[there]
        order = np.lexsort((ids[j], -bound, i))
        i, j, bound = i[order], j[order], bound[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        exactly = (q, near_exact) if not slip.any() else (queries.astype(np.int64), exact)
        end = 0
        while len(i):
            end = 2 * end or READ  # by more each time: many may score alike
            now = place < end
            q_now, c_now = i[now], j[now]
            self._take(at, q_now, ids[c_now], _products(*exactly, q_now, c_now))
            left = ~now
            left[left] = self._may_enter(at, i[left], ids[j[left]], bound[left])
            i, j, bound, place = i[left], j[left], bound[left], place[left]

    def _kth(self, at: int, n: int) -> np.ndarray:
        """The kth best scores so far; -inf where fewer are found."""
        return np.where(self.found[at : at + n] == self.k, self.scores[at : at + n, self.k - 1], -np.inf)

    def _may_enter(self, at: int, i: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether candidates with these bounds can be among the best so far of the queries `at + i`."""
        i = i + at
        kth = self.scores[i, -1]
        return (self.found[i] < self.k) | (bound > kth) | (bound == kth) & (ids < self.best_ids[i, -1])

    def _take(self, at: int, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge scored candidates of the queries `at + i` into their best."""
        who = np.unique(i) + at
        had = np.arange(self.k) < self.found[who][:, None]
        i = np.concatenate([i + at, np.repeat(who, self.found[who])])
        ids = np.concatenate([ids, self.best_ids[who][had]])
        scores = np.concatenate([scores, self.scores[who][had]])
        order = np.lexsort((ids, ~scores, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < self.k
        self.best_ids[i[kept], place[kept]], self.scores[i[kept], place[kept]] = ids[order][kept], scores[order][kept]
        self.found[who] = np.minimum(np.bincount(i - at, minlength=who[-1] - at + 1)[who - at], self.k)

    def hits(self) -> Iterator[list[np.ndarray]]:
        """Columns of query id, query key, id and score."""
        rows = max(1, OUT_ROWS // self.k)
        for at in range(0, len(self.ids), rows):
            some = slice(at, at + rows)
            n, has = self.found[some], np.arange(self.k) < self.found[some][:, None]
            yield [np.repeat(self.ids[some], n), np.repeat(self.keys[some], n), self.best_ids[some][has], self.scores[some][has]]


def _by_length(batch: pa.RecordBatch, split: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(part of `split`, length, numbers of rows, their vectors as a matrix), some rows at a time."""
    lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64)
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for part, dim in sorted(set(zip(split.tolist(), lengths.tolist()))):
        rows = np.flatnonzero((lengths == dim) & (split == part))
        most = min(CANDIDATE_ROWS, max(1, BLOCK_CELLS // dim))
        for at in range(0, len(rows), most):
            some = rows[at : at + most]
            yield part, dim, some, values[starts[some][:, None] + np.arange(dim)]


def _blocks(rows: DataFrame, queries: bool) -> DataFrame:
    """Rows of `_BLOCK`. Of queries (kind 0) `share_of` is their group, `keys` and `cells` hold keys and vectors; of
    candidates (kind 1) `share_of` is to be dealt to shares, `cells` and `above` make the vectors with `low` and `width`."""
    out = to_arrow_schema(T._parse_datatype_string(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            split = batch.column("part").to_numpy() if queries else np.zeros(len(ids), np.int64)
            made = []
            for part, dim, some, exact in _by_length(batch, split):
                if queries:
                    keys = batch.column("q_key").to_numpy()[some]
                    made.append((part, dim, 0, ids[some].tobytes(), keys.tobytes(), _narrow(exact, "bhiq").tobytes(), b"", b"", b""))
                else:
                    made.append((0, dim, 1, ids[some].tobytes(), b"", *(a.tobytes() for a in cut(exact))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*made)) or [[]] * len(out), out)], schema=out)

    return rows.mapInArrow(run, _BLOCK)


def _meet_in_tasks(met: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each task, from rows (tile, dim, kind, ...) in this order."""
    out = to_arrow_schema(T._parse_datatype_string(_HIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, group, waiting = None, [], None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if group:
                if waiting:
                    group.search(waiting)
                for columns in group.hits():
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

        for batch in batches:
            names = batch.schema.names
            for row in range(batch.num_rows):
                here = {name: batch.column(n)[row] for n, name in enumerate(names)}
                tile, dim, kind = (here[c].as_py() for c in ("tile", "dim", "kind"))
                if (tile, dim) != at:
                    yield from finish()
                    at, asked, group, waiting = (tile, dim), [], None, []
                if kind and not asked and not group:
                    continue
                ids = np.frombuffer(here["ids"].as_buffer(), np.int64)
                cells = here["cells"].as_buffer()
                if not kind:
                    # copied: what waits must not keep the whole batch
                    asked.append((ids.copy(), np.frombuffer(here["keys"].as_buffer(), np.int64).copy(), _matrix(cells, len(ids), dim, "i").copy()))
                    continue
                if not group:
                    group = Group(*(np.concatenate(c) for c in zip(*asked)), k)
                    asked = []
                low, width = (np.frombuffer(here[c].as_buffer(), np.int64) for c in ("low", "width"))
                waiting.append((ids, _matrix(cells, len(ids), dim, "u"), _matrix(here["above"].as_buffer(), len(ids), dim, "u"), low, width))
                if sum(len(b[0]) for b in waiting) >= CANDIDATE_ROWS:
                    group.search(waiting)
                    waiting = []
        yield from finish()

    return met.mapInArrow(run, _HIT)


def exact_top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every row whose id satisfies `is_query`: query_id, rank (from 1), vec_id, score of its k best other rows.

    Scores are inner products of the whole-number vectors (they must fit a long); ties go to smaller ids. Rows with the
    query's own id are its own. A query row that is repeated counts once; repeated candidates count each. Vectors of
    different lengths have no score together. Fewer than k rows: all of them. Other columns are left out.

    Every group of queries meets every share of the candidates in a task. A group is as large as a task can hold, as the
    candidates are copied for each; there are as many shares as copy the queries no more than the candidates are copied, or
    as give each core work.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_col, vector_col)
    asked = whole.filter(is_query(F.col("vec_id"))).select("vec_id", "v").distinct()
    asked = written(asked.withColumn("q_key", F.xxhash64("vec_id", "v")), "search-queries")
    n, components = asked.agg(F.count("*"), F.sum(F.size("v").cast("long") + BEST * k)).first()
    groups = max(1, -(-(components or 0) // GROUP_COMPONENTS))
    even = vectors.count() * groups // max(1, 2 * n)
    shares = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(even, -(-2 * spark.sparkContext.defaultParallelism // groups))))
    questions = _blocks(asked.withColumn("part", F.pmod("q_key", F.lit(groups))), True)
    questions = questions.withColumn("tile", F.explode(F.sequence(F.col("share_of") * shares, F.col("share_of") * shares + (shares - 1))))
    blocks = _blocks(whole, False).withColumn("share_of", F.pmod(F.xxhash64("ids", "cells", "above"), F.lit(shares)))
    blocks = blocks.withColumn("tile", F.explode(F.sequence(F.col("share_of"), F.col("share_of") + (groups - 1) * shares, F.lit(shares).cast("long"))))
    met = questions.unionByName(blocks).drop("share_of").withColumn("tile", F.col("tile").cast("int"))
    met = met.repartitionById(groups * shares, "tile").sortWithinPartitions("tile", "dim", "kind")
    hits = _meet_in_tasks(met, k)
    best = W.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")


_SQL = f"""
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= {K}"""


@register("op4_exact_search", _SQL)
def op4_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)
