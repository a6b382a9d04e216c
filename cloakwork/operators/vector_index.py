"""A stored index over vectors: trained cells, quantised residuals, exact re-ranking.

A vector is kept as the cell it falls into and one byte for every few of its remaining components, a thirtieth of its
bytes or less. A search ranks all codes of the question's organisation (or those of its nearest cells), takes a fixed
number of candidates per question, and reads exact vectors of these alone. Cells and code words are learnt once, on a
bounded sample; rows are appended part by part afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import TOP_K
from ..functions.vectors import cosine
from ..plans.session import fresh_path
from ..plans.sizing import broadcast_if_small
from . import rag
from .rag import BLOCK_ROWS, bounded_k

#: Vectors that cells and code words are learnt from.
SAMPLE = 16_384
#: Most cells of an index; code words of a group of components.
MAX_CELLS, WORDS = 1024, 256
#: Components that share a byte.
WIDTH = 4
#: Exact vectors read per hit asked for.
CANDIDATES = 6
#: Buckets of organisations in the folder of a part.
ORG_BUCKETS = 16
_ROUNDS = 8


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centres; one that loses all its vectors stays where it is."""
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(_ROUNDS):
        near = _nearest(x, centres)
        order = np.argsort(near, kind="stable")
        used, starts, sizes = np.unique(near[order], return_index=True, return_counts=True)
        centres[used] = np.add.reduceat(x[order], starts, axis=0) / sizes[:, None]
    return centres


class Quantizer(NamedTuple):
    """centres: (cells, dim). words: (groups, code words, width), for residuals filled up with zeros."""

    dim: int
    centres: np.ndarray
    words: np.ndarray

    @classmethod
    def learnt(cls, vectors: np.ndarray, cells: int, width: int = WIDTH) -> Quantizer:
        """From unit vectors; without any, the quantizer of no vector."""
        n, dim = vectors.shape
        if not n or not dim:
            return cls(0, np.zeros((1, 0), np.float32), np.zeros((0, 1, width), np.float32))
        rng = np.random.default_rng(0)
        x = vectors.astype(np.float32)
        centres = _kmeans(x, cells, rng)
        groups = cls._groups(x - centres[_nearest(x, centres)], width)
        books = [_kmeans(np.ascontiguousarray(groups[:, g]), WORDS, rng) for g in range(groups.shape[1])]
        return cls(dim, centres, np.stack(books))

    @staticmethod
    def _groups(residuals: np.ndarray, width: int) -> np.ndarray:
        filled = np.pad(residuals, ((0, 0), (0, -residuals.shape[1] % width)))
        return filled.reshape(len(filled), -1, width)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, codes) of unit vectors."""
        x = unit.astype(np.float32)
        cells = _nearest(x, self.centres)
        groups = self._groups(x - self.centres[cells], self.words.shape[2])
        codes = [_nearest(np.ascontiguousarray(groups[:, g]), words) for g, words in enumerate(self.words)]
        return cells, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        rest = self.words[np.arange(len(self.words)), codes].reshape(len(codes), -1)[:, : self.dim]
        return self.centres[cells] + rest


class VectorIndex:
    """An index in a folder: `quantizer/`, and `codes/part=<name>/` per append.

    Vectors that are null, of another length than most of the sample, without a direction or not finite are not in it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/quantizer").first()
        centres = np.frombuffer(row["centres"], np.float32).reshape(row["cells"], row["dim"])
        self.quantizer = Quantizer(row["dim"], centres, np.frombuffer(row["words"], np.float32).reshape(row["groups"], row["n_words"], row["width"]))
        self.org_type = row["org_type"]

    @classmethod
    def create(cls, chunks: DataFrame, path: str, cells: int | None = None, width: int = WIDTH) -> VectorIndex:
        """Learn an index from at most SAMPLE of `chunks` (chunk_id, org_id, embedding), picked by the hash of their ids.
        It holds no rows yet. Cells: the root of the number of chunks, MAX_CELLS at most."""
        spark, path = chunks.sparkSession, path.rstrip("/")
        some = chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        n = some.count()
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(n, 1)) * (1 << 30)
        picked = some.filter(part).select("embedding").limit(SAMPLE).toPandas()["embedding"]
        dim = int(picked.map(len).mode().iloc[0]) if len(picked) else 0
        vectors = [v for v in picked if len(v) == dim]
        unit = rag._unit(np.array(vectors, dtype=np.float64).reshape(len(vectors), dim))
        q = Quantizer.learnt(unit[np.isfinite(unit).all(axis=1)], cells or min(MAX_CELLS, max(1, math.isqrt(n))), width)
        org_type = chunks.schema["org_id"].dataType.simpleString()
        line = (q.dim, len(q.centres), q.centres.tobytes(), *q.words.shape, q.words.tobytes(), org_type)
        names = "dim int, cells int, centres binary, groups int, n_words int, width int, words binary, org_type string"
        spark.createDataFrame([line], names).coalesce(1).write.mode("error").parquet(f"{path}/quantizer")
        return cls(spark, path)

    def append(self, chunks: DataFrame, part: str) -> None:
        """Add chunks as the part of that name; done again, the part is replaced. A chunk that comes in several parts is
        found once, and its score is that of the vector the search is given."""
        schema = T.StructType.fromDDL(f"org_id {self.org_type}, chunk_id bigint, cell int, code binary")
        model = self.spark.sparkContext.broadcast(self.quantizer)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = model.value
            for frame in frames:
                fits = frame[frame["embedding"].map(len) == (q.dim or None)]
                if not len(fits):
                    continue
                unit = rag._unit(np.array([list(v) for v in fits["embedding"]], dtype=np.float64))
                whole = np.isfinite(unit).all(axis=1)
                if not whole.any():
                    continue
                cells, codes = q.encode(unit[whole])
                yield fits[whole][["org_id", "chunk_id"]].assign(cell=cells.astype(np.int32), code=[c.tobytes() for c in codes])

        slim = chunks.filter(F.col("embedding").isNotNull()).select("org_id", F.col("chunk_id").cast("bigint"), "embedding")
        folder = F.pmod(F.xxhash64(F.col("org_id").cast("string")), F.lit(ORG_BUCKETS)).cast("int")
        laid = slim.mapInPandas(run, schema).withColumn("folder", folder).hint("rebalance", F.col("folder"))
        laid.sortWithinPartitions("folder", "org_id", "cell").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/codes/part={part}")

    def codes(self) -> DataFrame:
        """(org_id, chunk_id, cell, code) of all parts."""
        schema = f"org_id {self.org_type}, chunk_id bigint, cell int, code binary, folder int, part string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/codes").drop("folder", "part")

    def _blocks(self, keys: list[str]) -> DataFrame:
        """Codes in blocks per key, within each Arrow batch: cells as four bytes each, then the codes."""
        codes, dim = self.codes(), self.quantizer.dim
        schema = T.StructType([*[f for f in codes.schema.fields if f.name in keys], *rag._BLOCK])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for key, g in frame.groupby(keys, sort=False):
                    for at in range(0, len(g), BLOCK_ROWS):
                        b = g.iloc[at : at + BLOCK_ROWS]
                        rows.append((*key, b["chunk_id"].tolist(), dim, b["cell"].to_numpy(np.int32).tobytes() + b"".join(b["code"])))
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

        return codes.mapInPandas(run, schema)

    def _dealt(self, blocks: DataFrame, probe: float) -> DataFrame:
        """Blocks of questions, each question dealt to the `probe` of all cells closest to it."""
        schema = T.StructType([blocks.schema["org_id"], T.StructField("cell", T.IntegerType()), *rag._BLOCK])
        model = self.spark.sparkContext.broadcast(self.quantizer.centres)
        dim = self.quantizer.dim

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            near = max(1, math.ceil(probe * len(model.value)))
            for frame in frames:
                rows = []
                for r in frame[frame["dim"] == dim].itertuples(index=False):
                    unit, ids = rag._matrix(r.data, r.dim), np.asarray(r.ids)
                    order = np.argsort(-np.nan_to_num(unit @ model.value.T), axis=1, kind="stable")[:, :near]
                    for cell in np.unique(order):
                        of = np.flatnonzero((order == cell).any(axis=1))
                        rows.append((r.org_id, int(cell), ids[of].tolist(), r.dim, unit[of].tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=schema.names)

        return blocks.mapInPandas(run, schema)

    def candidates(self, queries: DataFrame, n: int, probe: float = 1.0) -> DataFrame:
        """(query_id, chunk_id): per question the n chunks of its organisation whose codes score highest."""
        model = self.spark.sparkContext.broadcast(self.quantizer)

        def vectors(block) -> np.ndarray:
            q, rows = model.value, len(block.ids)
            codes = np.frombuffer(block.data, np.uint8, offset=4 * rows).reshape(rows, len(q.words))
            return q.decode(np.frombuffer(block.data, np.int32, rows), codes)

        asked = rag.pack(queries, "query_id", "embedding", ["org_id"])
        keys = ["org_id"]
        if probe < 1:
            keys, asked = ["org_id", "cell"], self._dealt(asked, probe)
        # a chunk may have codes in several parts: the best of them counts
        pairs = rag._top_pairs(self._blocks(keys), asked, keys, n, vectors)
        once = pairs.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        return rag._ranked(once, n).select("query_id", "chunk_id")

    def search(self, chunks: DataFrame, queries: DataFrame, k: int | None = TOP_K, candidates: int | None = None, probe: float = 1.0) -> DataFrame:
        """(query_id, chunk_id, score) like `cosine_top_k`: the best k of the candidates (CANDIDATES times k, unless told) by
        their exact vectors, which are fetched from `chunks` (chunk_id, org_id, embedding) by id. Chunks that left the table
        are not found.

        With as many candidates as an organisation has chunks the answer is the exact one. A question that gets fewer
        than k hits is answered by the exact search.
        """
        k = bounded_k(k)
        near = self.candidates(queries, max(CANDIDATES * k if candidates is None else candidates, k), probe)
        q = queries.select("query_id", "org_id", F.col("embedding").alias("_q"))
        # ids meet vectors first, so that only candidates' vectors travel
        vectors = chunks.select("chunk_id", "org_id", "embedding").join(broadcast_if_small(near), "chunk_id")
        scored = vectors.join(broadcast_if_small(q), ["query_id", "org_id"]).select("query_id", "chunk_id", cosine(F.col("embedding"), F.col("_q")).alias("score"))
        hits, path = rag._ranked(scored, k), fresh_path(self.spark, "hits")
        hits.write.parquet(path)
        found = self.spark.read.schema(hits.schema).parquet(path)
        enough = found.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select("query_id")
        short = queries.join(enough, "query_id", "left_anti")
        return found.join(enough, "query_id", "left_semi").unionByName(rag.cosine_top_k(chunks, short, k))
