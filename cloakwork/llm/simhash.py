"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find near ones.

Terms are runs of `SHINGLE` words. A term's weight grows with its count in the text and, for repeated terms, slowly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_lists, register, table, texts, written
from .hashing import STEP, mix, run_hashes, word_hashes

BITS = 256
SHINGLE = 2
#: Terms voted on at a time.
BLOCK = 2048

_STEPS = np.arange(1, 65, dtype=np.uint64) * STEP


def _ones(signs: np.ndarray) -> np.ndarray:
    """Ones in each column, summed in bytes as far as these hold."""
    whole = len(signs) // 255 * 255
    ones = np.add.reduce(signs[whole:], axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        ones += np.add.reduce(signs[:whole].reshape(-1, 255, signs.shape[1]), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: str, bits: int = BITS, shingle: int = SHINGLE) -> bytes:
    """`bits` / 8 bytes; a text without words has all bits zero."""
    terms, counts = np.unique(run_hashes(word_hashes(text), shingle), return_counts=True)
    votes = np.zeros(bits, dtype=np.int64)
    steps = _STEPS[: bits // 64]
    for at in range(0, len(terms), BLOCK):
        n = counts[at : at + BLOCK]
        signs = np.unpackbits(mix(terms[at : at + BLOCK, None] + steps).view(np.uint8), axis=1)
        votes += 2 * _ones(signs) - len(n)
        more = n > 1
        if more.any():  # a repeated term adds the floor of the binary logarithm of its count
            weight = np.floor(np.log2(n[more])).astype(np.int64)
            votes += 2 * (weight @ signs[more]) - weight.sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the share of equal bits stands for, 0 at least; 1 for equal fingerprints."""
    distance = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * distance / (8 * len(a)))) if distance else 1.0


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex). Null text counts as empty; equal texts have equal fingerprints;
    repeated rows come once each; other columns are left out. Row-local."""

    def make() -> Callable:
        return lambda ids, all_texts: [ids, [fingerprint(t, bits, shingle).hex() for t in all_texts]]

    return map_lists(texts(docs, id_col, text_col), make, "doc_id long, fingerprint string")


def near_fingerprints(prints: DataFrame, radius: int, id_col: str = "doc_id", print_col: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, class_id; pairs: a, b, distance): every pair of different fingerprints within `radius` bits.

    Documents of one fingerprint form a class, so copies are never paired. The bits are split into radius + 2 blocks;
    two fingerprints within the radius agree on two blocks at least, so a table for each choice of two blocks, keyed by
    their bits, brings every such pair together, and the distance is then counted exactly. A pair comes once, from the
    first table it meets in. Class ids are the fingerprints.
    """
    members = prints.select(F.col(id_col).alias("doc_id"), F.col(print_col).alias("class_id"))
    classes = members.filter(F.col("class_id").isNotNull()).select("class_id").distinct()
    tables = list(combinations(range(radius + 2), 2))

    def keys(prints_: list) -> list[list]:
        out_keys, out = [], []
        for p in prints_:
            whole, n = int(p, 16), 4 * len(p)
            cuts = [n * i // (radius + 2) for i in range(radius + 3)]
            blocks = [(whole >> cuts[i]) & ((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(radius + 2)]
            for number, (i, j) in enumerate(tables):
                out_keys.append(f"{number}:{blocks[i]:x}:{blocks[j]:x}")
                out.append(p)
        return [out_keys, out]

    keyed = written(map_lists(classes, lambda: keys, "key string, class_id string"), "simhash-tables")
    left, right = keyed.select("key", F.col("class_id").alias("a")), keyed.select("key", F.col("class_id").alias("b"))
    met = left.join(right, "key").filter("a < b").select("a", "b").distinct()

    def measure(a: list, b: list) -> list[list]:
        return [a, b, [(int(x, 16) ^ int(y, 16)).bit_count() for x, y in zip(a, b)]]

    pairs = map_lists(met, lambda: measure, "a string, b string, distance int").filter(F.col("distance") <= radius)
    return members, pairs


#: Documents that a stretch of the order aims at, and the most stretches: each row is compared with all cut points. Tasks
#: stream their stretches, so longer ones need no more memory.
STRETCH = 4096
STRETCHES = 1024

_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE, stretch: int = STRETCH) -> DataFrame:
    """Each document against its edited text and against the next document by descending id.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones of the next
    document, or all it has; after the last document comes the first. Null text is empty. Ids that are null come last,
    equal ids in the order of their texts; a single document is its own next one.

    The order is dealt into stretches of the id range, by cut points taken from the ids alone. A stretch also gets the
    first document of the one after it, so that no task needs another's rows, and texts are shuffled once.
    """
    rows = texts(docs, id_col, text_col)
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    ids = rows.select(order.alias("o"))
    n = ids.count()
    if not n:
        return docs.sparkSession.createDataFrame([], _EDITED)
    pieces = min(max(1, n // stretch), STRETCHES)
    cuts = sorted({int(c) for c in _quantiles(ids, pieces)})
    first = int(ids.agg(F.max("o")).first()[0])  # the first of the order has the largest id
    # stretch k holds the ids in (cuts[k-1], cuts[k]]; the order runs from the last stretch down to 0, and then again
    edges = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    own = F.size(F.filter(edges, lambda c: c < F.col("o")))
    placed = rows.withColumn("o", order).withColumn("own", own)
    dealt = placed.select(
        "doc_id", "o", "text",
        F.explode(F.concat(
            F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("extra"))),
            # the largest id of a stretch also ends the one above it; the largest of all also ends stretch 0
            F.when(F.array_contains(edges, F.col("o")), F.array(F.struct((F.col("own") + 1).alias("part"), F.lit(1).alias("extra")))).otherwise(F.array().cast("array<struct<part:int,extra:int>>")),
            F.when(F.col("o") == first, F.array(F.struct(F.lit(0).alias("part"), F.lit(2).alias("extra")))).otherwise(F.array().cast("array<struct<part:int,extra:int>>")),
        )).alias("at"),
    ).select(F.col("at.part").alias("part"), F.col("at.extra").alias("extra"), "o", "doc_id", "text")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "extra", F.desc("o"), "text")
    struct = T._parse_datatype_string(_EDITED)
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (part, doc_id, text, fingerprint), waiting for the next document
        ended = None  # the stretch whose last document has met its next one

        for batch in batches:
            rows_: list[tuple] = []
            for part, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if extra and ended == part:
                    continue
                print_ = fingerprint(text, bits, shingle)
                if before and before[0] == part:
                    rows_.append(_edited_row(before, text, print_, bits, shingle))
                if extra:
                    before, ended = None, part
                else:
                    before = (part, doc_id, text, print_)
            if rows_:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_), out)], schema=out)

    return dealt.mapInArrow(run, struct)


def _edited_row(doc: tuple, next_text: str, next_print: bytes, bits: int, shingle: int) -> tuple:
    _, doc_id, text, print_ = doc
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    edited_print = fingerprint(edited, bits, shingle)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, print_.hex(), edited_print.hex(), likeness(print_, edited_print), likeness(print_, next_print)


def _quantiles(ids: DataFrame, pieces: int) -> list[float]:
    """Ids that cut the order into about equal stretches; each is an id that occurs."""
    if pieces < 2:
        return []
    sampled = ids.selectExpr(f"percentile_approx(o, array({','.join(str(i / pieces) for i in range(1, pieces))}), {max(10000, 4 * pieces)}) AS q").first()[0]
    return list(sampled)


@register("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
