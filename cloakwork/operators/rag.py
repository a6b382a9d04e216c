"""Documents for retrieval: chunking, embedding, nearest chunks, context.

Vectors are compared block against block with numpy inside tasks. A block is what one Arrow batch holds of one
organisation, a thousand rows at most, so packing needs no shuffle, no organisation is ever gathered in one place, and
the scores of a pair of blocks are a matrix of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import CHUNK_CHARS, CHUNK_OVERLAP, CONTEXT_HEADER, MAX_TOP_K, TOP_K
from ..functions.scalars import WHITE_SPACE
from ..plans.sizing import broadcast_if_small
from .reports import latest_k

_SPACE = re.compile(f"[{WHITE_SPACE}]")


def chunk_text(text: str, max_chars: int, overlap: int) -> list[str]:
    """Windows of at most `max_chars`, cut at the last white space inside, each starting `overlap` before the last end."""
    text = text.strip(WHITE_SPACE)
    size, max_chars = len(text), max(max_chars, 1)
    overlap = min(overlap, max_chars // 2)
    if size <= max_chars:
        return [text] if text else []
    spaces = np.fromiter((m.start() for m in _SPACE.finditer(text)), dtype=np.int64)
    pieces, start, end = [], 0, 0
    while end < size:
        end = min(start + max_chars, size)
        if end < size:
            i = int(np.searchsorted(spaces, end)) - 1  # last space before the window's end
            if i >= 0 and spaces[i] > start:
                end = int(spaces[i])
        piece = text[start:end].strip(WHITE_SPACE)
        if piece:
            pieces.append(piece)
        start = max(end - overlap, start + 1)
    return pieces


def chunk_documents(docs: DataFrame, text_col: str, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk with a dense `chunk_index`; texts without content give none.

    Each cut depends on the one before, so this is the one place of the library that cuts text in Python, a batch
    of texts at a time.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else chunk_text(t, max_chars, overlap))

    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(cut(F.col(text_col))).alias("chunk_index", "content"))


class _Chunks:
    """The table function: a row per chunk of one text."""

    def eval(self, text: str, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, str]]:
        yield from enumerate([] if text is None else chunk_text(text, max_chars, overlap))


def register_chunks(spark: SparkSession, name: str = "chunks") -> str:
    """Makes chunking a table function of SQL: `from docs, lateral chunks(text [, max_chars, overlap])` gives
    (chunk_index, content) beside the row, as `chunk_documents` does. A text without content gives no row, behind a
    left join either: Spark runs table functions in Python as inner ones."""
    spark.udtf.register(name, F.udtf(_Chunks, returnType="chunk_index int, content string", useArrow=True))
    return name


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], list], dim: int, text_col: str = "content", batch: int = 256) -> DataFrame:
    """Adds `embedding` from a user function on lists of texts; the vectors must match in number and length."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = list(embed(part[text_col].tolist()))
                if len(vectors) != len(part):
                    raise ValueError(f"embedding count mismatch: {len(vectors)} for {len(part)} texts")
                if any(len(v) != dim for v in vectors):
                    raise ValueError(f"embedding length is not {dim}")
                yield part.assign(embedding=vectors)

    return chunks.mapInPandas(run, schema)


# --- nearest chunks -------------------------------------------------------------------------------------------

_BLOCK = (
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("dim", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
)
_HIT = "query_id bigint, chunk_id bigint, score double"
#: Hits that are broadcast to fetch their texts; a hit is three numbers.
BROADCAST_HITS = 500_000
#: Rows of a block.
BLOCK_ROWS = 1000
#: How the number of a cell is kept in a block.
_CELL = np.dtype("<u2")
#: Best hits a task holds back before it hands them on.
_HELD = 200_000


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row without length becomes NaN, which ranks last."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, dim)


def pack(df: DataFrame, id_col: str, vec_col: str, keys: list[str]) -> DataFrame:
    """Rows of unit vectors packed into blocks per key, within each Arrow batch. Null vectors are left out."""
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, *_BLOCK])
    names = [f.name for f in key_fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, g in frame.groupby(names, sort=False):
                for _, same in g.groupby(g["_v"].map(len), sort=False):
                    for at in range(0, len(same), BLOCK_ROWS):
                        part = same.iloc[at : at + BLOCK_ROWS]
                        unit = _unit(np.array(part["_v"].tolist(), dtype=np.float64))
                        rows.append((*key, part["_id"].tolist(), unit.shape[1], unit.tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    slim = df.filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(
        *names, F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).alias("_v")
    )
    return slim.mapInPandas(run, schema)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best scores of each row; ties to smaller ids, NaN last. `ids` are the columns' ids.

    A partition finds each row's kth score; only what reaches it is sorted.
    """
    ranked = np.where(np.isnan(scores), -np.inf, scores)
    n = scores.shape[1]
    if n > k:
        kth = np.partition(ranked, n - k, axis=1)[:, n - k]
        rows, columns = np.nonzero(ranked >= kth[:, None])
    else:
        rows, columns = np.divmod(np.arange(scores.size), n)
    order = np.lexsort((ids[columns], -ranked[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


def _top_near(asked: np.ndarray, given: np.ndarray, ids: np.ndarray, k: int, near: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, rows, columns) like `_top`, of the pairs alone whose cell is among those that the row looks into."""
    looks = np.zeros((len(asked), int(max(near.max(), cells.max())) + 1), dtype=bool)
    np.put_along_axis(looks, near.astype(np.int64), True, axis=1)
    looked = looks[:, cells]
    if looked.all():
        scores = asked @ given.T
        return scores, *_top(scores, ids, k)
    scores = np.full(looked.shape, -np.inf)
    for cell in np.unique(cells):
        some, of = np.flatnonzero(looks[:, cell]), np.flatnonzero(cells == cell)
        scores[np.ix_(some, of)] = asked[some] @ given[of].T
    # a cosine that is not a number ranks behind all others, and before what was not looked into
    rows, columns = _top(np.where(np.isnan(scores), -2.0, scores), ids, k)
    found = looked[rows, columns]
    return scores, rows[found], columns[found]


def _best_pairs(frames: Iterator[pd.DataFrame], k: int, vectors: Callable | None = None) -> Iterator[pd.DataFrame]:
    """Per query the best k chunks a task has seen, over all its block pairs; `vectors` reads the vectors of a block."""
    held: list[pd.DataFrame] = []
    size = 0

    def best() -> pd.DataFrame:
        hits = pd.concat(held).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], na_position="last")
        return hits.groupby("query_id", sort=False).head(k)

    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.dim != r.q_dim:
                continue
            ids, q_ids = np.asarray(r.ids), np.asarray(r.q_ids)
            asked, given = _matrix(r.q_data, r.dim), vectors(r) if vectors else _matrix(r.data, r.dim)
            if hasattr(r, "near"):
                scores, rows, columns = _top_near(asked, given, ids, k, np.frombuffer(r.q_near, _CELL).reshape(len(q_ids), -1), np.frombuffer(r.near, _CELL))
            else:
                scores = asked @ given.T
                rows, columns = _top(scores, ids, k)
            held.append(pd.DataFrame({"query_id": q_ids[rows], "chunk_id": ids[columns], "score": scores[rows, columns]}))
            size += len(rows)
            if size > _HELD:
                held = [best()]
                size = len(held[0])
                if size > _HELD // 2:
                    yield held[0]
                    held, size = [], 0
    if held:
        yield best()


def _top_pairs(chunk_blocks: DataFrame, query_blocks: DataFrame, keys: list[str], k: int, vectors: Callable | None = None) -> DataFrame:
    parts = [c for c in ("ids", "dim", "data", "near") if c in chunk_blocks.columns]
    q = query_blocks.select(*keys, *[F.col(c).alias(f"q_{c}") for c in parts])
    pairs = chunk_blocks.join(broadcast_if_small(q), keys).select(*parts, *[f"q_{c}" for c in parts])
    return pairs.mapInPandas(lambda frames: _best_pairs(frames, k, vectors), _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    return latest_k(hits.withColumn("score", score), "query_id", [F.desc_nulls_last("score"), F.col("chunk_id")], k)


def bounded_k(k: int | None) -> int:
    return min(max(TOP_K if k is None else k, 1), MAX_TOP_K)


def cosine_top_k(chunks: DataFrame, queries: DataFrame, k: int | None = TOP_K) -> DataFrame:
    """(query_id, chunk_id, score): the k chunks of the query's organisation closest by cosine, exact.

    `chunks` has chunk_id, org_id, embedding; `queries` query_id, org_id, embedding. Every task keeps k hits per
    query of its own chunks, and only those are shuffled.
    """
    k = bounded_k(k)
    pairs = _top_pairs(pack(chunks, "chunk_id", "embedding", ["org_id"]), pack(queries, "query_id", "embedding", ["org_id"]), ["org_id"], k)
    return _ranked(pairs, k)


#: Most cells of an organisation.
MAX_CELLS = 256


def centres(chunks: DataFrame) -> DataFrame:
    """(org_id, dim, centres): per organisation and vector length the vectors its cells lie around, picked by hash.

    Their number is the root of the organisation's chunks, MAX_CELLS at most, so that cells grow with it as their
    number does.
    """
    some = chunks.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select("org_id", "chunk_id", F.size("embedding").alias("dim"), "embedding")
    sizes = some.groupBy("org_id", "dim").agg(F.least(F.ceil(F.sqrt(F.count("*"))), F.lit(MAX_CELLS)).alias("_cells"))
    first = latest_k(some.withColumn("_h", F.xxhash64("chunk_id")), ["org_id", "dim"], [F.col("_h"), F.col("chunk_id")], MAX_CELLS)
    ranked = first.groupBy("org_id", "dim").agg(F.array_sort(F.collect_list(F.struct("_h", "chunk_id", "embedding"))).alias("_c"))
    cut = ranked.join(sizes, ["org_id", "dim"]).withColumn("_c", F.slice("_c", F.lit(1), F.col("_cells").cast("int")))
    return cut.select("org_id", "dim", F.transform("_c", lambda x: x["embedding"]).alias("centres"))


def _cells(blocks: DataFrame, around: DataFrame, share: float) -> DataFrame:
    """Blocks with `near`, the numbers of the cells each vector is dealt to: the `share` of its organisation's cells closest
    to it, one at least. A vector stays in its block, however many its cells are."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("near", T.BinaryType())])
    joined = blocks.join(broadcast_if_small(around), ["org_id", "dim"]).select(*blocks.columns, "centres")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, r in enumerate(frame.itertuples(index=False)):
                unit = _matrix(r.data, r.dim)
                middle = np.nan_to_num(_unit(np.array([list(c) for c in r.centres], dtype=np.float64)))
                near = max(1, int(np.ceil(share * len(middle))))
                order = np.argsort(-np.nan_to_num(unit @ middle.T), axis=1, kind="stable")[:, :near]
                yield frame.iloc[at : at + 1, :-1].assign(near=[order.astype(_CELL).tobytes()])

    return joined.mapInPandas(run, schema)


def approx_top_k(chunks: DataFrame, queries: DataFrame, k: int | None = TOP_K, share: float = 0.85) -> DataFrame:
    """Like `cosine_top_k`, looking only into the `share` of the organisation's cells closest to each query; scores are
    exact. With a share of 1 all cells are looked into, and the answer is the exact one.

    A query that finds fewer than k hits there is answered by the exact search instead, so k hits come wherever the
    organisation has k. Blocks meet whole, and within a pair of blocks each cell is scored for the queries that look into
    it: queries are not copied per cell, and a crowded cell is no hot spot.
    """
    k = bounded_k(k)
    around = centres(chunks)
    c = _cells(pack(chunks, "chunk_id", "embedding", ["org_id"]), around, 0.0)
    q = _cells(pack(queries, "query_id", "embedding", ["org_id"]), around, share)
    found = _ranked(_top_pairs(c, q, ["org_id"], k), k)
    enough = found.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= k).select("query_id")
    short = queries.join(enough, "query_id", "left_anti")
    return found.join(enough, "query_id", "left_semi").unionByName(cosine_top_k(chunks, short, k))


def hits_with_title(hits: DataFrame, chunks: DataFrame, docs: DataFrame, n_hits: int | None = None) -> DataFrame:
    """Hits with passage and document title. The k hits per query are fixed first; texts are fetched for them alone.

    `n_hits` is a bound of the hits that the caller knows (questions times k): while it is small the hits are broadcast,
    and no text is shuffled. Spark's own estimate of a ranked join is far too high to tell.
    """
    found = F.broadcast(hits) if n_hits is not None and n_hits <= BROADCAST_HITS else broadcast_if_small(hits)
    texts = chunks.select("chunk_id", "document_id", "content").join(found, "chunk_id")
    return docs.select("document_id", "title").join(broadcast_if_small(texts), "document_id").select(
        "query_id", "chunk_id", "document_id", "title", "content", "score"
    )


def documents_with_chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return docs.join(counts, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0).cast("bigint")))


def latest_user_message(messages: Column) -> Column:
    """The question retrieval is asked with: the last user message, after redaction."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def build_context(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Requests with the retrieved passages put in front as a system message.

    `hits` is (request_id, rank, content), at most k per request. Organisations without retrieval and requests
    without hits stay as they are.
    """
    gathered = hits.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_hits"))
    passages = F.transform(
        "_hits", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["content"], F.lit("\n\n"))
    )
    context = F.struct(F.lit("system").alias("role"), F.concat(F.lit(CONTEXT_HEADER), F.array_join(passages, "")).alias("content"))
    wanted = F.col("rag_enabled") & F.col("_hits").isNotNull() & latest_user_message(F.col("messages")).isNotNull()
    return (
        requests.join(gathered, "request_id", "left")
        .withColumn("messages", F.when(wanted, F.concat(F.array(context), F.col("messages"))).otherwise(F.col("messages")))
        .drop("_hits")
    )
