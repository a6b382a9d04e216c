"""Registered queries: chunking, embedding, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.catalog import CHUNK_CHARS, CHUNK_OVERLAP
from ..functions.vectors import cosine, format_vector, parse_vector
from ..operators import rag as G
from ..operators.vector_index import VectorIndex
from .audit import _turns
from .registry import Inputs, register
from .session import fresh_path, spread

_WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The cursor as a recursion over all documents at once: one step per chunk.
_CHUNKS = (
    f"with recursive t as (select doc_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as text from documents), "
    "src as (select doc_id, text, length(text) as n from t where length(text) > 0), "
    "walk as (select doc_id, 0 as step, 0 as start, (select 0) as dummy from src union all "
    "select doc_id, step + 1, greatest(fin - {o}, start + 1), 0 from (select w.doc_id, w.step, w.start, s.n, "
    "case when start + {m} >= n then n else start + coalesce(nullif(length(regexp_extract(substring(text, start + 1, {m}), '(?s)^(.*){ws}', 1)), 0), {m}) end as fin "
    "from walk w join src s using (doc_id)) where fin < n), "
    "cuts as (select w.doc_id, step, start, case when start + {m} >= n then n else start + coalesce(nullif(length(regexp_extract(substring(text, start + 1, {m}), '(?s)^(.*){ws}', 1)), 0), {m}) end as fin, text "
    "from walk w join src s using (doc_id)), "
    "pieces as (select doc_id, step, regexp_replace(substring(text, start + 1, fin - start), '^{ws}+|{ws}+$', '', 'g') as content from cuts) "
    "select doc_id, row_number() over (partition by doc_id order by step) - 1 as chunk_index, content from pieces where content <> ''"
).replace("{m}", str(CHUNK_CHARS)).replace("{o}", str(CHUNK_OVERLAP)).replace("{ws}", _WS)
_CHUNKS = _CHUNKS.replace(", (select 0) as dummy from src", " from src").replace("start + 1), 0 from (", "start + 1) from (")


def _chunks(t: Inputs):
    return G.chunk_documents(spread(t("documents").select("doc_id", "text")), "text")


@register("chunk_documents", _CHUNKS)
def chunk_documents(t: Inputs):
    return _chunks(t)


@register("chunk_documents_sql", _CHUNKS)
def chunk_documents_sql(t: Inputs):
    cut = G.register_chunks(t.spark, "cloakwork_chunks")
    docs = spread(t("documents").select("doc_id", "text"))
    return t.spark.sql(f"select doc_id, chunk_index, content from {{docs}}, lateral {cut}(text)", docs=docs)


def _profile(texts: list[str]) -> list[list[float]]:
    """A stand-in embedder: a few letter counts."""
    return [[float(len(x)), float(x.count(" ")), float(x.count("a")), float(x.count("e"))] for x in texts]


@register(
    "embed_chunks",
    f"with ch as ({_CHUNKS}) select doc_id, chunk_index, cast(length(content) as double) as d0, cast(length(content) - length(replace(content, ' ', '')) as double) as d1, "
    "cast(length(content) - length(replace(content, 'a', '')) as double) as d2, cast(length(content) - length(replace(content, 'e', '')) as double) as d3 from ch",
)
def embed_chunks(t: Inputs):
    out = G.embed_chunks(_chunks(t), _profile, 4)
    return out.select("doc_id", "chunk_index", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(4)])


_COS = "list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))"
_TOP = (
    "select query_id, chunk_id, round(score, 6) as score from (select q.query_id, c.chunk_id, " + _COS.format(a="c.embedding", b="q.embedding") + " as score "
    "from rag_chunks c join rag_questions q using (org_id)) qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 5"
)


@register("cosine_top_k", _TOP, "rag_chunks rag_questions")
def cosine_top_k(t: Inputs):
    return G.cosine_top_k(t("rag_chunks"), t("rag_questions")).withColumn("score", F.round("score", 6))


# Cosine in column form, between each vector and the next.
@register(
    "cosine_distance",
    "select a.vec_id, round(1 - " + _COS.format(a="a.embedding", b="b.embedding") + ", 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def cosine_distance(t: Inputs):
    later = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t("embeddings").join(later, "vec_id").select("vec_id", F.round(1 - cosine(F.col("embedding"), F.col("b")), 6).alias("distance"))


@register("approx_top_k_all_cells", _TOP, "rag_chunks rag_questions")
def approx_top_k_all_cells(t: Inputs):
    """Looking into every cell, the approximate search has to be the exact one."""
    return G.approx_top_k(t("rag_chunks"), t("rag_questions"), share=1.0).withColumn("score", F.round("score", 6))


@register("approx_top_k")
def approx_top_k(t: Inputs):
    return G.approx_top_k(t("rag_chunks"), t("rag_questions"))


def _indexed(t: Inputs):
    """The organisations' chunks in an index: learnt from all of them, filled in two appends."""
    chunks = t("rag_chunks")
    index = VectorIndex.create(chunks, fresh_path(t.spark, "vector-index"))
    for part in (0, 1):
        index.append(chunks.filter(F.col("chunk_id") % 2 == part), str(part))
    return index


@register("indexed_top_k")
def indexed_top_k(t: Inputs):
    return _indexed(t).search(t("rag_chunks"), t("rag_questions"))


# Every chunk is a candidate of every question, and its vector is read for it: every hundredth vector asks here.
@register("indexed_top_k_all", _TOP.replace("rag_questions", "rag_queries"), "rag_chunks rag_queries")
def indexed_top_k_all(t: Inputs):
    """With every chunk a candidate, the search by the index has to be the exact one."""
    chunks = t("rag_chunks")
    most = chunks.groupBy("org_id").count().agg(F.max("count")).first()[0] or 1
    return _indexed(t).search(chunks, t("rag_queries"), candidates=most).withColumn("score", F.round("score", 6))


@register(
    "hits_with_title",
    f"with h as ({_TOP}) select query_id, chunk_id, c.document_id, title, content, h.score from h join rag_chunks c using (chunk_id) join rag_documents d on d.document_id = c.document_id",
    "rag_chunks rag_questions rag_documents",
)
def hits_with_title(t: Inputs):
    hits = G.cosine_top_k(t("rag_chunks"), t("rag_questions"))
    n_hits = t("rag_questions").count() * G.TOP_K
    return G.hits_with_title(hits, t("rag_chunks"), t("rag_documents"), n_hits).withColumn("score", F.round("score", 6))


@register(
    "documents_with_chunk_counts",
    "select d.document_id, org_id, title, source, coalesce(n, 0) as chunks from rag_documents d left join "
    "(select document_id, count(*) as n from rag_chunks group by document_id) using (document_id)",
    "rag_chunks rag_documents",
)
def documents_with_chunk_counts(t: Inputs):
    return G.documents_with_chunk_counts(t("rag_documents"), t("rag_chunks").select("document_id"))


@register(
    "vector_text",
    "select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: regexp_replace(cast(round(x * 64) / 64 + 0.0 as float) || '', '\\.0$', '')), ',') || ']' as text, "
    "len(embedding) as dim, true as same from embeddings",
)
def vector_text(t: Inputs):
    # rounded to 1/64 so that both engines have few digits to print
    rounded = F.transform("embedding", lambda x: (F.round(x * 64) / 64).cast("float"))
    text = t("embeddings").select("vec_id", rounded.alias("v")).withColumn("text", format_vector(F.col("v")))
    return text.select("vec_id", "text", F.size(parse_vector(F.col("text"))).alias("dim"), (parse_vector(F.col("text")) == F.col("v")).alias("same"))




@register(
    "build_context",
    "with q as (select request_id, request_id % 10 as org_id, embedding from request_headers join embeddings on vec_id = request_id), "
    "h as (select request_id, content, row_number() over (partition by request_id order by score desc, chunk_id) as rank from "
    "(select q.request_id, c.chunk_id, c.content, " + _COS.format(a="c.embedding", b="q.embedding") + " as score from rag_chunks c join q using (org_id))), "
    "ctx as (select request_id, 'Relevant context from the organization''s knowledge base. Use it when it helps answer; otherwise rely on your general knowledge.' || chr(10) || chr(10) || "
    "string_agg('[' || rank || '] ' || content || chr(10) || chr(10), '' order by rank) as ctx from h where rank <= 5 group by request_id), "
    "msgs as (select conv_id as request_id, count(*) as n, arg_min(content, turn) as first, arg_max(content, turn) filter (where role = 'user') as asked from messages group by conv_id) "
    "select request_id, case when request_id % 2 = 0 and ctx is not null and asked is not null then n + 1 else n end as n, "
    "case when request_id % 2 = 0 and ctx is not null and asked is not null then ctx else first end as first, asked from msgs left join ctx using (request_id)",
    "request_headers embeddings rag_chunks messages",
)
def build_context(t: Inputs):
    requests = _turns(t).withColumn("rag_enabled", F.col("request_id") % 2 == 0)
    queries = requests.select(F.col("request_id").alias("query_id"), (F.col("request_id") % 10).alias("org_id")).join(
        t("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id"
    )
    hits = G.cosine_top_k(t("rag_chunks"), queries)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")  # k rows per question
    ranked = hits.withColumn("rank", F.row_number().over(place)).join(t("rag_chunks").select("chunk_id", "content"), "chunk_id")
    out = G.build_context(requests, ranked.select(F.col("query_id").alias("request_id"), "rank", "content"))
    return out.select(
        "request_id", F.size("messages").alias("n"), F.col("messages")[0]["content"].alias("first"), G.latest_user_message(F.col("messages")).alias("asked")
    )
