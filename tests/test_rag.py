"""Chunking against a plain loop, embedding hook, nearest chunks against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.functions.scalars import WHITE_SPACE
from cloakwork.functions.vectors import cosine, format_vector, parse_vector
from cloakwork.operators import rag as G
from cloakwork.plans import run


def plain_chunks(text, most, overlap):
    """One character at a time, as the rule reads."""
    text = text.strip(WHITE_SPACE)
    if not text:
        return []
    if len(text) <= most:
        return [text]
    overlap = min(overlap, most // 2)
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            for p in range(end - 1, start, -1):
                if text[p] in WHITE_SPACE:
                    end = p
                    break
        piece = text[start:end].strip(WHITE_SPACE)
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n é😀", max_size=200), st.integers(1, 40), st.integers(0, 60))
def test_chunks_equal_the_plain_loop(text, most, overlap):
    assert G.chunk_text(text, most, overlap) == plain_chunks(text, most, overlap)


def test_chunk_cases():
    assert G.chunk_text("hello world", 100, 10) == ["hello world"]
    assert G.chunk_text("   ", 100, 10) == []
    many = G.chunk_text("word " * 200, 100, 20)
    assert len(many) > 1 and all(len(c) <= 100 for c in many)
    # a blank near the window's start moves the next window by one character only
    assert G.chunk_text("ab " + "x" * 30, 10, 5)[:2] == ["ab", "b"]


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "word " * 50), (2, ""), (3, None), (4, "short")], "doc_id long, text string")
    got = G.chunk_documents(df, "text", 60, 10).collect()
    assert sorted({r["doc_id"] for r in got}) == [1, 4]
    assert [r["chunk_index"] for r in got if r["doc_id"] == 1] == list(range(sum(r["doc_id"] == 1 for r in got)))


def test_embedding_hook_checks_its_answer(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "id long, content string")
    out = G.embed_chunks(df, lambda xs: [[float(x[1:]), 1.0] for x in xs], 2, batch=3).orderBy("id").collect()
    assert [r["embedding"][0] for r in out] == [float(i) for i in range(10)]
    with pytest.raises(Exception, match="count mismatch"):
        G.embed_chunks(df, lambda xs: [[1.0, 1.0]], 2).collect()
    with pytest.raises(Exception, match="length"):
        G.embed_chunks(df, lambda xs: [[1.0] for _ in xs], 2).collect()


CHUNK = "chunk_id long, org_id long, embedding array<float>"
QUERY = "query_id long, org_id long, embedding array<float>"


def vectors(rnd, n, dim=8, orgs=3):
    # most vectors in one organisation
    return [(i, 0 if rnd.random() < 0.7 else rnd.randrange(orgs), [rnd.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


def brute_top(chunks, queries, k):
    out = {}
    for q, org, v in queries:
        same = [(-float(np.dot(v, c) / (np.linalg.norm(v) * np.linalg.norm(c))), i) for i, o, c in chunks if o == org and c]
        out[q] = [i for _, i in sorted(same)[:k]]
    return out


def test_exact_search_equals_brute_force(spark):
    rnd = random.Random(1)
    chunks, queries = vectors(rnd, 700), vectors(rnd, 25)
    chunks += [(1000, 0, None), (1001, 0, [0.0] * 8)]  # no vector; no direction, ranks last
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # many blocks
    try:
        got = {}
        for r in G.cosine_top_k(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(queries, QUERY), 7).collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == brute_top(chunks[:700], queries, 7)


def test_ties_go_to_the_smaller_id(spark):
    chunks = spark.createDataFrame([(i, 1, [1.0, 0.0]) for i in (9, 4, 7, 2, 8)], CHUNK)
    queries = spark.createDataFrame([(1, 1, [2.0, 0.0])], QUERY)
    assert sorted(r["chunk_id"] for r in G.cosine_top_k(chunks, queries, 3).collect()) == [2, 4, 7]


def test_k_is_kept_in_range():
    assert [G.bounded_k(k) for k in (None, 0, 3, 99)] == [5, 1, 3, 20]


def test_approximate_search_recall(spark):
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = lambda: [x + rnd.gauss(0, 0.15) for x in rnd.choice(centres)]
    chunks = [(i, 0, near()) for i in range(800)]
    queries = [(i, 0, near()) for i in range(30)]
    hits = G.approx_top_k(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(queries, QUERY), 5, share=0.25).collect()
    exact = brute_top(chunks, queries, 5)
    found = sum(r["chunk_id"] in exact[r["query_id"]] for r in hits)
    assert found / sum(map(len, exact.values())) > 0.9


def test_approximate_search_on_the_given_vectors(spark, sf_dir):
    """Recall against the exact search, and k hits wherever the organisation has k."""
    exact, found = ([(r["query_id"], r["chunk_id"]) for r in run(n, spark, sf_dir).collect()] for n in ("cosine_top_k", "approx_top_k"))
    assert len(exact) == len(found)
    assert len(set(exact) & set(found)) >= 0.95 * len(exact)


def test_few_hits_are_made_up_for(spark):
    chunks = [(i, 0, [float(i == j) for j in range(8)]) for i in range(8)] + [(100 + i, 1, [1.0] * 8) for i in range(3)]
    queries = [(1, 0, [1.0, 0.1, 0, 0, 0, 0, 0, 0]), (2, 1, [1.0] * 8), (3, 2, [1.0] * 8), (4, 0, None)]
    hits = G.approx_top_k(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame([(i, o, v and list(map(float, v))) for i, o, v in queries], QUERY), 5, share=0.01).collect()
    count = lambda q: sum(r["query_id"] == q for r in hits)
    assert [count(q) for q in (1, 2, 3, 4)] == [5, 3, 0, 0]


def test_questions_are_not_copied_per_cell(spark):
    rnd = random.Random(8)
    chunks, queries = (spark.createDataFrame(vectors(rnd, n), schema) for n, schema in ((400, CHUNK), (60, QUERY)))
    around = G.centres(chunks)
    asked = G.pack(queries, "query_id", "embedding", ["org_id"])
    dealt = G._cells(asked, around, 1.0)
    size = lambda df: sum(len(r["data"]) for r in df.collect())
    assert max(len(r["centres"]) for r in around.collect()) > 10
    assert size(dealt) == size(asked) == 60 * 8 * 8
    hits = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert hits(G.approx_top_k(chunks, queries, 7, share=1.0)) == hits(G.cosine_top_k(chunks, queries, 7))


def test_best_of_the_cells_looked_into():
    rng = np.random.default_rng(5)
    for n_near in (1, 3, 6):
        asked, given = (G._unit(np.round(rng.normal(size=(n, 4)), 0)) for n in (5, 40))  # some without direction
        cells, ids = rng.integers(0, 6, 40).astype(G._CELL), rng.permutation(40)
        near = np.array([rng.permutation(6)[:n_near] for _ in range(5)], dtype=G._CELL)
        scores, rows, columns = G._top_near(asked, given, ids, 8, near, cells)
        exact = np.round(asked @ given.T, 9)
        for i in range(5):
            seen = [c for c in range(40) if cells[c] in near[i]]
            want = sorted(seen, key=lambda c: (np.isnan(exact[i, c]), -np.nan_to_num(exact[i, c]), ids[c]))[:8]
            assert np.array_equal(np.round(scores[i, columns[rows == i]], 9), exact[i, want], equal_nan=True)
            assert set(columns[rows == i]) <= set(seen)


def test_best_of_a_matrix():
    rng = np.random.default_rng(3)
    for _ in range(50):
        scores = np.round(rng.normal(size=(4, rng.integers(1, 30))), 1)
        scores[rng.random(scores.shape) < 0.1] = np.nan
        ids = rng.permutation(scores.shape[1])
        rows, columns = G._top(scores, ids, 5)
        for i in range(4):
            want = sorted(range(scores.shape[1]), key=lambda c: (np.isnan(scores[i, c]), -np.nan_to_num(scores[i, c]), ids[c]))[:5]
            assert columns[rows == i].tolist() == want


def test_every_question_is_asked(spark, tmp_path):
    """Every id divisible by 100, and those that asked before these came: no change of the set may make it smaller."""
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], i % 3) for i in range(320)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = [(i, "web") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i for i in range(320) if i % 100 == 0 or i % 20 == 3}
    for name in ("cosine_top_k", "approx_top_k_all_cells", "hits_with_title"):
        asked = [r["query_id"] for r in run(name, spark, str(tmp_path)).collect()]
        assert set(asked) == want and len(asked) == 5 * len(want), name


def test_texts_of_hits_are_not_shuffled(spark, sf_dir):
    plan = run("hits_with_title", spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_vector_text(spark):
    df = spark.createDataFrame([([1.0, 2.5],), ([],), ([1e10, -3e-7, 0.1],), ([1e-30, -1.17549435e-38, 3.4028235e38, 12345678.0, -0.00012345678, 0.0],)], "v array<float>")
    texts = [r[0] for r in df.select(format_vector(F.col("v"))).collect()]
    assert texts[0] == "[1,2.5]" and texts[1] == "[]" and texts[2] == "[10000000000,-0.0000003,0.1]"
    assert df.filter(parse_vector(format_vector(F.col("v"))) != F.col("v")).count() == 0


def test_cosine_of_a_null_direction(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [None, 1.0]


def test_context_goes_first_and_only_where_wanted(spark):
    m = [("system", "s"), ("user", "old"), ("user", "q"), ("assistant", "a")]
    schema = "request_id long, rag_enabled boolean, messages array<struct<role:string,content:string>>"
    reqs = spark.createDataFrame([(1, True, m), (2, False, m), (3, True, m)], schema)
    hits = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (2, 1, "x")], "request_id long, rank int, content string")
    got = {r["request_id"]: r["messages"] for r in G.build_context(reqs, hits).collect()}
    assert got[1][0]["role"] == "system" and got[1][0]["content"].endswith("general knowledge.\n\n[1] one\n\n[2] two\n\n")
    assert len(got[1]) == 5 and len(got[2]) == 4 and len(got[3]) == 4
    assert reqs.select(G.latest_user_message(F.col("messages"))).first()[0] == "q"


def test_chunks_in_sql(spark):
    """The table function against the operator: limits of its own, texts without content, a left join."""
    name = G.register_chunks(spark)
    texts = [None, "", "  \n ", "one two three four five six " * 30, "é" * 700, "x " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for args, limits in (("", ()), (", 50, 10", (50, 10)), (", overlap => 5, max_chars => 60", (60, 5))):
        got = spark.sql(f"select doc_id, chunk_index, content from {{docs}}, lateral {name}(text{args})", docs=docs)
        want = G.chunk_documents(docs, "text", *limits)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("doc_id", "chunk_index", "content").collect()))
    outer = spark.sql(f"select distinct doc_id from {{docs}} left join lateral {name}(text)", docs=docs)
    assert sorted(r["doc_id"] for r in outer.collect()) == [3, 4, 5]
