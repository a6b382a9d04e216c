"""The stored vector index against brute force: recall, appends, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.operators import rag as G
from cloakwork.operators.vector_index import SAMPLE, Quantizer, VectorIndex
from cloakwork.plans import run

from .test_rag import CHUNK, QUERY


def triples(df):
    return sorted((r["query_id"], r["chunk_id"], None if r["score"] is None else round(r["score"], 6)) for r in df.collect())


def noise(n, dim, seed, orgs=1, first=0):
    rng = np.random.default_rng(seed)
    return [(first + i, i % orgs, rng.normal(size=dim).tolist()) for i in range(n)]


def test_codes_are_near_what_they_stand_for():
    rng = np.random.default_rng(1)
    for dim in (1, 7, 64):
        unit = G._unit(rng.normal(size=(2000, dim)))
        q = Quantizer.learnt(unit, 40)
        cells, codes = q.encode(unit)
        assert codes.shape == (2000, -(-dim // 4)) and codes.dtype == np.uint8
        assert np.square(q.decode(cells, codes) - unit).sum(axis=1).mean() < 0.2
        # cells alone say less
        assert dim == 1 or np.square(q.centres[cells] - unit).sum() > 2 * np.square(q.decode(cells, codes) - unit).sum()
    few = G._unit(rng.normal(size=(3, 8)))
    q = Quantizer.learnt(few, 40)
    assert np.allclose(q.decode(*q.encode(few)), few, atol=1e-6)


def test_recall_on_vectors_without_structure(spark, tmp_path):
    """At most 15 % of an organisation's vectors are read, and 95 % of the true neighbours found."""
    chunks, queries = spark.createDataFrame(noise(1600, 32, 2, orgs=2), CHUNK), spark.createDataFrame(noise(40, 32, 3, orgs=2), QUERY)
    index = VectorIndex.create(chunks, str(tmp_path / "i"))
    index.append(chunks, "all")
    exact = {t[:2] for t in triples(G.cosine_top_k(chunks, queries))}
    n = 800 * 15 // 100
    read = index.candidates(queries, n).groupBy("query_id").count().collect()
    assert len(read) == 40 and all(r["count"] == n for r in read)
    found = index.search(chunks, queries, candidates=n)
    got = triples(found)
    assert len({t[:2] for t in got} & exact) >= 0.95 * len(exact)
    assert len(got) == len(exact)
    vectors, asked = (dict((i, np.array(v)) for i, _, v in rows) for rows in (noise(1600, 32, 2, orgs=2), noise(40, 32, 3, orgs=2)))
    for q, c, score in got:
        assert q % 2 == c % 2 and score == pytest.approx(vectors[c] @ asked[q] / np.linalg.norm(vectors[c]) / np.linalg.norm(asked[q]), abs=1e-5)
    # looking into half of the cells finds fewer, but k each, with true scores
    some = triples(index.search(chunks, queries, candidates=n, probe=0.5))
    assert len(some) == len(exact) and 0.5 * len(exact) < len({t[:2] for t in some} & exact)


def test_given_vectors(spark, sf_dir):
    exact, found = ({(r["query_id"], r["chunk_id"]) for r in run(n, spark, sf_dir).collect()} for n in ("cosine_top_k", "indexed_top_k"))
    assert len(exact) == len(found) and len(exact & found) >= 0.95 * len(exact)


def test_appends_and_changes_of_the_table(spark, tmp_path):
    rows = noise(300, 8, 4, orgs=3)
    chunks, queries = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(noise(9, 8, 5, orgs=3), QUERY)
    index = VectorIndex.create(chunks, str(tmp_path / "i"), cells=5)
    for part in range(3):
        index.append(chunks.filter(F.col("chunk_id") % 3 == part), f"p{part}")
    index.append(chunks.filter("chunk_id % 3 = 1"), "p1")  # done again
    index.append(chunks.filter("chunk_id < 30"), "again")  # some chunks in two parts
    again = VectorIndex(spark, index.path)
    assert again.codes().count() == 330
    assert triples(again.search(chunks, queries, candidates=300)) == triples(G.cosine_top_k(chunks, queries))
    # rows that left the table are not found, new vectors score as they are now
    later = chunks.filter("chunk_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x + 1))
    assert triples(again.search(later, queries, candidates=300)) == triples(G.cosine_top_k(later, queries))


def test_odd_vectors_and_few_hits(spark, tmp_path):
    """Vectors the index cannot hold are left out; a question that gets too few hits is answered exactly."""
    nan = float("nan")
    rows = [*noise(20, 4, 6), (100, 0, None), (101, 0, []), (102, 0, [1.0, 2.0]), (103, 0, [0.0] * 4), (104, 0, [nan] * 4), (105, None, [1.0] * 4), (106, 1, [1.0] * 4)]
    chunks = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CHUNK + ", score long")
    queries = spark.createDataFrame([(0, 0, rows[0][2]), (1, 1, [1.0, 0.0, 0.0, 0.0]), (2, 0, [1.0, 1.0]), (3, 0, None), (4, 9, [1.0] * 4)], QUERY)
    index = VectorIndex.create(chunks, str(tmp_path / "i"))
    index.append(chunks, "all")
    assert index.codes().count() == 22
    got = triples(index.search(chunks, queries, candidates=50))
    assert got == triples(G.cosine_top_k(chunks, queries))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        VectorIndex.create(chunks, str(tmp_path / "i"))


def test_an_index_of_nothing(spark, tmp_path):
    none, queries = spark.createDataFrame([], CHUNK), spark.createDataFrame(noise(3, 4, 7), QUERY)
    index = VectorIndex.create(none, str(tmp_path / "i"))
    index.append(none, "all")
    assert index.search(none, queries).collect() == []
    rows = spark.createDataFrame(noise(10, 4, 8), CHUNK)
    index.append(rows, "more")  # learnt from nothing, it holds nothing, and the exact search answers
    assert triples(index.search(rows, queries)) == triples(G.cosine_top_k(rows, queries))


def test_the_sample_is_bounded(spark, tmp_path, monkeypatch):
    from cloakwork.operators import vector_index

    seen = []
    learnt = Quantizer.learnt.__func__
    monkeypatch.setattr(vector_index.Quantizer, "learnt", classmethod(lambda cls, v, *a: (seen.append(len(v)), learnt(cls, v, *a))[1]))
    many = spark.range(3 * SAMPLE).select(F.col("id").alias("chunk_id"), F.lit(0).cast("long").alias("org_id"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("embedding"))
    VectorIndex.create(many, str(tmp_path / "i"), cells=4)
    assert 0.9 * SAMPLE < seen[0] <= SAMPLE
