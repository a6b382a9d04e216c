"""The stages one by one, each against plain code on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest

from cloakwork.llm import language_id, secrets, toxicity
from cloakwork.llm.common import table, written

from .test_jaccard_join import plain


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """name → (input, output), with odd rows planted into the documents."""
    docs = table(spark, sf_dir, "documents")
    some = docs.limit(3).collect()
    extra = [*some, some[0], (90001, None, "en", "src1", 0), (90002, " ", "en", "src1", 1), (None, some[1]["text"] + " more", "en", None, 5), (90003, "here AKIA" + "B" * 16 + " it is", "en", "src1", 30)]
    docs = written(docs.unionByName(spark.createDataFrame([tuple(r) for r in extra], docs.schema)), "with-odd-rows")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), "stage")
        out[name] = docs, after
        docs = after
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "jaccard_join", "secret_scan", "packing"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.schema == before.schema, name


def test_language(stages):
    before, after = stages["language_id"]
    kept = {(r["doc_id"], r["text_key"]) for r in language_id.identify(before, declared_col="lang", host_col="source").filter("kept").collect()}
    want = [r for r in before.selectExpr("*", "xxhash64(coalesce(text, '')) as k").collect() if (r["doc_id"], r["k"]) in kept]
    assert rows_of(after) == sorted((tuple(r)[:-1] for r in want), key=str)
    assert before.count() - after.count() >= 2


def test_toxicity(stages, spark, sf_dir):
    before, after = stages["toxicity"]
    net = toxicity.train(before, table(spark, sf_dir, "labels"))
    want = [tuple(r) for r in before.collect() if toxicity.score_texts(net, [r["text"] or ""])[0] < 0.5]
    assert rows_of(after) == sorted(want, key=str)


def test_one_of_each_group(stages):
    before, after = stages["jaccard_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    groups = {c for _, n, c in plain(rows, 4, 5, 5) if n}
    got = [r["doc_id"] for r in after.collect()]
    assert sorted(got, key=str) == sorted(groups, key=str)
    assert set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))


def test_masked(stages):
    before, after = stages["secret_scan"]
    want = []
    for r in before.collect():
        t = secrets.redact(r["text"])
        want.append((r["doc_id"], t, r["lang"], r["source"], len(t) if t != r["text"] else r["n_chars"]))
    assert rows_of(after) == sorted(want, key=str)
    assert not after.filter("text rlike 'AKIA[A-Z0-9]{12}'").count()


def test_packed(stages):
    before, after = stages["packing"]
    ids = {r["doc_id"] for r in before.collect()}
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == ids
    total = {}
    for r in rows:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in total.values())


def test_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "empty")
        assert docs.count() == 0, name


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
