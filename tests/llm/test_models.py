"""Exact search, toxicity and language identification: odd input, brute force, gradients and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from math import floor, inf, nan

import numpy as np
import pytest

from cloakwork.llm import exact_search, language_id, toxicity
from cloakwork.llm.common import table

DOC = "doc_id long, text string"

# --- search


@pytest.mark.parametrize("seed", [1, 2])
def test_search_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, list(rows[7][1])) for i in range(300, 420)]  # one common vector: many ties
    rows += [(420, None), (421, [None] * 6), (422, [nan] * 6), (423, [inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (450, [0.5] * 3), (451, [0.25] * 3), (455, []), (None, [0.1] * 6), rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, `Embedding` int")
    kept = [(i, [floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and x - x == 0 for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in kept if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q and len(w) == len(v))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    got = exact_search.exact_top_k(df, lambda i: i % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_search_of_nothing(spark):
    assert exact_search.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 50 == 0).collect() == []


def test_bounds_hold_and_few_vectors_are_read():
    rng = np.random.default_rng(1)
    exact = rng.integers(-150, 150, (500, 16))
    cells, low, width = exact_search.approximate(exact)
    corner = low + cells.astype(np.int64) * width
    assert (corner <= exact).all() and (exact < corner + width).all()


def test_search_sends_no_vector_through_the_driver(spark):
    """No broadcast, and copies of the questions that follow the rows, not the number of shuffle partitions."""
    rng = np.random.default_rng(2)
    exact = rng.integers(-100, 100, (3000, 8))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(exact)], "vec_id long, embedding array<double>")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        found = exact_search.exact_top_k(df, lambda i: i % 50 == 0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan
        tiles = re.findall(r"Exchange shufflepartitionidpassthrough\(.*, (\d+)\)", plan, re.I)
        assert tiles and max(map(int, tiles)) <= 2 * spark.sparkContext.defaultParallelism + 3000 // (2 * 60)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    scores = exact[::50] @ exact.T
    want = {(50 * q, r + 1): (i, -s) for q in range(60) for r, (s, i) in enumerate(sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != 50 * q)[:5])}
    assert got == want


@pytest.mark.parametrize(("size", "odd"), [(150, False), (150, True), (1 << 21, False), (1 << 28, True)])
def test_groups_meet_blocks_by_brute_force(size, odd):
    """Products in float32, float64 and beyond its whole numbers; repeated and common vectors, and one far off in its block."""
    rng = np.random.default_rng(size + odd)
    exact = rng.integers(-size, size, (9000, 12))
    exact[4000:4300] = exact[7]
    ids = np.arange(9000)
    ids[8000:] = ids[:1000]  # ids that come twice
    if odd:
        exact[5000, 3] = 4 * size
    asked = np.concatenate([np.arange(0, 600), np.arange(8000, 8100)])
    group = exact_search.Group(ids[asked], asked, exact[asked], 5)
    blocks = [(ids[at : at + 700], *exact_search.cut(exact[at : at + 700])) for at in range(0, 9000, 700)]
    for i in range(0, len(blocks), 4):
        group.search(blocks[i : i + 4])
    got = {}
    for columns in group.hits():
        for q, key, vec_id, score in zip(*(c.tolist() for c in columns)):
            got.setdefault((q, key), []).append((-score, vec_id))
    scores = exact[asked] @ exact.T
    for row, key in zip(scores, asked.tolist()):
        other = np.flatnonzero(ids != ids[key])
        best = other[np.lexsort((ids[other], -row[other]))[:5]]
        assert got[int(ids[key]), key] == [(-int(row[i]), int(ids[i])) for i in best]


def test_groups_of_one_common_vector():
    """All scores are alike: the smallest ids, over several calls."""
    exact = np.full((9000, 8), 3)
    ids = np.random.default_rng(5).permutation(9000)
    group = exact_search.Group(np.arange(20), np.arange(20), exact[:20], 5)
    for at in range(0, 9000, 3000):
        group.search([(ids[at : at + 3000], *exact_search.cut(exact[at : at + 3000]))])
    (queries, _, found, scores), = group.hits()
    assert found.reshape(20, 5).tolist() == [[i for i in range(6) if i != q][:5] for q in range(20)] and set(scores.tolist()) == {72}
    assert queries.tolist() == np.repeat(np.arange(20), 5).tolist()


def test_groups_with_few_candidates():
    """Fewer than k others, all of one id, or none at all."""
    exact = np.arange(12).reshape(4, 3)
    group = exact_search.Group(np.array([1, 1, 2]), np.arange(3), exact[:3], 5)
    assert all(len(c) == 0 for columns in group.hits() for c in columns)
    group.search([(np.array([1, 1, 1, 2]), *exact_search.cut(exact))])
    assert sorted(zip(*(c.tolist() for c in next(group.hits())))) == [(1, 0, 2, 32), (1, 1, 2, 122), (2, 2, 1, 23), (2, 2, 1, 86), (2, 2, 1, 149)]


def test_blocks_keep_exact_vectors():
    rng = np.random.default_rng(4)
    far = np.array([[-(2**63), 0, 5], [2**63 - 1, 0, 5], [0, 1, 5]])
    for exact in (far, rng.integers(-150, 150, (500, 16)), rng.integers(-(2**62), 2**62, (50, 3)), far[:1]):
        cells, above, low, width = exact_search.cut(exact)
        assert cells.dtype == np.uint8 and (low + cells.astype(np.int64) * width + above.astype(np.int64) == exact).all()
    assert exact_search.cut(rng.integers(-150, 150, (500, 16)))[1].dtype == np.uint8


# --- toxicity


def test_gradients():
    net = toxicity.Network(1)
    rng = np.random.default_rng(0)
    net.p = {n: v.astype(np.float64) for n, v in net.p.items()}
    rows = rng.integers(0, 1 << toxicity.TABLE_BITS, (toxicity.WINDOW, 3, 6))
    filled = np.ones((toxicity.WINDOW, 3), bool)
    filled[20:, 1] = False
    labels, weights = np.array([1.0, 0, 1]), np.ones(3)
    g, _ = net.gradients(rows, filled, labels, weights)
    for n in ("in_f", "rec_f", "rec_b", "bias_b", "attend", "out", "b", "table"):
        at = (rows[0, 0, 0], 2) if n == "table" else tuple(min(1, s - 1) for s in net.p[n].shape)
        old, losses = net.p[n][at], []
        for step in (1e-3, -1e-3):
            net.p[n][at] = old + step
            losses.append(net.gradients(rows, filled, labels, weights)[1])
        net.p[n][at] = old
        assert abs(g[n][at] - (losses[0] - losses[1]) / 2e-3) < 1e-4 * max(1, abs(g[n][at]))


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        starts = toxicity.window_starts(n)
        covered = {w for s in starts for w in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 7)))
    bad = [("grk" + word()) for _ in range(300)]  # bad words share a beginning only
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 150))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0), 9))
    rows += [(2000, None), (2001, ""), (2002, "!!! ..."), (None, "na na"), (2003, "la " * 200_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, "T") for r in rows], DOC + ", Text string")
    net = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int"))
    got = toxicity.score_documents(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.93 * len(held)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (2000, 2001, 2002))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOC)
    for labels in ([], [(1, 0)], [(1, 1)]):
        net = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["predicted"] for r in toxicity.score_documents(docs, net).collect()] == [0, 0]
    assert toxicity.score_documents(spark.createDataFrame([], DOC), net).collect() == []


# --- language


def test_languages_of_the_documents(spark, sf_dir):
    got = language_id.op1_language_id(spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert sum(r["lang"] == r["declared"] for r in got) >= 0.97 * len(got)
    assert sum(not r["kept"] for r in got) <= 0.01 * len(got)


def test_languages_of_the_pages(spark, sf_dir):
    pages = language_id.page_evidence(table(spark, sf_dir, "pages"))
    got = language_id.identify(pages, declared_col="declared", host_col="host").collect()
    assert got and sum(r["lang"] == r["declared"] for r in got) >= 0.98 * len(got)


def test_evidence_is_fused(spark):
    en, fr = "the cat and the dog were on the road again " * 4, "le chat et le chien sont encore sur la route "  * 4
    rows = [(i, en, "en", "a.example.com") for i in range(60)] + [(100 + i, fr, "fr", "b.example.fr") for i in range(60)]
    rows += [
        (200, "ok", None, "x.b.example.fr"), (201, "ok", None, "a.example.com"), (202, "ok", "fr", None), (203, "", None, None), (204, None, "en", "a.example.com"),
        (205, en, "fr", "b.example.fr"), (206, "Ж" * 300, None, None), (207, "  \n", "en", None), (None, fr, "EN ", "."), (205, en, "fr", "b.example.fr"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", lang string, host string, LANG int")
    got = {r["doc_id"]: r for r in language_id.identify(df, declared_col="lang", host_col="host").collect()}
    assert (got[0]["lang"], got[100]["lang"], got[205]["lang"]) == ("en", "fr", "en")  # long text outweighs the rest
    assert (got[200]["lang"], got[201]["lang"], got[202]["lang"]) == ("fr", "en", "fr")  # short text: host, declared
    assert got[206]["lang"] == language_id.NONE and not got[206]["kept"]
    assert not got[203]["kept"] and not got[204]["kept"] and not got[207]["kept"] and got[200]["kept"]
    assert language_id.identify(spark.createDataFrame([], DOC)).collect() == []


def test_every_declared_language_is_known(spark):
    """More languages than fifty, each in a script of its own, and one declared on a long text only."""
    rng = random.Random(8)
    rows, lone = [], 60
    for k in range(lone + 1):
        letters = [chr(0x1200 + 24 * k + j) for j in range(24)]
        text = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
        rows += [(100 * k + i, text(60), f"l{k}") for i in range(4 if k < 50 else 2)] if k < lone else [(100 * k, text(6000), f"l{k}")]
    rows += [(9000, "Ж" * 300, None), (9001, "щ" * 300, "none"), (9002, " ", "l1")]
    df = spark.createDataFrame(rows, DOC + ", lang string")
    got = {r["doc_id"]: r for r in language_id.identify(df, declared_col="lang").collect()}
    assert all(got[i]["lang"] == lang and got[i]["kept"] for i, _, lang in rows if i < 9000)
    assert not any(got[i]["kept"] for i in (9000, 9001, 9002))


def test_the_sample_is_bounded_by_rows(spark):
    rows = [(i, f"text {i}", "en") for i in range(700)] + [(None, f"t {i:04d}", "de") for i in range(700)] + [(1, "same", "fr")] * 700 + [(2, "x" * 50_000, "it"), (3, "", "es"), (4, "a b", None)]
    sample = list(language_id.labelled_sample(spark.createDataFrame(rows, DOC + ", declared string")))
    counts = {lang: sum(x == lang for x, _ in sample) for lang in ("en", "de", "fr", "it")}
    assert counts == {"en": 400, "de": 400, "fr": 400, "it": 1} and len(sample) == 1201
    assert max(len(t) for _, t in sample) == language_id.SAMPLE_CHARS


def test_nothing_declared_keeps_all(spark):
    rows = [(1, "the cat and the dog", None), (2, "Ж" * 300, None), (3, " ", None), (4, "ok", "")]
    df = spark.createDataFrame(rows, DOC + ", lang string")
    for declared in ("lang", None):
        got = {r["doc_id"]: r["kept"] for r in language_id.identify(df, declared_col=declared).collect()}
        assert got == {1: True, 2: True, 3: False, 4: True}


def test_priors_by_plain_code(spark):
    """The fusion of one row against the formula, from the scores that the text model gives."""
    rng = random.Random(2)
    words = {"en": "the and was with from that have".split(), "de": "der und war mit von dass haben".split()}
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(2, 9))), rng.choice(["en", "de", None]), rng.choice(["a.x.de", "b.x.de", "y.com", "plain", None])))
    df = spark.createDataFrame(rows, DOC + ", lang string, host string")
    model = language_id.TextModel(language_id.labelled_sample(df.withColumnRenamed("lang", "declared")))
    logs = [np.array(model.evidence(r[1])[1]) for r in rows]
    p = np.array([np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in logs])
    k = p.shape[1]
    prior = (p.sum(axis=0) + 1 / k) / (len(rows) + 1)
    host = [r[3] for r in rows]
    domain = [h and ".".join(h.split(".")[-2:]) for h in host]
    suffix = [h.split(".")[-1] if h and "." in h else None for h in host]
    got = {r["doc_id"]: r for r in language_id.identify(df, declared_col="lang", host_col="host").collect()}

    def rest(values, i):
        return sum((p[j] for j, v in enumerate(values) if v is not None and v == values[i] and j != i), np.zeros(k))

    for i, _ in enumerate(rows):
        total = logs[i].copy()
        for values in ([r[2] for r in rows], suffix):
            if values[i] is not None:
                total += np.log((rest(values, i) + prior) / (p.sum(axis=0) + 1) + 1e-9)
        d = (rest(domain, i) + language_id.DOMAIN_WEIGHT * prior) / (rest(domain, i).sum() + language_id.DOMAIN_WEIGHT)
        h = (rest(host, i) + language_id.HOST_WEIGHT * d) / (rest(host, i).sum() + language_id.HOST_WEIGHT)
        total += np.log(h + 1e-12)
        assert got[i]["lang"] == model.classes[int(total.argmax())]
        assert abs(got[i]["probability"] - 1 / np.exp(total - total.max()).sum()) < 1e-6
