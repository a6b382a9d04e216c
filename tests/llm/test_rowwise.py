"""URL filter, HTML extraction, secrets, BPE and packing: against SQL, libraries and plain code, with odd input."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cloakwork.llm import bpe, html_text, packing, secrets, url_filter
from cloakwork.llm.common import table
from cloakwork.llm.queries import load
from tools.check import compare, duck

DOC = "doc_id long, text string"
ODD = ["", "   ", "Straße ÀÉ İstanbul ΣΑΣ ﬁ", "你好 world 123½²", "a<|endoftext|>b <|startoftext|>", "it's I'LL we'd'", "e\u0301 naïve \x00\x01\x7f\xa0\xad", "😀😀 te\u200bst", "مرحبا", "don't''''re", "\x85\x1c ab c", None]


def odd_docs(spark):
    """Odd texts with repeated rows, null ids and clashing column names."""
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(0, "", "x", 1), (None, "a b", "x", 2), (3, ODD[3], "y", 3)]
    return spark.createDataFrame(rows, DOC + ", TEXT string, `doc_id.x` int"), [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("name", ["op4_exact_search", "op10_url_filter"])
def test_sql(name, spark, sf_dir):
    build, sql = load()[name]
    ok, note = compare(spark, duck(sf_dir), sf_dir, name, build, sql)
    assert ok, note


# --- urls


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        ("example.com/en/", ("", "", None, "allow")),
        ("http://A.Example.COM/en/x?q#f", ("a.example.com", "/en/x", "example.com/en/", "block")),
        ("http://m.www.example.com/en/x", ("m.www.example.com", "/en/x", "www.example.com/en/", "allow")),
        ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        ("http://x.com", ("x.com", "", None, "allow")),
        ("http://x.net/fr/a://b", ("x.net", "/fr/a://b", "net/fr/", "block")),
        ("http://porn.org/", ("porn.org", "/", None, "block")),
        ("http://xporny.org/", ("xporny.org", "/", None, "allow")),
        ("http://free.org/free/free", ("free.org", "/free/free", None, "allow")),
        ("http://free.org/a-bets", ("free.org", "/a-bets", None, "block")),
        ("http://a.org?x=/porn", ("a.org", "", None, "block")),
    ],
)
def test_urls(spark, url, want):
    df = spark.createDataFrame([(1, url, "u")], "page_id long, url string, URL string")
    assert [tuple(r)[1:5] for r in url_filter.judge_urls(df).collect()] == [want]


def test_no_urls(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


# --- pages


def test_pages_say_what_their_article_says(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    blocks = "|".join(html_text.BLOCKS)
    got = html_text.op9_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]
        article = page[page.index("<article>") :].split("</article>")[0].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(rf"</?(?:{blocks})\b[^>]*>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_page_without_marked_article(spark):
    words = "some plain words of the main text that go on for a while here"
    page = f"""<html><head><title>T</title></head><body><header><a href=x>Home</a> <a>About</a></header>
    <div class="cookie-notice">We use cookies, do you agree to all of them?</div><div id=sidebar><p>Side words one two three</p></div>
    <div class=content><h1>Head &amp; line</h1><p>{words}.</p><p>More&nbsp;<b>bo</b>ld {words}</p><aside>Advert words</aside><p>Last.</p></div>
    <form>Name <input name=a></form><div class="comments"><p>First! {words}</p></div><footer>&copy; us</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<nav><a>x</a>"), (1, "u", page), (6, "u", "plain words"), (7, "u", "<p>a" + " b" * 300_000)]
    got = {r[0]: r for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == f"Head & line\n\n{words}.\n\nMore bold {words}\n\nLast."
    assert [got[i]["text"] for i in (2, 3, 4, 5)] == [""] * 4 and got[6]["text"] == "plain words" and got[7]["n_chars"] == 600_001
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "elementor-widget-text-editor", "with-comments", "article-header", "sidebar", "comments", "related"])
def test_wrappers_named_like_side_parts(name):
    weights = html_text.fit_weights([])
    words = "some plain words of the main text that go on for a while here"
    side = "<nav><a>Home</a></nav><div class=sidebar><p>Side words one two</p></div>"
    for part in (f"<article><h1>Head line</h1><p>{words}.</p></article>", f"<main><h1>Head line</h1><p>{words}.</p></main>", f"<h1>Head line</h1><p>{words}.</p>"):
        for attribute in ("class", "id"):
            for end in ("</div>", ""):  # an unclosed one, too
                page = f'<html><head><title>T</title></head><body>{side}<div {attribute}="{name}">{part}{end}</body></html>'
                assert html_text.extract(page, weights)[0] == f"Head line\n\n{words}.", page
    if "sidebar" != name and name not in ("comments", "related"):  # a doubtful name without a main part
        page = f'<body>{side}<div class="{name}"><h2>Head line of it</h2></div><div class="{name}"><p>{words}.</p></div>'
        assert html_text.extract(page, weights)[0] == f"Head line of it\n\n{words}."
    page = f'<body><p>{words}.</p><div class="{name} ad-slot-1">Buy this</div><p>{words}!</p></body>'
    assert html_text.extract(page, weights)[0] == f"{words}.\n\n{words}!"


WORDS = "some plain words of the main text that go on for a while here"
ITEMS = "".join(f"<li>item {i}</li>" for i in range(30))


@pytest.fixture(scope="module")
def page_weights(spark, sf_dir):
    return [html_text.labelled_weights(table(spark, sf_dir, "pages").select("page_id", "html")), html_text.fit_weights([])]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # what an article holds stays, whatever it is made of or called
        (f"<article><h1>T</h1><p>Intro.</p><ul>{ITEMS}</ul><p>End.</p></article>", ["T", "Intro.", *[f"item {i}" for i in range(30)], "End."]),
        ("<article><h1>T</h1><p>Intro.</p><dl>" + "".join(f"<dt>w{i}</dt><dd>d{i}</dd>" for i in range(20)) + "</dl></article>", ["T", "Intro.", *[f"{c}{i}" for i in range(20) for c in "wd"]]),
        (f"<main><h1>T</h1><p>{WORDS}</p><table>" + "".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(20)) + "</table></main>", ["T", WORDS, *[c for i in range(20) for c in (str(i), "x")]]),
        (f'<article><h1>Two words</h1><p class="hidden-gem">{WORDS}</p></article>', ["Two words", WORDS]),
        (f'<article><h1>Two words</h1><div class="notice"><p>{WORDS}</p></div></article>', ["Two words", WORDS]),
        (f'<body><div><h1>Two words</h1><div class="hidden-gem"><p>{WORDS}</p></div></div>', ["Two words", WORDS]),
        (f'<article><p>{WORDS}</p><p class="related">One of a kind.</p><p class="social">Another of it.</p></article>', [WORDS, "One of a kind.", "Another of it."]),
        # readers' comments go
        (f'<article><h1>T</h1><p>{WORDS}</p><div class="comment-body"><p>{WORDS}</p></div><div class="comment-author">X</div></article>', ["T", WORDS]),
        (f'<article><p>{WORDS}</p><section id="comments-section-1"><p>First</p></section><p>End.</p></article>', [WORDS, "End."]),
        # without a mark, lists of the region's parent stay, but not those of links
        (f"<body><ul><li><a>Home</a></li><li><a>News</a></li></ul><div><h1>T</h1><p>{WORDS}</p><ul>{ITEMS}</ul><p>End.</p></div>", ["T", WORDS, *[f"item {i}" for i in range(30)], "End."]),
    ],
)
def test_articles_are_kept_whole(page_weights, page, want):
    for weights in page_weights:
        assert html_text.extract(page, weights)[0].split("\n\n") == want


def test_best_region_is_the_best_of_all():
    """The scan against all regions, on pages of tags whose weights do not depend on where a region begins."""
    weights = html_text.fit_weights([])
    rnd = random.Random(5)
    for _ in range(200):
        page = "".join(rnd.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a>", "</a>", "some words ", "one ", "<li>", "<h2>", "</h2>"]) for _ in range(rnd.randrange(1, 40)))
        found = list(html_text.tokens(page))
        gains, within = [], "body"
        for kind, value, *_ in found:
            if kind == "text":
                gains.append(len(value.split()) * weights.get("word " + within, weights["word "]))
            else:
                gains.append(weights.get(value, weights[""]))
                within = value if kind == "open" else "body"
        most = max([0.0] + [sum(gains[i:j]) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)])
        score, start, end = html_text.best_region(found, weights)
        assert score == pytest.approx(most) and sum(gains[start:end]) == pytest.approx(most)


def test_wrappers_that_hold_the_page():
    weights = html_text.fit_weights([])
    words = "some plain words of the main text that go on for a while here"
    body = f"<h1>Head line</h1><p>{words}.</p>"
    want = f"Head line\n\n{words}."
    for page in (
        f"<body><form id=f action=x><nav><a>Home</a></nav>{body}</form></body>",
        f"<head><title>T</title><meta name=a><body>{body}",  # the head has no end tag
        f"<body><div><nav><a>Home</a></div>{body.replace('h1', 'h2')}</body>",  # an unclosed menu ends with its holder
        f'<body><div class="sidebar"><p>x<div data-id="share" title="the hidden side">{body}</div></body>',
        f'<body><div class="hidden md:block">{body}</div><div hidden><p>{words}</p></div></body>',
        f"<body><ul><li class=ad>Buy<li>one</ul>{body}</body>",
    ):
        got = html_text.extract(page, weights)[0]
        assert want in got and "Buy" not in got and "Home" not in got, page
    deep = '<div class="sidebar">' * 20_000 + body
    assert html_text.extract(deep, weights)[0] == want


# --- secrets

BASE = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def plain_base(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.A):
            if {"assign": kind == "assign" and len(m[2]) >= 8, "access": len(m[0]) >= 16, "hex": len(m[0]) >= 32}[kind]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_base_secrets(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    rng = random.Random(3)
    parts = ["token", "Password", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH0123", "deadbeef" * 3, "0f" * 9, "é", "abcdefgh", "\n", "-", "x"]
    rows += [(10**6 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(None, None), (7, "")]
    got = {(r["doc_id"], r["text_"]): r for r in secrets.scan_secrets(spark.createDataFrame(rows, DOC)).selectExpr("*", "cast(null as string) text_").collect()}
    by_id = Counter()
    for i, t in rows[:-1]:
        want = plain_base(t)
        if i == 7:
            continue
        r = got[i, None]
        assert r["base"] == ",".join(want), t
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in BASE)
        assert set(want) <= set(filter(None, r["spans"].split(",")))
        by_id[i] += 1
    full = secrets.op7_secret_scan(spark, sf_dir).collect()
    texts = dict(rows)
    assert all(r["base_sha256"] == hashlib.sha256(",".join(plain_base(texts[r["doc_id"]])).encode()).hexdigest() for r in full if r["doc_id"] != 7)


def test_linked_secrets():
    word = "aB3dE5gH7jK9mN1pQ3rS5"
    kinds = lambda t: [secrets.KINDS[s.kind] for s in secrets.find_secrets(t)[1]]
    assert kinds(f"user: bob\npw {word} http://x.example.com/a") == ["weak_access", "weak_secret", "endpoint"]
    assert kinds(f"pw {word} http://x.example.com/a") == [] == kinds("user: bob") == kinds("user: bob http://a.b/c")
    assert kinds(f"AKIA{'A' * 12} {word}") == ["access", "weak_secret"]
    assert kinds(f"AKIA{'A' * 12}\n\n{word}") == ["access"]  # another scope
    assert kinds(f"AKIA{'A' * 12} {'x ' * 200} {word}") == ["access"]  # too far
    assert kinds(f"http://a.b/c token=abcdefgh {'x ' * 300} http://d.e/f") == ["endpoint", "assign"]
    assert secrets.redact(f"id AKIA{'A' * 12} t='{word}' ok") == "id [SECRET] t='[SECRET]' ok"
    assert secrets.redact("nothing here") == "nothing here"


@pytest.mark.parametrize("word", ["aB3dE5gH7jK9mN1pQ3rS5", "aB3dE5gH7jK9mN1pQ3r+S5==", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"])
def test_linked_secrets_after_an_equals_sign(word):
    key = "AKIA" + "B7" * 8
    kinds = lambda t: [secrets.KINDS[s.kind] for s in secrets.find_secrets(t)[1]]
    for text in (
        f"aws_access_key_id={key}\naws_secret_access_key={word}\n",  # .env
        f"[default]\naws_access_key_id = {key}\naws_secret_access_key = {word}\n",  # ini
        f"export AWS_ACCESS_KEY_ID='{key}' AWS_SECRET_ACCESS_KEY={word}",
        f"GET /list?id={key}&sig={word}&page=2",
    ):
        assert kinds(text) == ["access", "weak_secret"]
        assert secrets.redact(text) == text.replace(key, "[SECRET]").replace(word, "[SECRET]")
    assert kinds(f"https://h.example.com/a?client_id=bob&sig={word}") == ["endpoint", "weak_access", "weak_secret"]
    assert kinds(f"a={word}") == [] == kinds(f"AKIA a={word}")  # nothing beside it
    assert kinds(f"{key} {word}====") == ["access"]  # more than padding


# --- BPE


def test_bpe_is_the_librarys(spark, sf_dir):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, rows = odd_docs(spark)
    rows += [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter(tuple(r) for df in (bpe.digest_documents(docs), bpe.op6_bpe(spark, sf_dir)) for r in df.collect())
    assert got == want
    full = bpe.encode_documents(docs).filter("doc_id = 2").first()
    assert tok.encode(ODD[2], add_special_tokens=False).ids == list(struct.unpack(f"<{full['n_tokens']}I", full["ids"]))


def test_cuts_are_certain():
    coder = bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))
    merged = {p for p in coder.pieces.values()}
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("qzjxwkäéß7abc") for _ in range(rng.randint(1, 12))).encode().decode("latin-1").translate(coder.byte_symbols)
        cuts = coder.cut(word)
        assert "".join(cuts) == word
        for a, b in zip(cuts, cuts[1:]):
            assert not any(a[-1] + b[0] in p.removesuffix("</w>") for p in merged)


# --- packing


def test_packing_is_whole(spark, sf_dir):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd, rows = odd_docs(spark)
    for df, pairs in ((odd, rows), (table(spark, sf_dir, "documents"), None)):
        pairs = pairs or [tuple(r) for r in df.select("doc_id", "text").collect()]
        pieces = packing.pack_documents(df, window=50).collect()
        ids = Counter()
        for i, t in pairs:
            ids[i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (0,)] += 1
        known = {(i, len(x)): [] for i, x in ids}
        for (i, x), n in ids.items():
            known[i, len(x)] += [x] * n
        left = Counter({k: sum(map(len, v)) for k, v in known.items()})
        sequences = {}
        for p in pieces:
            key = p["doc_id"], p["doc_tokens"]
            cut = {zlib.crc32(struct.pack(f"<{p['length']}I", *x[p["start"] : p["start"] + p["length"]])) for x in known[key]}
            assert p["ids_crc32"] in cut and p["length"] > 0
            left[key] -= p["length"]
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert not any(left.values())
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert packing.pack_documents(spark.createDataFrame([], DOC)).collect() == []


def test_fill_is_the_best_multiset():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randint(1, 12) for _ in range(7)]
        room = rng.randint(0, 40)
        best = max(s for k in range(8) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room)
        chosen = packing.fill(dict(Counter(lengths)), room)
        assert sum(n * c for n, c in chosen.items()) == best and all(c <= Counter(lengths)[n] for n, c in chosen.items())


def test_bins_are_full_or_left_over():
    rng = random.Random(2)
    lengths = [rng.randint(1, 99) for _ in range(500)]
    bins, rest = packing.pack_items(lengths, 100)
    assert sorted([*(i for b in bins for i in b), *rest]) == list(range(500))
    assert all(sum(lengths[i] for i in b) == 100 for b in bins)
    assert bins
