"""HTML extraction: the contiguous region of the page with the highest sum of word and tag weights.

Words score above zero, tags below; both weights are log odds of lying in the article, counted on labelled pages (those
that mark their article) and smoothed by the prior counts below. One linear scan finds the best region; the text is what
the region's blocks say, without elements that are no text of the author's (menus, adverts, forms, comments ...).
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import spread
from .common import map_lists, pick, register, table

#: Labelled pages the weights are counted on, at most, and the longest of them in characters.
LABELLED_PAGES = 400
LABELLED_CHARS = 200_000

BLOCKS = frozenset(
    "html body head title article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre "
    "figure figcaption header footer nav aside form fieldset address details summary hr dialog menu template noscript iframe svg".split()
)
SPACES = frozenset(("br", "wbr", "img"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that hold parts of a page; one that ends ends what began within it.
HOLDERS = frozenset("article main section div table td ul ol".split())
#: Elements whose content is no markup.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"))
#: Elements whose end tag may be left out.
ENDLESS = frozenset("p li dt dd tr td th thead tbody tfoot option head".split())
#: What an opening tag ends, up to the nearest holder of such parts.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")),
        "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: An element that holds one of these is never left out as a whole.
MAIN_PARTS = frozenset(("article", "main", "h1"))
#: Elements that are never part of the main text, and words of class, id or role that say the same. A name says it only as a whole, or
#: if all its words are of these or of the fillers ("cookie-notice", "ad-slot-1"); else ("has-sidebar"), or where all its words are
#: vague, the element enters the scan with the weight of "outside" on its opening tag.
OUTSIDE = RAW | frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video label".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notification banner popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended comment comments commentlist discussion disqus reply replies respond footer header masthead toolbar pagination pager widget hidden "
    "contentinfo complementary search".split()
)
#: Names that begin with one of the first are parts of readers' comments if they go on with nothing but the second.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
COMMENT_PARTS = frozenset("area author avatar body card container content date form head inner link main meta name para paragraph row section text thread time title wrap wrapper".split())
#: Elements that are text themselves, and names that say nothing against one: a sentence about related things is a sentence.
SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figure figcaption".split())
NO_SIDE_PARTS = frozenset("related social recommended share sharing notice header search".split())
#: Elements of lists and tables. In the element in which the best region begins they are read as text, unless they are links.
LISTS = frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th".split())
#: What words weigh at least, and tags at most, in a marked article and in such lists.
TRUSTED_WORD, TRUSTED_TAG = 0.05, -0.001
FILLERS = frozenset("bar box button buttons item items list slot unit".split())
VAGUE = frozenset("discussion header hidden notice search side widget".split())
#: How far an element is outside: not at all, by a doubtful name, by its name, by what element it is.
INSIDE, DOUBTFUL, NAMED, ELEMENT = range(4)
#: Prior counts (inside the article, outside it) of tags and of words by the tag they stand in.
PRIOR = {"p": (8, 1), "h1": (4, 1), "h2": (4, 1), "article": (4, 1), "main": (4, 1), "section": (2, 1), "b": (2, 1), "i": (2, 1), "em": (2, 1), "br": (2, 1),
         "blockquote": (4, 1), "pre": (4, 1), "li": (1, 2), "a": (1, 3), "ul": (1, 2), "div": (1, 1), "header": (1, 4), "outside": (1, 60)}
OTHER = (1, 1)
#: Words weigh at least and at most so much, tags between the negatives of these.
WORD_RANGE = (0.002, 2.0)
TAG_RANGE = (0.01, 8.0)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_HIDDEN_VALUE = re.compile(r"""aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD_BREAK = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


def _outside(name: str, attributes: str, in_article: bool) -> int:
    if name in OUTSIDE or (name == "header" and not in_article):
        return ELEMENT
    if not attributes or name in ("html", "body", "article", "main"):
        return INSIDE
    if _HIDDEN_VALUE.search(attributes) or _HIDDEN.search(_QUOTED.sub("", attributes)):
        return NAMED
    found = INSIDE
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = [w for w in _WORD_BREAK.split(token) if w]
            said = OUTSIDE_NAMES.intersection(words)
            if name in SENTENCES:
                said = said - NO_SIDE_PARTS
            if not said:
                continue
            if words[0] in COMMENTS and all(w in OUTSIDE_NAMES or w in FILLERS or w in COMMENT_PARTS or w.isdigit() for w in words):
                return NAMED
            if all(w in OUTSIDE_NAMES or w in FILLERS or w.isdigit() for w in words) and (m[1].lower() == "role" or not said <= VAGUE):
                return NAMED
            found = DOUBTFUL
    return found


class _Open:
    """The elements open at one place, and for each that ended: the index of the token after it, and if it had an end of its own."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.ends: dict[int, tuple[int, bool]] = {}

    def place(self, names: Iterable[str]) -> int:
        """Place in the stack of the innermost element of these names, -1 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int, at: int) -> None:
        """Ends all from `place` on before token `at`."""
        while len(self.stack) > place:
            name, index = self.stack.pop()
            self.places[name].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.ends[index] = at, name in ENDLESS

    def open(self, name: str, at: int) -> None:
        head = self.place(("head",))
        if head >= 0 and head == len(self.stack) - 1 and name not in IN_HEAD:
            self.cut(head, at)
        if name in BLOCKS and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self.cut(self.blocks[-1], at)
        if name in ENDS:
            old, holders = ENDS[name]
            place = self.place(old)
            if place > self.place(holders):
                self.cut(place, at)
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((name, at))

    def close(self, name: str, at: int) -> None:
        """An end tag ends what began within its element, but one of a phrase ends no block. Without an element it ends nothing."""
        place = self.place((name,))
        if place < 0 or (name not in BLOCKS and name not in OUTSIDE and self.blocks and self.blocks[-1] > place):
            return
        index = self.stack[place][1]
        self.cut(place, at)
        self.ends[index] = at + 1, True


def _read(page: str) -> tuple[list[tuple], dict[int, tuple[int, bool]], list[int]]:
    """Tokens (text,) or (name, closing, attributes), where elements end, and how many main parts open before each token."""
    found, opened, mains, n_mains = [], _Open(), [], 0
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                found.append((html_lib.unescape(m[0]),))
                mains.append(n_mains)
            continue
        name, closing, alone = m[2].lower(), bool(m[1]), m[2].lower() in VOID or m[3].endswith("/")
        here = len(found)
        found.append((name, closing, m[3]))
        mains.append(n_mains)
        if closing:
            opened.close(name, here)
        elif name in RAW:
            if not alone:
                close = _raw_end(name).search(page, at)
                at = close.end() if close else end
            opened.ends[here] = here + 1, True
        elif not alone:
            n_mains += name in MAIN_PARTS
            opened.open(name, here)
    opened.cut(0, len(found))
    mains.append(n_mains)
    return found, opened.ends, mains


@lru_cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I)


def tokens(page: str) -> Iterable[tuple[str, str, bool, bool]]:
    """(kind, value, doubtful, marked): kind "open" or "close" with the tag's name, or "text" with decoded text; whether the
    tag's name is doubtful, and whether this stands in an article or main element.

    Everything within an element that is outside the text comes as one "open" of the name "outside". An element that holds a main part,
    or that only its name puts outside and that has no end, is read like any other; its opening tag is doubtful.
    """
    found, ends, mains = _read(page)
    at, in_article = 0, 0
    while at < len(found):
        token, here = found[at], at
        at += 1
        if len(token) == 1:
            yield "text", token[0], False, in_article > 0
            continue
        name, closing, attributes = token
        outside = INSIDE if closing else _outside(name, attributes, in_article > 0)
        if outside > DOUBTFUL:
            after, ended = ends.get(here, (at, True))
            if mains[after] == mains[here] + (name in MAIN_PARTS) and (ended or outside == ELEMENT):
                at = after
                yield "open", "outside", False, in_article > 0
                continue
            outside = DOUBTFUL
        if name in ("article", "main"):
            in_article = max(in_article - 1, 0) if closing else in_article + 1
        yield "close" if closing else "open", name, outside == DOUBTFUL, in_article > 0


def count_labels(page: str) -> tuple[Counter, Counter]:
    """Of a page that marks its article: how often each tag, and each word's tag, lies inside and outside of it."""
    inside, outside, depth, within = Counter(), Counter(), 0, "body"
    if not re.search(r"<article\b", page, re.I) or not re.search(r"</article", page, re.I):
        return inside, outside
    for kind, value, *_ in tokens(page):
        if kind == "text":
            (inside if depth else outside)["word " + within] += len(value.split())
            continue
        if value == "article":
            depth += 1 if kind == "open" else -1
            inside[value] += 1
        else:
            (inside if depth else outside)[value] += 1
        within = value if kind == "open" and value not in VOID | {"outside"} else "body"
    return inside, outside


def fit_weights(pages: Iterable[str]) -> dict[str, float]:
    """Weights by feature: a tag's name (below zero), or "word " and the tag that the word follows (above zero)."""
    inside, outside = Counter(), Counter()
    for page in pages:
        a, b = count_labels(page)
        inside.update(a), outside.update(b)
    names = {n.removeprefix("word ") for n in [*inside, *outside]} | set(PRIOR) | {""}
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    scale = min(1.0, n_out / n_in)  # long articles must not make every tag look like theirs
    weights = {}
    for n in names:
        prior = PRIOR.get(n, OTHER)
        tag = math.log((inside[n] * scale + prior[0]) / (outside[n] + prior[1]))
        word = math.log((inside["word " + n] * scale + prior[0]) / (outside["word " + n] + prior[1]))
        weights[n] = -min(max(-tag, TAG_RANGE[0]), TAG_RANGE[1])
        weights["word " + n] = min(max(word, WORD_RANGE[0]), WORD_RANGE[1])
    return weights


def best_region(found: list[tuple], weights: dict[str, float], lists: range = range(0)) -> tuple[float, int, int]:
    """(score, start, end) of the best region of the tokens; of equal ones the first that ends, and of those the longest.

    One linear scan: a run that has fallen to nothing starts anew. In a marked article a tag costs next to nothing and
    every word counts, so that lists, tables and names end no run there; the same holds for lists in the range `lists`.
    What is outside the text by itself weighs in full only where the element has ended in which the run began: an advert
    between two paragraphs does not part them. A doubtful name weighs only before a heading.
    """
    best, run, start, within = (0.0, 0, 0), 0.0, 0, "body"
    depth, run_depth, headed = 0, 0, False
    unseen, unseen_word = weights[""], weights["word "]
    for i, (kind, value, doubtful, marked) in enumerate(found):
        if kind == "text":
            gain = weights.get("word " + within, unseen_word)
            if marked or (within in LISTS and i in lists):
                gain = max(gain, TRUSTED_WORD)
            gain *= len(value.split())
        else:
            if value in HOLDERS:
                depth += 1 if kind == "open" else -1
            gain = -TAG_RANGE[0] if value == "outside" and depth >= run_depth else weights.get(value, unseen)
            if marked or (value in LISTS and i in lists):
                gain = max(gain, TRUSTED_TAG)
            elif doubtful and not headed:
                gain += weights["outside"]
            within = value if kind == "open" and value not in VOID | {"outside"} else "body"
        if run <= 0:
            run, start, run_depth, headed = 0.0, i, depth, False
        headed = headed or value == "h1"
        run += gain
        if run > best[0]:
            best = run, start, i + 1
    return best


def _holder(found: list[tuple], at: int) -> range:
    """The tokens of the innermost element around token `at`, or that it opens, which is neither a list nor a table."""
    outer: list[tuple[str, int]] = []
    for i, (kind, name, *_) in enumerate(found[: at + 1]):
        if kind == "text" or name not in HOLDERS or name in LISTS:
            continue
        if kind == "open":
            outer.append((name, i))
        elif any(n == name for n, _ in outer):
            while outer.pop()[0] != name:
                pass
    if not outer:
        return range(0)
    name, start = outer[-1]
    depth = 0
    for i in range(start, len(found)):
        if found[i][1] == name and found[i][0] != "text":
            depth += 1 if found[i][0] == "open" else -1
            if not depth:
                return range(start, i + 1)
    return range(start, len(found))


def extract(page: str, weights: dict[str, float]) -> tuple[str, float]:
    """(text, score) of the best region; ("", 0) for a page without words. Where no article is marked, the region is sought
    a second time with the lists of its parent element read as text."""
    found = list(tokens(page))
    best = best_region(found, weights)
    if best[0] and not found[best[1]][3]:
        best = best_region(found, weights, _holder(found, best[1]))
    blocks, now = [], []
    for kind, value, *_ in found[slice(*best[1:])]:
        if kind == "text":
            now.append(value)
        elif value in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif value in SPACES or value == "outside":
            now.append(" ")
    blocks.append("".join(now))
    clean = (_SPACE.sub(" ", b).strip() for b in blocks)
    return "\n\n".join(b for b in clean if b), best[0]


def labelled_weights(rows: DataFrame, limit: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most `limit` labelled pages, those with the smallest hash of (page_id, html length)."""
    order = F.xxhash64("page_id", F.length("html"))
    marked = rows.filter(F.lower("html").contains("<article") & (F.length("html") <= LABELLED_CHARS))
    cut = marked.select(order.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if cut is None:
        return fit_weights([])
    return fit_weights(r[0] for r in marked.filter(order <= F.lit(cut)).select("html").limit(limit).collect())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: int = LABELLED_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), score of the region.

    Null or empty html, and pages without words, give an empty text. Truncated pages are read as far as they go.
    Repeated rows come once each; other columns are left out. Row-local but for the bounded sample of labelled pages.
    """
    rows = spread(pick(pages, page_id=id_col, url=url_col, html=html_col))
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    weights = labelled_weights(rows, labelled)

    def make() -> Callable:
        def step(ids: list, urls: list, htmls: list) -> list[list]:
            found = [extract(h, weights) for h in htmls]
            return [ids, urls, [t for t, _ in found], [len(t) for t, _ in found], [s for _, s in found]]

        return step

    return map_lists(rows, make, "page_id long, url string, text string, n_chars long, score double")


@register("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
