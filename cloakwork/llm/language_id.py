"""Language identification by fusing evidence: text, declared language, address suffix and host.

    P(lang | everything) ~ P(text | lang)^t * P(declared | lang) * P(suffix | lang) * P(lang | host)

Text likelihoods come from byte trigrams, fitted on a bounded sample of rows that declare their language. The other three
are grouped aggregates over all rows, of what the texts alone say: a host's prior is smoothed towards its domain's, and
that towards the prior of all rows; a row's own share is taken out of its host's and domain's counts, so that no text is
heard twice. One more class, `NONE`, stands for text in no known language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import spread
from .common import ascii_lower, map_lists, pick, register, table, written

NONE = "none"
#: The sample the text model is fitted on: rows of each declared language, and how many characters of each text.
ROWS_PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000
#: Languages whose samples are on the driver at one time.
LANGUAGES_AT_ONCE = 16

GRAM_BITS = 15
#: A trigram of no language: evenly likely over so many trigrams.
NONE_GRAMS = 1 << 14
#: Trigrams of one text depend on each other, so they count as this many at most, and for this share each.
MOST_GRAMS = 200
SHARE = 0.25
#: Rows that a domain's and a host's prior count for in the level below, and the pseudo-counts of declared and suffix values.
DOMAIN_WEIGHT = 10.0
HOST_WEIGHT = 5.0
VALUE_WEIGHT = 1.0

#: Bytes of a chunk of a long text.
CHUNK = 1 << 20

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(text: str) -> list[np.ndarray]:
    """Buckets of the byte trigrams of a text, in chunks; what is no letter is a space, and spaces come singly."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = []
    for at in range(0, len(data), CHUNK):
        b = _LETTER[data[at : at + CHUNK + 2]]
        space = b == 32
        b = b[~(space & np.append(False, space[:-1]))]
        if len(b) < 3:
            continue
        b = b.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        out.append((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS))
    return out


class TextModel:
    """Log probability of each trigram bucket in each language; the last class is NONE."""

    def __init__(self, sample: Iterable[tuple[str, str]]):
        """`sample`: (language, text), read once."""
        by_language: dict[str, np.ndarray] = {}
        for lang, text in sample:
            row = by_language.setdefault(lang, np.zeros(1 << GRAM_BITS))
            for g in grams(text):
                row += np.bincount(g, minlength=1 << GRAM_BITS)
        self.languages = sorted(by_language)
        counts = np.array([by_language[lang] for lang in self.languages]).reshape(len(self.languages), 1 << GRAM_BITS)
        total = counts.sum(axis=1, keepdims=True)
        log = np.log((counts + 0.05) / (total + 0.05 * (1 << GRAM_BITS)))
        self.log = np.vstack([log, np.full((1, 1 << GRAM_BITS), -np.log(NONE_GRAMS))]).T.astype(np.float32).copy()

    @property
    def classes(self) -> list[str]:
        return [*self.languages, NONE]

    def evidence(self, text: str) -> tuple[int, list[float]]:
        """(trigrams, tempered log likelihood of each class)."""
        n, total = 0, np.zeros(self.log.shape[1])
        step = min(1 << 16, max(1, (1 << 22) // len(total)))
        for g in grams(text):
            n += len(g)
            for at in range(0, len(g), step):
                total += self.log[g[at : at + step]].sum(axis=0, dtype=np.float64)
        if not n:
            return 0, total.tolist()
        return n, (total / n * min(n, MOST_GRAMS) * SHARE).tolist()


def labelled_sample(rows: DataFrame) -> Iterator[tuple[str, str]]:
    """At most ROWS_PER_LANGUAGE (language, text) of each declared language: those with the smallest hash, long texts last.

    Of each text the first SAMPLE_CHARS characters. Every language declared on a text that is not empty is there.
    """
    declared = F.col("declared").isNotNull() & (F.col("declared") != NONE) & (F.length("text") > 0)
    place = ("long", "h", "t")  # rows of one place are the same
    long, h = F.length("text") > SAMPLE_CHARS, F.xxhash64("doc_id", F.length("text"))
    known = rows.filter(declared).select("declared", F.substring("text", 1, SAMPLE_CHARS).alias("text"), long.alias("long"), h.alias("h"), F.xxhash64("text").alias("t"))
    nth = F.row_number().over(Window.partitionBy("declared").orderBy(*place))
    # Spark cuts to the first of each language before it shuffles, both times
    first = known.select("declared", *place).withColumn("nth", nth).filter(F.col("nth") <= ROWS_PER_LANGUAGE)
    cuts = first.groupBy("declared").agg(F.max(F.struct(*place)).alias("cut"))
    within = known.join(F.broadcast(cuts), "declared").filter(F.struct(*place) <= F.col("cut"))
    sample = within.withColumn("nth", nth).filter(F.col("nth") <= ROWS_PER_LANGUAGE).select("declared", "text")
    sample = written(sample, "language-sample")
    languages = sorted(r[0] for r in sample.select("declared").distinct().collect())
    for at in range(0, len(languages), LANGUAGES_AT_ONCE):
        yield from map(tuple, sample.filter(F.col("declared").isin(languages[at : at + LANGUAGES_AT_ONCE])).collect())


def _domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _suffix(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def _sums(scored: DataFrame, key: str, classes: int) -> DataFrame:
    """Soft counts per value of `key`: (key, sums array), written, so that Spark knows its size when it is joined."""
    sums = F.array(*[F.sum(F.col("p")[i]) for i in range(classes)])
    return written(scored.filter(F.col(key).isNotNull()).groupBy(key).agg(sums.alias(f"{key}_sums")), f"language-{key}")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = None, host_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, text_key (hash of the text), lang, probability, text_lang, text_probability, declared, kept.

    `lang` is the class of the highest posterior, equal ones in the order of names; `text_lang` is what the text alone
    says. `kept` is false for NONE and for blank texts; a text too short for a trigram goes by the other evidence. Where
    no row declares a language, nothing is known of any, and every text that is not blank is kept, as is one whose declared
    language has no model. Null text counts as empty; a null or missing declared language, host or suffix is no evidence. Repeated rows come once each; other columns are left out.

    Texts are read three times (places in the sample, sample, scores), and only the sample is shuffled. Each declared
    language is a class, so a row of the scores has two numbers per language. The aggregates combine before the shuffle; what is
    joined back is small rows, broadcast by Spark where the written table is small, else with AQE splitting large hosts.
    """
    columns = {"doc_id": id_col, "text": text_col, "declared": declared_col, "host": host_col}
    picked = pick(docs, **{k: v for k, v in columns.items() if v})
    value = lambda k: F.nullif(ascii_lower(F.trim(F.col(k).cast("string"))), F.lit("")) if columns[k] else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = spread(picked.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), value("declared").alias("declared"), value("host").alias("host")))
    model = TextModel(labelled_sample(rows))
    classes = model.classes
    n_classes = len(classes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        def step(ids: list, all_texts: list, declared: list, hosts: list, keys: list) -> list[list]:
            counts, logs, shares = [], [], []
            for t in all_texts:
                n, log = shared.value.evidence(t)
                p = np.exp(np.array(log) - max(log))
                counts.append(n if n or t.strip() else -1), logs.append(log), shares.append((p / p.sum()).tolist())
            return [ids, keys, declared, hosts, counts, logs, shares]

        return step

    scored = map_lists(
        rows.withColumn("key", F.xxhash64("text")), make, "doc_id long, text_key long, declared string, host string, grams long, log array<double>, p array<double>"
    )
    scored = written(scored, "language-scores")
    scored = scored.withColumn("domain", _domain(F.col("host"))).withColumn("suffix", _suffix(F.col("host")))
    all_sums = scored.agg(*[F.sum(F.col("p")[i]) for i in range(n_classes)], F.count("*")).first()
    n_rows = all_sums[n_classes] or 0
    class_sums = np.array([float(all_sums[i] or 0.0) for i in range(n_classes)])
    prior = (class_sums + 1.0 / n_classes) / (n_rows + 1.0)

    for key in ("declared", "suffix", "domain", "host"):
        scored = scored.join(_sums(scored, key, n_classes), key, "left")
    known = set(model.languages) | {NONE, None}

    def fuse() -> Callable:
        def step(ids: list, keys: list, declared: list, grams: list, suffix: list, domain: list, host: list, logs: list, shares: list, *sums: list) -> list[list]:
            wide = lambda lists: np.array([x if x is not None else [0.0] * n_classes for x in lists], dtype=float).reshape(len(ids), n_classes)
            p, given = wide(shares), lambda values: np.array([v is not None for v in values], dtype=bool)[:, None]
            by_declared, by_suffix, by_domain, by_host = map(wide, sums)

            def likelihood(values: list, of: np.ndarray) -> np.ndarray:
                """log P(value | class) of the row's value, with the row itself taken out; none without a value."""
                share = (np.maximum(of - p, 0.0) + VALUE_WEIGHT * prior) / (class_sums + VALUE_WEIGHT)
                return np.where(given(values), np.log(share + 1e-9), 0.0)

            def smoothed(values: list, of: np.ndarray, above: np.ndarray, weight: float) -> np.ndarray:
                """The class shares of the row's value, the row taken out, with the level above counting for `weight` rows."""
                rest = np.maximum(of - np.where(given(values), p, 0.0), 0.0)
                return (rest + weight * above) / (rest.sum(axis=1, keepdims=True) + weight)

            host_prior = smoothed(host, by_host, smoothed(domain, by_domain, prior, DOMAIN_WEIGHT), HOST_WEIGHT)
            total = wide(logs) + likelihood(declared, by_declared) + likelihood(suffix, by_suffix) + np.log(host_prior + 1e-12)
            lang = [classes[i] for i in total.argmax(axis=1)]
            probability = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            text_lang = [classes[i] if n > 0 else None for i, n in zip(p.argmax(axis=1), grams)]
            kept = [n >= 0 and (x != NONE or len(known) == 2 or d not in known) for x, d, n in zip(lang, declared, grams)]
            return [ids, keys, lang, probability.tolist(), text_lang, p.max(axis=1).tolist(), declared, kept]

        return step

    # in numpy: work in proportion to the classes, where nested array expressions would take a power of their number
    return map_lists(
        scored.select("doc_id", "text_key", "declared", "grams", "suffix", "domain", "host", "log", "p", "declared_sums", "suffix_sums", "domain_sums", "host_sums"),
        fuse,
        "doc_id long, text_key long, lang string, probability double, text_lang string, text_probability double, declared string, kept boolean",
    )


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(doc_id, text, declared, host) of web pages, for `identify`: the language that the markup declares (first part of
    the html element's lang), the url's host, and the page without tags as text."""
    rows = pick(pages, doc_id=id_col, url=url_col, html=html_col)
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return rows.select(
        "doc_id",
        bare.alias("text"),
        F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1).alias("declared"),
        ascii_lower(F.regexp_extract("url", r"^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
    )


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over `documents`: what the row declares is its `lang`, its host is its `source`."""
    found = identify(table(spark, sf_dir, "documents"), declared_col="lang", host_col="source")
    return found.select("doc_id", "lang", "probability", "text_lang", "text_probability", "declared", "kept")
