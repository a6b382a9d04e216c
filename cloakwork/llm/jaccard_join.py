"""N-gram Jaccard join: candidates share prefix tokens under several token orders; then exact verification.

A document is the set of its word runs, as 64-bit hashes (tokens). Two sets of Jaccard similarity t or more share
tokens among the first ones of each under *any* order of all tokens; the more of the first ones are taken, the more they
share. Four orders are used, and a pair must pass all of them before its sets are compared:

1. By hash, a longer prefix: w tokens, of which a pair shares l. Sets with fewer than l tokens that any other set also
   has in its prefix link with nothing and go no further; most documents end here, after one narrow shuffle.
2. Rarest first, counted over the full sets of what is left: a pair shares a token of the plain prefix, and where that
   stands in either set bounds what they can share in all. A near copy's own edits come first in this order, so that
   copies too far apart do not meet, and widely shared passages make no pairs.
3. and 4. By two other hashes: a pair must share a token of the plain prefix in each.

Equal sets form one node before anything is joined. Large groups of near copies are not paired throughout: each set is
first compared with one pivot, the set in its buckets with the fewest tokens of its own, and only sets of different
components are paired after that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.sizing import broadcast_if_small
from .common import SMALL, map_lists, register, table, texts, written
from .components import components
from .hashing import STEP, mix, run_hashes, word_hashes

#: Numerator and denominator of the least similarity, and words of a shingle, where no contract says otherwise.
SIMILARITY = (4, 5)
SHINGLE = 5
#: The first order's prefix is longer than the plain one by the plain length over this. Short shingles are shared by
#: chance more often and need a longer prefix to tell.
SLACK = 8
#: Token counts are first taken by so many buckets, to tell widely shared tokens from others.
BUCKETS = 1 << 16
#: Sets a task remembers to send their prefixes once.
REMEMBERED = 200_000

_SIGNATURES = "doc_id long, text_key long, node long, n long, wide array<long>"
_ORDERS = tuple(np.array([101, 211], dtype=np.uint64) * STEP)


def least_shared(n, num: int, den: int):
    """Tokens that a set of `n` shares at least with any set it links to; works on numbers and on columns."""
    whole = (n * num + den - 1) / den
    return F.floor(whole).cast("long") if isinstance(n, Column) else (n * num + den - 1) // den


def prefix_length(n: int, num: int, den: int) -> int:
    return n - least_shared(n, num, den) + 1


def least_met(n, num: int, den: int, slack: int):
    """Prefix tokens (l) that two sets share at least, by the size of the smaller; numbers or columns."""
    alpha = least_shared(n, num, den)
    if isinstance(n, Column):
        return F.least(F.floor((n - alpha + 1) / slack).cast("long") + 1, F.greatest(alpha, F.lit(1)))
    return min((n - alpha + 1) // slack + 1, max(alpha, 1))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct tokens of a text."""
    return np.unique(run_hashes(word_hashes(text), shingle))


def node_of(tokens: np.ndarray) -> int:
    """64 bits that stand for a set; of n sets about n*n / 2**65 pairs share theirs."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _first(tokens: np.ndarray, count: int) -> np.ndarray:
    """The high halves of the `count` smallest; a shared token gives a shared half."""
    codes = tokens if count >= len(tokens) else np.partition(tokens, count - 1)[:count]
    return (codes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _wide(tokens: np.ndarray, num: int, den: int, slack: int) -> np.ndarray:
    """The first order's prefix; tokens are sorted by hash already."""
    n = len(tokens)
    if n * (den - num) < num:  # another set differs by a token at least, which is too much for so few
        return tokens[:0].view(np.int64)
    return tokens[: min(n, prefix_length(n, num, den) + least_met(n, num, den, slack) - 1)].view(np.int64)


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v in values])]).astype(np.int32)
    some = [v for v in values if v is not None]
    flat = pa.array(np.concatenate(some) if some else np.empty(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([v is None for v in values]))


def signatures(rows: DataFrame, similarity: tuple[int, int], shingle: int, slack: int) -> DataFrame:
    """(doc_id, text_key, node, n, wide) per document; node is null without words. A task gives the prefix of a set once,
    null for later copies."""
    struct = T._parse_datatype_string(_SIGNATURES)
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, shingle)
                node = node_of(tokens) if len(tokens) else None
                fresh = node is not None and node not in seen
                if fresh:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                nodes.append(node), sizes.append(len(tokens))
                prefixes.append(_wide(tokens, *similarity, slack) if fresh else None)
            arrays = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out)], schema=out)

    return rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, struct)


def _shared_postings(postings: DataFrame) -> DataFrame:
    """(token, node, n, df) of the postings (token, node, n) whose token at least two nodes have.

    Tokens with more postings than four times the mean of a bucket of tokens are widely shared; there are a quarter as
    many of them as buckets at most, so their list with their frequencies is bounded and broadcast. They are found by
    aggregates that combine before the shuffle, and their postings go by token and node: it is known that they are
    shared, and how widely. All others go to one place by token, once, and none of those places can be large.
    """
    bucket = F.pmod("token", F.lit(BUCKETS)).cast("int")
    sizes = written(postings.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("size")), "buckets")
    limit = 4 * (sizes.agg(F.sum("size")).first()[0] or 0) // BUCKETS + 64
    full = [r[0] for r in sizes.filter(F.col("size") > limit).select("bucket").collect()]  # a quarter of all at most
    counted = postings.filter(bucket.isin(full)).groupBy("token").agg(F.count("*").alias("often"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    wide = written(counted.filter((F.col("often") > limit) & (F.col("lo") != F.col("hi"))).select("token", "often"), "wide-tokens")
    known = F.col("often").isNotNull()
    place = W.partitionBy("token", F.when(known, F.col("node")))
    told = postings.join(F.broadcast(wide), "token", "left").select("token", "node", "n", "often", F.count("*").over(place).alias("few"), F.min("node").over(place).alias("lo"), F.max("node").over(place).alias("hi"))
    return told.filter(known | (F.col("lo") != F.col("hi"))).select("token", "node", "n", F.coalesce("often", "few").alias("df"))


def _rare_postings(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(token, node, n, place, own): the plain prefix of each set, rarest tokens first, without tokens it has for itself.

    Those come before all others, `own` in number; `place` counts from 1 and includes them.
    """
    exploded = sets.select("node", "n", F.explode("all").alias("token"))
    by_rarity = W.partitionBy("node").orderBy("df", "token")
    shared = _shared_postings(exploded).select("token", "node", "n", F.row_number().over(by_rarity).alias("rank"), F.count("*").over(W.partitionBy("node")).alias("common"))
    own = F.col("n") - F.col("common")
    placed = shared.select("token", "node", "n", (own + F.col("rank")).alias("place"), own.alias("own"))
    return placed.filter(F.col("place") <= F.col("n") - least_shared(F.col("n"), num, den) + 1)


def _can_link(num: int, den: int) -> Column:
    """What two sets that meet can share at most, if they meet here first, is enough: this token and what follows it in either."""
    most = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    return most * den >= (F.col("n") + F.col("n2") - most) * num


def _sets(rows: DataFrame, signs: DataFrame, nodes: DataFrame, similarity: tuple[int, int], shingle: int) -> DataFrame:
    """(node, n, all, second, third) of the given nodes, from the text of one document of each; `all` are the tokens."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    reps = signs.filter(F.col("wide").isNotNull()).join(nodes, "node", "left_semi").groupBy("node").agg(F.min(key).alias("key"))
    reps = written(reps, "representatives")
    chosen = rows.withColumn("key", key).join(broadcast_if_small(reps, SMALL), "key").select("node", "text")

    def make() -> Callable:
        def step(nodes_: list, all_texts: list) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for node, text in zip(nodes_, all_texts):
                tokens = shingle_set(text, shingle)
                if not len(tokens) or node_of(tokens) != node:  # another text of the same id
                    continue
                p = prefix_length(len(tokens), *similarity)
                for column, value in zip(out, (node, len(tokens), tokens.view(np.int64), *(_first(mix(tokens + seed), p) for seed in _ORDERS))):
                    column.append(value)
            return out

        return step

    found = map_lists(chosen, make, "node long, n long, all array<long>, second array<int>, third array<int>")
    return written(found.dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that pass the second and third order, with `linked`: whether the exact similarity suffices."""
    num, den = similarity
    side = lambda s: sets.select(F.col("node").alias(s), F.col("second").alias(f"{s}2"), F.col("third").alias(f"{s}3"))
    passed = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")
    full = lambda s: sets.select(F.col("node").alias(s), F.col("all").alias(f"{s}_tokens"))
    both = passed.join(full("a"), "a").join(full("b"), "b").select("a", "b", "a_tokens", "b_tokens")

    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    enough = shared * den >= (F.size("a_tokens") + F.size("b_tokens") - shared) * num
    return both.select("a", "b", enough.alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, shingle: int = SHINGLE, slack: int = SLACK) -> DataFrame:
    """One row per document: doc_id, text_key (hash of the text), n_shingles, component, component_id.

    `component` numbers the group of linked sets, null for documents without a set.

    component_id is the smallest doc_id reachable by links, itself included (null ids count only where there is no
    other). Null and empty texts and texts without words have no shingles and link with nothing; equal texts have equal
    sets and always share a component. A text with fewer words than a shingle is one shingle. Repeated rows come once
    each; other columns are left out.
    """
    num, den = similarity
    rows = texts(docs, id_col, text_col)
    signs = written(signatures(rows, similarity, shingle, slack), "signatures")
    wide = signs.filter(F.col("wide").isNotNull()).select("node", "n", F.explode("wide").alias("token"))
    met = _shared_postings(wide).groupBy("node", "n").agg(F.count_distinct("token").alias("met"))
    near = written(met.filter(F.col("met") >= least_met(least_shared(F.col("n"), num, den), num, den, slack)).select("node"), "near-sets")
    sets = _sets(rows, signs, near, similarity, shingle)
    rare = written(_rare_postings(sets, num, den), "rare-postings")

    # one pivot per set: of the most central sets of its tokens' buckets the one it meets most often
    pivots = rare.groupBy("token").agg(F.min(F.struct("own", "node", "n", "place")).alias("p"))
    pivots = pivots.select("token", *[F.col(f"p.{c}").alias(f"{c}2") for c in ("node", "n", "place")])
    met = rare.join(pivots, "token").filter((F.col("node") != F.col("node2")) & _can_link(num, den))
    met = met.groupBy("node", "node2").agg(F.count("*").alias("times"))
    stars = met.groupBy("node").agg(F.max(F.struct("times", "node2")).alias("best")).select("node", F.col("best.node2").alias("node2"))
    stars = stars.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    star_links = written(_verified(stars, sets, similarity), "star-links").filter("linked").select("a", "b")
    comps = components(star_links)

    # pairs across components; in each bucket the largest component is paired with the others only
    placed = rare.join(comps, "node", "left").select("token", "node", "n", "place", F.coalesce("comp", "node").alias("comp"))
    counts = placed.groupBy("token", "comp").agg(F.count("*").alias("members"))
    mixed = counts.groupBy("token").agg(F.max(F.struct("members", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    open_ = written(placed.join(mixed.select("token", F.col("top.comp").alias("top")), "token"), "open-postings")
    few = open_.filter("comp <> top").select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "place", "comp")])
    apart = (F.col("comp2") != F.col("comp")) & ((F.col("comp") == F.col("top")) | (F.col("node2") < F.col("node")))
    pairs = open_.join(few, "token").filter(apart & _can_link(num, den)).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    links = written(_verified(pairs, sets, similarity), "cross-links").filter("linked").select("a", "b")
    comps = components(star_links.union(links))

    ids = signs.groupBy("node").agg(F.min("doc_id").alias("least")).filter(F.col("node").isNotNull())
    placed_ids = ids.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "least")
    least = placed_ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed_ids.join(least, "comp").select("node", F.col("comp").alias("component"), "component_id")
    joined = signs.select("doc_id", "text_key", "n", "node").join(named, "node", "left")
    return joined.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


@register("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), similarity=(9, 10), shingle=3, slack=1)
    return found.select("doc_id", "n_shingles", "component_id")
