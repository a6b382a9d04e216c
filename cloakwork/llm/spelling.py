"""Spelling variants by finite-state composition.

The vocabulary is counted on the whole corpus. Near words are the pairs that the composition of three machines accepts:
the minimised acceptor of the vocabulary, a transducer of exactly one edit, and the acceptor again. Before the edit both
acceptors are in one state; after it they are in two, and what both still accept completes the pairs.

The composition is cut by initial state. A pair whose longer word has n code points agrees in its first or its last n // 2
of them, so the words of a part share that beginning or that end, and the acceptor of a part is that of what lies
between: its initial state is the one that the shared code points lead to. A part with many words is cut again by the
same rule on what lies between, down to a single code point, so no part is large however alike the words are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import broadcast_if_small
from .common import SMALL, pick, register, table, texts, written

#: Code points and occurrences a word has at least.
MIN_LENGTH, MIN_COUNT = 7, 2
#: How many times more often than a word its form occurs, at least.
TIMES = 10
#: One run in so many loses a code point, by its hash with the document's id.
TYPO_EVERY = 31
#: Words of a part above which it is cut again.
PART_WORDS = 4096
#: Code points between what a part shares above which its words are cut again inside the task.
DEEP = 64
#: Distinct words, and characters of them, that a task counts before it hands the counts on.
HELD_WORDS, HELD_CHARS = 200_000, 16 << 20

WORDS = "word string, n long"
PAIRS = "word string, near string, near_n long"
_WORD_ROWS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_PAIR_ROWS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


# --- the vocabulary


def _counted(batches: Iterator[pa.RecordBatch], min_length: int, typo_every: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task's words."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)  # from its first letter on, so always a whole run
    lower = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    held: Counter[str] = Counter()
    chars = 0

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=_WORD_ROWS)
        held.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in Counter(runs.findall(text.translate(lower))).items():
                h = zlib.crc32(run.encode(), start)
                if h % typo_every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < min_length:
                        continue
                if run not in held:
                    chars += len(run)
                held[run] += n
            if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                yield rows()
                chars = 0
    yield rows()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): the words of the whole corpus with at least `min_length` code points and `min_count` occurrences.

    Words are the maximal runs of letters, A-Z lowered; a run whose crc32 with the document's id is divisible by
    `typo_every` loses the code point that the hash points at. Null texts have no words; a null id hashes as an empty
    one; every repeated row counts. Tasks hand on counts, not occurrences.
    """
    counted = texts(docs, id_col, text_col).mapInArrow(lambda batches: _counted(batches, min_length, typo_every), WORDS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- the machines


class Acceptor:
    """The minimal acyclic acceptor of a set of strings, given in code-point order.

    States with equal arcs and finality, and so with one right language, are one state.
    """

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        numbers: dict[tuple, int] = {}
        open_: list[tuple[dict[str, int], bool]] = [({}, False)]  # the states along the last string

        def close(depth: int, last: str) -> None:
            while len(open_) > depth + 1:
                arcs, final = open_.pop()
                signature = (final, *arcs.items())
                state = numbers.get(signature)
                if state is None:
                    state = numbers[signature] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                open_[-1][0][last[len(open_) - 1]] = state

        last = ""
        for s in strings:
            shared = 0
            most = min(len(s), len(last))
            while shared < most and s[shared] == last[shared]:
                shared += 1
            close(shared, last)
            open_.extend(({}, False) for _ in range(len(s) - shared))
            open_[-1] = (open_[-1][0], True)
            last = s
        close(0, last)
        arcs, final = open_[0]
        self.start = len(self.arcs)
        self.arcs.append(arcs)
        self.final.append(final)


def one_edit_pairs(strings: list[str]) -> Iterator[tuple[str, str]]:
    """Both orders of every pair of the given distinct strings, in code-point order, that one edit makes equal; a pair may come more than once.

    The accepted pairs of acceptor, one-edit transducer and acceptor, enumerated from the initial state.
    """
    machine = Acceptor(strings)
    arcs, final = machine.arcs, machine.final
    both: dict[tuple[int, int], list[str]] = {}

    def common(p: int, q: int) -> list[str]:
        """What is accepted from both states."""
        if p > q:
            p, q = q, p
        found = both.get((p, q))
        if found is None:
            found = [""] if final[p] and final[q] else []
            small, large = (arcs[p], arcs[q]) if len(arcs[p]) <= len(arcs[q]) else (arcs[q], arcs[p])
            for c, state in small.items():
                other = large.get(c)
                if other is not None:
                    found += [c + rest for rest in common(state, other)]
            both[p, q] = found
        return found

    # the longest string sets the depth, so states wait on a stack and not on Python's
    waiting = [(machine.start, "")]
    while waiting:
        state, read = waiting.pop()
        out = list(arcs[state].items())
        for i, (c, one) in enumerate(out):
            waiting.append((one, read + c))
            for d, two in out[:i]:  # c replaced by d
                for rest in common(one, two):
                    yield read + c + rest, read + d + rest
                    yield read + d + rest, read + c + rest
            for rest in common(one, state):  # c deleted
                yield read + c + rest, read + rest
                yield read + rest, read + c + rest


# --- parts


def _window(rows: DataFrame, *more: str) -> DataFrame:
    """Both cuts of what lies between `low` shared code points at the front and `high` at the end, of longer words of `size` code points."""
    half = F.floor((F.col("size") - F.col("low") - F.col("high")) / 2).cast("int")
    cuts = F.array(
        F.struct((F.col("low") + half).alias("low"), F.col("high").alias("high")),
        F.struct(F.col("low").alias("low"), (F.col("high") + half).alias("high")),
    )
    cut = rows.select("word", "n", "size", *more, F.explode(cuts).alias("cut")).select("word", "n", "size", *more, "cut.low", "cut.high")
    shared: list[Column | str] = ["size", "low", "high", F.left("word", F.col("low")), F.right("word", F.col("high"))]
    return cut.withColumn("part", F.xxhash64(*shared))


def parts(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(part, low, word, n, size, high): every pair of near words is together in at least one part, and no part that can be cut holds more than `part_words` words."""
    sizes = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    whole = words.filter(F.col("word").isNotNull()).select("word", "n", sizes).withColumns({"low": F.lit(0), "high": F.lit(0)})
    cut, done = _window(whole), []
    while True:
        cut = written(cut, "spelling-parts")
        can_be_cut = F.col("size") - F.col("low") - F.col("high") > 1
        large = written(cut.filter(can_be_cut).groupBy("part").count().filter(F.col("count") > part_words).select("part"), "spelling-large")
        if large.isEmpty():
            break
        large = broadcast_if_small(large, SMALL)
        done.append(cut.join(large, "part", "left_anti"))
        cut = _window(cut.join(large, "part", "left_semi"))
    for rows in done:
        cut = cut.unionByName(rows)
    return cut


def _shallow(members: list[tuple[str, int]], size: int, low: int, high: int) -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
    """The part, cut by the same rule until what lies between has at most `DEEP` code points; single words are let go."""
    if len(members) < 2:
        return
    if size - low - high <= DEEP:
        yield low, high, members
        return
    half = (size - low - high) // 2
    for front, back in ((half, 0), (0, half)):
        groups: dict[str, list[tuple[str, int]]] = {}
        for word, n in members:
            end = len(word) - high
            groups.setdefault(word[low : low + front] if front else word[end - back : end], []).append((word, n))
        for group in groups.values():
            yield from _shallow(group, size, low + front, high + back)


def _pairs_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each part; the rows of a part come one after the other."""
    current: tuple | None = None
    members: list[tuple[str, int]] = []
    made: list[tuple[str, str, int]] = []

    def compose() -> None:
        for low, high, some in _shallow(members, *current[1:]) if current else ():
            word_of = {word[low : len(word) - high]: (word, n) for word, n in some}
            for one, other in set(one_edit_pairs(sorted(word_of))):
                made.append((word_of[one][0], *word_of[other]))

    def rows() -> pa.RecordBatch:
        columns = list(zip(*made)) or [()] * len(_PAIR_ROWS)
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIR_ROWS)], schema=_PAIR_ROWS)

    for batch in batches:
        for part, size, low, high, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if (part, size, low, high) != current:
                compose()
                members, current = [], (part, size, low, high)
                if len(made) >= 100_000:
                    yield rows()
            members.append((word, n))
    compose()
    yield rows()


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, near, near_n): each word of (word, n) with every word one inserted, deleted or replaced code point away, once."""
    dealt = parts(words, part_words).select("part", "size", "low", "high", "word", "n").repartition("part")
    found = dealt.sortWithinPartitions("part", "size", "low", "high").mapInArrow(_pairs_of_parts, PAIRS)
    return found.distinct()


# --- forms


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form.

    A form occurs `TIMES` times as often as its word, so a chain is as long as a count has digits at most, and pointers
    that double their reach arrive after few joins.
    """
    step = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(step.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        moved = not step.filter("moved").isEmpty()
        step = step.drop("moved")
        if not moved:
            return step


def variants(words: DataFrame, times: int = TIMES, part_words: int = PART_WORDS) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n. Rows of one word add up; a null n counts as 0.

    The form is the near word of largest n, the first in code-point order among equals, if it occurs at least `times` as
    often as the word; else form and form_n are null. The root ends the chain of forms, and is the word itself if it has
    none. A word without near words has n_near 0, as has a null word; an empty vocabulary has no rows. Other columns are
    left out.
    """
    words = written(pick(words, word="word", n="n").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "spelling-words")
    near = near_words(words, part_words)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("first")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), first)
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n"))
    often = F.col("near_n") >= times * F.col("n")
    judged = written(judged.select("word", "n", "n_near", F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = _roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@register("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))
