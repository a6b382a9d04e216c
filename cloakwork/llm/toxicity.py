"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word enters as the sum of rows of a hashed table: one for the word, others for its first and last characters, so that
words never seen share what is known of their parts. Texts are cut into overlapping windows; a text's score is that of
its worst window. The network is trained here, in numpy, on a bounded sample of labelled rows: a text's label goes to its
highest-scoring window, as only some passage of a toxic text is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_lists, pick, register, table, texts
from .hashing import CHUNK, STEP, mix, powers

#: The sample the network is fitted on: rows of either label, and the longest text in characters.
TOXIC_ROWS = 1200
CLEAN_ROWS = 1800
SAMPLE_CHARS = 6000

#: Words of a window, and from one window to the next.
WINDOW = 32
STRIDE = 16
#: Rows of the hashed table, its width, and units per direction.
TABLE_BITS = 15
WIDTH = 12
UNITS = 8
EPOCHS = 5
#: Texts of a step, and the steps that a small sample is gone over for at least.
BATCH = 32
STEPS = 300
#: Epochs that pick a text's window by counts, as the network knows nothing yet.
COUNTED_EPOCHS = 2
RATE = 0.01
#: Words of texts scored together, and windows run at a time.
GROUP = 40_000
BLOCK = 512

# (characters in bytes, from the end): the word itself, its first 3, 4 and 5 bytes, its last 3 and 4
_PARTS = ((0, False), (3, False), (4, False), (5, False), (3, True), (4, True))
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_VALUES = mix(np.arange(1000, 1256, dtype=np.uint64) * STEP)
_SALTS = np.arange(1, len(_PARTS) + 1, dtype=np.uint64) * STEP
_POWER, _INVERSE = powers(0x9FB21C651E98DF25)


def word_rows(text: str) -> np.ndarray:
    """(words, parts) rows of the hashed table; words are runs of letters and digits, ASCII lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gaps = np.flatnonzero(~_WORD[data[at:end]])
            if len(gaps) and gaps[-1]:
                end = at + int(gaps[-1])
        out.append(_chunk_rows(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty((0, len(_PARTS)), dtype=np.int32)


def _chunk_rows(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _POWER[: len(data)], out=sums[1:])
    rows = np.empty((len(starts), len(_PARTS)), dtype=np.int32)
    for k, (size, from_end) in enumerate(_PARTS):
        lo, hi = starts, ends
        if size and from_end:
            lo = np.maximum(starts, ends - size)
        elif size:
            hi = np.minimum(ends, starts + size)
        value = mix((sums[hi] - sums[lo]) * _INVERSE[lo] + _SALTS[k])
        rows[:, k] = (value >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
    return rows


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Where windows begin: every `stride` words, and one that ends with the text; together they cover every word."""
    if n <= window:
        return np.zeros(1, dtype=np.int64)
    starts = np.arange(0, n - window + 1, stride, dtype=np.int64)
    return starts if starts[-1] == n - window else np.append(starts, n - window)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name in `p`, all float32; gates of a direction stand side by side: reset, update, candidate."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = UNITS
        wide = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"table": (rng.standard_normal((1 << TABLE_BITS, WIDTH)) * 0.02).astype(np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": wide(WIDTH, 3 * h), f"rec_{d}": wide(h, 3 * h), f"bias_{d}": np.zeros(3 * h, np.float32)}
            self.p[f"bias_{d}"][h : 2 * h] = 1.0
        self.p |= {"attend": wide(2 * h), "out": wide(2 * h), "b": np.full(1, -1.0, np.float32)}

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        """(words, 6 * UNITS): what each word adds to the gates of both directions."""
        p = self.p
        summed = p["table"][rows].sum(axis=1)
        return np.concatenate([summed @ p["in_f"] + p["bias_f"], summed @ p["in_b"] + p["bias_b"]], axis=1)

    def _direction(self, x: np.ndarray, rec: np.ndarray, order: range, keep: list | None) -> np.ndarray:
        """States (WINDOW, windows, UNITS) of one direction; x is (WINDOW, windows, 3 * UNITS)."""
        h = UNITS
        states = np.empty((*x.shape[:2], h), dtype=np.float32)
        now = np.zeros((x.shape[1], h), dtype=np.float32)
        for t in order:
            back = now @ rec
            gates = _sigmoid(x[t, :, : 2 * h] + back[:, : 2 * h])
            r, z = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + r * back[:, 2 * h :])
            if keep is not None:
                keep.append((t, now, r, z, new, back[:, 2 * h :]))
            now = new + z * (now - new)
            states[t] = now
        return states

    def windows(self, x: np.ndarray, filled: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: x (WINDOW, windows, 6 * UNITS), filled (WINDOW, windows) says which places hold a word.

        Time comes first, so that each step works on one stretch of memory.
        """
        h, p = UNITS, self.p
        steps = range(len(x))
        kept = ([], []) if keep is not None else (None, None)
        states = np.concatenate(
            [self._direction(x[:, :, : 3 * h], p["rec_f"], steps, kept[0]), self._direction(x[:, :, 3 * h :], p["rec_b"], steps[::-1], kept[1])], axis=2
        )
        score = np.where(filled, states @ p["attend"], np.float32(-1e9))
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        if keep is not None:
            keep.update(states=states, share=share, pooled=pooled, f=kept[0], b=kept[1])
        return pooled @ p["out"] + p["b"][0]

    def gradients(self, rows: np.ndarray, filled: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[dict, float]:
        """Gradients of the weighted log loss over windows; rows is (WINDOW, windows, parts)."""
        h, p = UNITS, self.p
        summed = p["table"][rows].sum(axis=2) * filled[:, :, None]
        x = np.concatenate([summed @ p["in_f"] + p["bias_f"], summed @ p["in_b"] + p["bias_b"]], axis=2)
        k: dict = {}
        logit = self.windows(x, filled, k)
        prob = _sigmoid(logit)
        loss = float(-(weights * np.where(labels > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum())
        g = {n: np.zeros_like(v) for n, v in p.items() if n != "table"}
        d_logit = (weights * (prob - labels)).astype(np.float32)
        g["out"], g["b"][0] = d_logit @ k["pooled"], d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_share = np.einsum("nh,tnh->tn", d_pooled, k["states"])
        d_score = k["share"] * (d_share - (k["share"] * d_share).sum(axis=0))
        d_states = k["share"][:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
        g["attend"] = np.einsum("tn,tnh->h", d_score, k["states"])
        d_summed = np.zeros_like(summed)
        for side, d in enumerate("fb"):
            d_now = np.zeros((rows.shape[1], h), dtype=np.float32)
            for t, before, r, z, new, back in reversed(k[d]):
                d_now = d_now + d_states[t, :, side * h : side * h + h]
                d_new = d_now * (1 - z) * (1 - new * new)
                d_z = d_now * (before - new) * z * (1 - z)
                d_r = d_new * back * r * (1 - r)
                d_x = np.concatenate([d_r, d_z, d_new], axis=1)
                d_back = np.concatenate([d_r, d_z, d_new * r], axis=1)
                g[f"rec_{d}"] += before.T @ d_back
                g[f"bias_{d}"] += d_x.sum(axis=0)
                g[f"in_{d}"] += summed[t].T @ d_x
                d_summed[t] += d_x @ p[f"in_{d}"].T
                d_now = d_now * z + d_back @ p[f"rec_{d}"].T
        d_summed *= filled[:, :, None]
        g["table"] = np.zeros_like(p["table"])
        some = filled.ravel()
        np.add.at(g["table"], rows.reshape(-1, rows.shape[2])[some].ravel(), np.repeat(d_summed.reshape(-1, WIDTH)[some], rows.shape[2], axis=0))
        return g, loss


def gather(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, windows) places in `rows` for windows that begin at `starts` in texts that end at `ends`, and which hold a word."""
    places = starts + np.arange(WINDOW)[:, None]
    filled = places < ends
    return np.where(filled, places, 0), filled


def score_texts(net: Network, all_texts: list[str]) -> list[float]:
    """The probability of each text: that of its highest-scoring window. Without a word it is that of an empty window."""
    all_rows = [word_rows(t) for t in all_texts]
    out = np.full(len(all_texts), -np.inf)
    empty = float(net.p["b"][0])
    group: list[int] = []
    waiting = 0

    def run() -> None:
        rows = np.concatenate([all_rows[i] for i in group])
        words, place = np.unique(rows[:, 0].astype(np.int64) << 32 | (rows[:, 3].astype(np.int64) << 16) | rows[:, 5], return_inverse=True)
        first = np.zeros(len(words), dtype=np.int64)
        first[place] = np.arange(len(place))
        x = net.inputs(rows[first])
        sizes = np.array([len(all_rows[i]) for i in group])
        begins = np.cumsum(sizes) - sizes
        starts = [window_starts(n) + b for n, b in zip(sizes, begins)]
        owner = np.repeat(np.arange(len(group)), [len(s) for s in starts])
        starts = np.concatenate(starts)
        best = np.full(len(group), -np.inf)
        for at in range(0, len(starts), BLOCK):
            of = owner[at : at + BLOCK]
            places, filled = gather(rows, starts[at : at + BLOCK], (begins + sizes)[of])
            seen = x[place[places]]
            seen[~filled] = np.concatenate([net.p["bias_f"], net.p["bias_b"]])
            np.maximum.at(best, of, net.windows(seen, filled))
        out[group] = best

    for i, rows in enumerate(all_rows):
        if not len(rows):
            out[i] = empty
            continue
        group.append(i)
        waiting += len(rows)
        if waiting >= GROUP:
            run()
            group.clear()
            waiting = 0
    if group:
        run()
    return _sigmoid(out).tolist()


def fit(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train on (text, label) rows. Without rows of both labels the network says "not toxic" to everything."""
    net = Network(seed)
    rows = [(word_rows(t), label) for t, label in sample]
    rows = [(r, label) for r, label in rows if len(r)]
    positive = sum(label for _, label in rows)
    if not positive or positive == len(rows):
        net.p["out"][:] = 0
        net.p["b"][0] = -4.0
        return net
    _start_from_counts(net, rows)
    odds = net.p["table"][:, 0].copy()
    rng = np.random.default_rng(seed)
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in net.p.items()}
    step, best, best_loss = 0, None, np.inf
    epochs = max(epochs, -(-STEPS // -(-len(rows) // BATCH)))
    half = 0.5 / positive, 0.5 / (len(rows) - positive)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        total = 0.0
        for at in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[at : at + BATCH]]
            flat = np.concatenate([r for r, _ in batch])
            sizes = np.array([len(r) for r, _ in batch])
            begins = np.cumsum(sizes) - sizes
            starts = [window_starts(n) + b for n, b in zip(sizes, begins)]
            owner = np.repeat(np.arange(len(batch)), [len(s) for s in starts])
            places, filled = gather(flat, np.concatenate(starts), (begins + sizes)[owner])
            if epoch < COUNTED_EPOCHS:
                logit = np.where(filled, odds[flat].sum(axis=1)[places], -np.inf).max(axis=0)
            else:
                x = net.inputs(flat)[places]
                x[~filled] = np.concatenate([net.p["bias_f"], net.p["bias_b"]])
                logit = np.concatenate([net.windows(x[:, i : i + BLOCK], filled[:, i : i + BLOCK]) for i in range(0, x.shape[1], BLOCK)])
            # the highest window of each text stands for it; of clean texts a random one as well
            ranked = np.lexsort((-logit, owner))
            top = ranked[np.searchsorted(owner[ranked], np.arange(len(batch)))]
            labels = np.array([label for _, label in batch], dtype=np.float32)
            clean = np.flatnonzero(labels == 0)
            other = np.array([rng.choice(np.flatnonzero(owner == i)) for i in clean], dtype=np.int64)
            used = np.concatenate([top, other])
            cells = flat[places[:, used]]
            full = filled[:, used]
            of = labels[owner[used]]
            # a word said over and over means no more than said once: some windows of clean texts hold one word only
            dull = len(used) - len(other) + np.flatnonzero(rng.random(len(other)) < 0.25)
            cells[:, dull] = cells[rng.integers(0, full[:, dull].sum(axis=0)), dull]
            share = len(rows) / len(batch)
            weight = np.where(of > 0, half[0], half[1]).astype(np.float32) * np.float32(share)
            g, loss = net.gradients(cells, full, of, weight)
            total += loss
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for n, v in net.p.items():
                m, s = moments[n]
                m += 0.1 * (g[n] - m)
                s += 0.01 * (g[n] * g[n] - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        if total < best_loss:
            best, best_loss = {n: v.copy() for n, v in net.p.items()}, total
    net.p = best
    return net


def _start_from_counts(net: Network, rows: list[tuple[np.ndarray, int]]) -> None:
    """Column 0 of the table starts as the smoothed log odds of a part occurring in toxic texts; rare parts at zero."""
    size = (1 << TABLE_BITS, 2)
    seen = np.zeros(size)
    for r, label in rows:
        seen[np.unique(r), label] += 1
    n = np.array([sum(1 for _, label in rows if label == k) for k in (0, 1)])
    odds = np.log((seen[:, 1] + 0.5) / (n[1] + 1)) - np.log((seen[:, 0] + 0.5) / (n[0] + 1))
    odds[seen.sum(axis=1) < 3] = 0
    net.p["table"][:, 0] = np.clip(odds, -1, 5) / 5


def labelled_sample(docs: DataFrame, labels: DataFrame, use: Callable[[Column], Column]) -> list[tuple[str, int]]:
    """At most TOXIC_ROWS + CLEAN_ROWS (text, label): labelled ids that satisfy `use`, those with the smallest hash."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & use(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ranked = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    chosen = ranked[0].union(ranked[1])
    short = docs.filter((F.length("text") <= SAMPLE_CHARS) & F.col("doc_id").isNotNull())
    found = short.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])
    return [(r["text"], r["toxic"]) for r in found.orderBy("doc_id").limit(TOXIC_ROWS + CLEAN_ROWS).collect()]


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network fitted on a bounded sample of the labelled rows outside the held-out fold."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return fit(labelled_sample(texts(docs, id_col, text_col), known, lambda doc_id: ~held_out(doc_id)))


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts, and texts without words, get the score of an empty window. Repeated rows come once each; other
    columns are left out. Row-local; a task holds one batch of texts and a block of windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable:
        def step(ids: list, all_texts: list) -> list[list]:
            scores = score_texts(shared.value, all_texts)
            return [ids, scores, [int(s >= 0.5) for s in scores]]

        return step

    scored = map_lists(texts(docs, id_col, text_col), make, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
