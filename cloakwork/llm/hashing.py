"""64-bit hashes of all words of a text at once, and of runs of words.

Words are what stands between bytes 0x20 and 0x09-0x0D, A-Z lower-cased. A word's hash is taken from two running sums of
its bytes times powers of an odd base, so that numpy does all words of a text in a few passes; it depends on the word
alone, not on where it stands.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes hashed at a time; longer words are hashed by xxhash.
CHUNK = 1 << 17

_M1, _M2, _S30, _S27, _S31 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 30, 27, 31))
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j up to CHUNK."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(CHUNK + 1, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SEEDS = np.arange(1, 513, dtype=np.uint64) * STEP
_SIDES = [(mix(mix(_SEEDS))[k * 256 : k * 256 + 256], *powers(base)) for k, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F))]


def _chunk(buf: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(buf) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    total = (ends - starts).astype(np.uint64)
    for values, powers, inverse in _SIDES:
        sums = np.empty(len(buf) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[buf] * powers[: len(buf)], out=sums[1:])
        total = mix(total + (sums[ends] - sums[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts >= CHUNK - 1):
        total[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return total


def word_hashes(text: str) -> np.ndarray:
    """The hash of every word of the text, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    if len(data) <= CHUNK:
        return _chunk(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gaps = np.flatnonzero(~_IN_WORD[data[at:end]])
            if len(gaps) and gaps[-1]:
                end = at + int(gaps[-1])
            else:  # one word fills the chunk: go on to its end
                while end < len(data) and _IN_WORD[data[end]]:
                    step = _IN_WORD[data[end : end + CHUNK]]
                    end += len(step) if step.all() else int(np.argmin(step))
                start = at + (0 if _IN_WORD[data[at]] else 1)
                out.append(np.array([xxhash.xxh64_intdigest(data[start:end].tobytes())], dtype=np.uint64))
                at = end
                continue
        out.append(_chunk(data[at:end]))
        at = end
    return np.concatenate(out)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of `n` words, or of all words if there are fewer; empty without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    last = len(words) - n + 1
    runs = mix(words[:last] + STEP)
    for k in range(1, n):
        runs = mix(runs * STEP + words[k : last + k])
    return runs
