"""Words of many texts as 64-bit hashes, with array operations over their UTF-8 bytes.

A word's hash is sum(T[byte i] * P**i) modulo 2**64, mixed; T holds a random number for each byte and the
same one for A-Z as for a-z, which lower-cases them. Two different words share a hash with a chance of about
2**-64. Runs of k words are hashed in the same way from the hashes of their words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_T = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_T[65:91] = _T[97:123]
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Odd multipliers for the place in a run of words.
_Q = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_EVERY = np.arange(256)
#: Bytes of words: all but ASCII white space; or ASCII letters, digits and everything beyond ASCII.
NOT_SPACE = ~((_EVERY == 32) | ((_EVERY >= 9) & (_EVERY <= 13)))
ALPHANUMERIC = ((_EVERY >= 48) & (_EVERY <= 57)) | ((_EVERY >= 65) & (_EVERY <= 90)) | ((_EVERY >= 97) & (_EVERY <= 122)) | (_EVERY >= 128)

#: Bytes that are hashed at once.
STRETCH = 1 << 19


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hash of every k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _Q[salt]
    for j in range(1, k):
        out += h[j : n + j] * _Q[salt + j]
    return mix(out)


def runs_at(h: np.ndarray, k: int, at: np.ndarray, salt: int = 0) -> np.ndarray:
    out = h[at] * _Q[salt]
    for j in range(1, k):
        out += h[at + j] * _Q[salt + j]
    return mix(out)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of an Arrow column of strings; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8))[: offsets[-1]], offsets


class Words:
    """hash, start and end (bytes) of every word of texts lo..hi, and first: the index of each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> None:
        hashes, starts, ends = [], [], []
        a, last = int(offsets[0]), int(offsets[-1])
        cuts = offsets[1:-1]
        while a < last:
            b = min(a + STRETCH, last)
            while b < last and kind[data[b - 1]] and kind[data[b]]:  # not inside a word
                step = np.flatnonzero(~kind[data[b : min(b + 4096, last)]])
                b = b + int(step[0]) if len(step) else min(b + 4096, last)
            x = data[a:b]
            is_word = kind[x]
            edge = np.empty(len(x) + 1, bool)
            edge[1:-1] = is_word[1:] != is_word[:-1]
            edge[0], edge[-1] = is_word[0], is_word[-1]
            lo, hi = np.searchsorted(cuts, (a, b), "right")
            inside = cuts[lo - 1 if lo and cuts[lo - 1] >= a else lo : hi] - a
            inside = inside[(inside > 0) & (inside < len(x))]
            split = np.unique(inside[is_word[inside] & is_word[inside - 1]])  # a text ends in the middle of a word
            at = np.flatnonzero(edge)
            if len(split):
                at = np.sort(np.concatenate([at, split, split]))
            s, e = at[0::2], at[1::2]
            power = _powers(_P, max(STRETCH + 4096, len(x)))
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(_T[x] * power[: len(x)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * _powers(_P_INVERSE, max(STRETCH + 4096, len(x)))[s]))
            starts.append(s + a)
            ends.append(e + a)
            a = b
        join = lambda v, t: np.concatenate(v) if v else np.zeros(0, t)
        self.hash, self.start, self.end = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def groups(offsets: np.ndarray, limit: int):
    """Ranges of texts of at most limit bytes together; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi
