"""Elias-Fano sequences and a two-level n-gram trie over them, in one flat buffer.

A monotone sequence of n numbers below u keeps floor(log2(u / n)) low bits of each number packed and the rest in unary
in a bit vector with running counts of its words. All queries work on arrays of positions or values, on any
buffer: bytes, an Arrow buffer or a memory-mapped file.
"""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64


def _select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the set bit number r (from 0) in each word."""
    words, r = words.copy(), r.astype(np.int64)
    at = np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & U((1 << width) - 1)).astype(np.int64)
        up = r >= low
        r = np.where(up, r - low, r)
        at = np.where(up, at + width, at)
        words = np.where(up, words >> U(width), words)
    return at


class Sequence:
    """A non-decreasing sequence of unsigned 64-bit numbers."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width = int(head[0]), int(head[1])
        self.low, self.high = low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @staticmethod
    def pack(values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, min(63, (int(values[-1]) + 1).bit_length() - n.bit_length())) if n else 0
        high = (values >> U(width)).astype(np.int64) if width else values.astype(np.int64)
        bits = np.zeros((int(high[-1]) + n + 64) // 64 * 64 if n else 64, np.uint8)
        bits[high + np.arange(n)] = 1
        low = np.zeros((n * width + 127) // 64, np.uint64)
        if width:
            at, x = np.arange(n, dtype=np.int64) * width, values & U((1 << width) - 1)
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, x << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (U(64) - shift[over]))
        return [np.array([n, width], np.uint64), low, np.packbits(bits, bitorder="little").view(np.uint64)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        x = self.low[word] >> shift
        over = (at & 63) + self.width > 64
        x[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return x & U((1 << self.width) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at positions i."""
        i = i.astype(np.int64)
        w = np.searchsorted(self.ones, i, "right") - 1
        high = w * 64 + _select_in_word(self.high[w], i - self.ones[w]) - i
        return (high.astype(np.uint64) << U(self.width)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """The first position whose high part is at least `high`."""
        z = high - 1  # the zero that ends the bucket before
        w = np.searchsorted(self.zeros, np.maximum(z, 0), "right") - 1
        inside = w < len(self.high)
        w = np.minimum(w, len(self.high) - 1)
        at = w * 64 + _select_in_word(~self.high[w], z - self.zeros[w]) - z
        return np.where(z < 0, 0, np.where(inside, np.minimum(at, self.n), self.n))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first position of each value, or -1: successor search inside of the value's bucket of high parts."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high, low = values >> U(self.width), values & U((1 << self.width) - 1)
        ok = np.flatnonzero(high <= U(int(self.zeros[-1])))
        at, end = self._bucket(high[ok].astype(np.int64)), self._bucket(high[ok].astype(np.int64) + 1)
        want = low[ok]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            x = self._low(at[open_])
            hit = x == want[open_]
            out[ok[open_[hit]]] = at[open_[hit]]
            at[open_] += 1
            open_ = open_[(x < want[open_]) & (at[open_] < end[open_])]
        return out


#: Steps of the quantised logarithms to base 10; they are rounded down, so that no distribution exceeds 1.
STEPS = 4096


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(65535, np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEPS)).astype(np.uint16)


def unquantised(code: np.ndarray) -> np.ndarray:
    return np.power(10.0, code.astype(np.float64) / -STEPS)


class Trie:
    """Level 1: sorted 64-bit words with their counts and quantised back-off weights, and monotone pointers to their
    successors. Level 2: the successors' numbers, increasing in each context and made monotone over all contexts
    by adding the last sum of the context before; quantised discounted probabilities beside them."""

    PARTS = ("words", "counts", "backoff", "pointers", "names", "successors", "seen")

    def __init__(self, buffer) -> None:
        head = np.frombuffer(buffer, np.int64, 32)
        raw = lambda k, t: np.frombuffer(buffer, t, int(head[2 * k + 1]), int(head[2 * k]))
        sequence = lambda k: Sequence(raw(k, np.uint64), raw(k + 1, np.uint64), raw(k + 2, np.uint64))
        self.words, self.counts, self.backoff = sequence(0), raw(3, np.int64), raw(4, np.uint16)
        self.pointers, self.names, self.successors, self.seen = sequence(5), sequence(8), sequence(11), raw(14, np.uint16)

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, backoff: np.ndarray, pointers: np.ndarray, names: np.ndarray, successors: np.ndarray, seen: np.ndarray) -> mmap.mmap:
        """pointers: len(words) + 1 places in successors, which are numbers of names, increasing in each context."""
        ends = np.flatnonzero(np.diff(pointers)) if len(words) else np.zeros(0, np.int64)
        last = successors[pointers[ends + 1] - 1].astype(np.uint64) + U(1)
        base = np.cumsum(last) - last
        monotone = successors.astype(np.uint64) + np.repeat(base, np.diff(pointers)[ends])
        arrays = [*Sequence.pack(words), counts.astype(np.int64), backoff, *Sequence.pack(pointers), *Sequence.pack(names), *Sequence.pack(monotone), seen]
        head, at = np.zeros(32, np.int64), 256
        for k, a in enumerate(arrays):
            head[2 * k : 2 * k + 2] = at, len(a)
            at += (a.nbytes + 7) // 8 * 8
        out = mmap.mmap(-1, max(at, 256))
        out[:256] = head.tobytes()
        for k, a in enumerate(arrays):
            out[int(head[2 * k]) : int(head[2 * k]) + a.nbytes] = np.ascontiguousarray(a).tobytes()
        return out

    def look_up(self, contexts: np.ndarray, first: np.ndarray, names: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Codes of successors, 65535 where the trie has none. contexts: distinct words; the successors of contexts[i]
        are names[which[first[i] : first[i + 1]]]."""
        out = np.full(len(which), 65535, np.uint16)
        at = self.words.find(contexts)
        known = np.flatnonzero(at >= 0)
        if not len(known) or not self.successors.n:
            return out
        lo, hi = self.pointers.at(at[known]).astype(np.int64), self.pointers.at(at[known] + 1).astype(np.int64)
        base = np.where(lo > 0, self.successors.at(np.maximum(lo - 1, 0)) + U(1), U(0))
        n = np.diff(first)[known]
        query = np.repeat(first[:-1][known], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        number = self.names.find(names)[which[query]]
        named = number >= 0
        got = self.successors.find(np.where(named, number, 0).astype(np.uint64) + np.repeat(base, n))
        ok = named & (got >= np.repeat(lo, n)) & (got < np.repeat(hi, n))
        out[query[ok]] = self.seen[got[ok]]
        return out
