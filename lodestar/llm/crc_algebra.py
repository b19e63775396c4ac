"""CRC-32 of many words and of their runs, without making the runs.

A CRC register is linear over GF(2): appending n bytes multiplies it by a matrix that depends on n only, so
crc(a + b) = shift(crc(a), len(b)) ^ crc(b). Each word's CRC is worked out once from its bytes; those of longer
runs follow from it by shifts, as array operations over all words of a batch.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

_POLY = 0xEDB88320
_SPACE = np.uint32(zlib.crc32(b" "))
#: Words of more bytes are given to zlib one by one; shifts by less than this are looked up at once.
_LONG = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    return t


_TABLE = _byte_table()


def _spread(columns: np.ndarray) -> np.ndarray:
    """Tables [4, 256] of a matrix given by the images of its 32 unit vectors: one lookup for each byte of a register."""
    out = np.zeros((4, 256), np.uint32)
    every = np.arange(256)
    for i in range(32):
        out[i // 8, (every >> (i % 8)) & 1 == 1] ^= columns[i]
    return out


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][(x >> 8) & 255] ^ t[2][(x >> 16) & 255] ^ t[3][x >> 24]


@lru_cache(1)
def _small() -> np.ndarray:
    """Tables for 0 to _LONG - 1 bytes, as [4, n * 256 + byte]."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out, columns = [], unit
    for _ in range(_LONG):
        out.append(_spread(columns))
        columns = (columns >> 8) ^ _TABLE[columns & 255]
    return np.ascontiguousarray(np.stack(out, 1).reshape(4, -1))


@lru_cache(64)
def _power(k: int) -> np.ndarray:
    """Tables for _LONG * 2**k bytes: each is the square of the one before."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k == 0:
        last = _small().reshape(4, _LONG, 256)[:, _LONG - 1]
        columns = _apply(last, unit)
        return _spread((columns >> 8) ^ _TABLE[columns & 255])
    return _spread(_apply(_power(k - 1), _apply(_power(k - 1), unit)))


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs (uint32) times the matrices for n more bytes each."""
    t, low = _small(), (n % _LONG).astype(np.int64) << 8
    out = t[0][low + (crc & 255)] ^ t[1][low + ((crc >> 8) & 255)] ^ t[2][low + ((crc >> 16) & 255)] ^ t[3][low + (crc >> 24)]
    high, k = n // _LONG, 0
    at = np.flatnonzero(high)
    while len(at):
        odd = at[(high[at] >> k) & 1 == 1]
        out[odd] = _apply(_power(k), out[odd])
        k += 1
        at = at[high[at] >> k > 0]
    return out


def word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each word data[start : start + length], a byte of all words at a time."""
    out = np.zeros(len(start), np.uint32)
    long = np.flatnonzero(length > _LONG)
    for i in long.tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]])
    order = np.argsort(length, kind="stable")[::-1][len(long) :]
    at, n = start[order], length[order]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    sizes = np.searchsorted(-n, -np.arange(1, _LONG + 1), "right")  # words of at least so many bytes
    for j, m in enumerate(sizes.tolist()):
        if not m:
            break
        r = register[:m]
        register[:m] = _TABLE[(r ^ data[at[:m] + j]) & 255] ^ (r >> 8)
    out[order] = ~register
    return out


def run_crcs(crc: np.ndarray, length: np.ndarray, text: np.ndarray, most: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to `most`: the CRC of every k consecutive words of one text, joined by single spaces, and the index of
    their first words. text: which text each word is of."""
    spaced = shift(np.full(len(crc), _SPACE, np.uint32), length) ^ crc  # of " " + word
    out, at, now = [(crc, np.arange(len(crc)))], np.arange(len(crc)), crc
    for k in range(1, most):
        inside = at + k < len(crc)
        at, now = at[inside], now[inside]
        inside = text[at] == text[at + k]
        at, now = at[inside], now[inside]
        now = shift(now, length[at + k] + 1) ^ spaced[at + k]
        out.append((now, at))
    return out
