"""Whole texts to token ids with the tokenizers library, as bytes in a table.

The pre-tokenizer of a byte-level BPE starts a new piece at a single space between two visible
characters, so a text may be cut there without a change to its ids. Pieces between such spaces
repeat, and each worker keeps the ids of those that it has met in a bounded store. What holds no
such place (double spaces, other scripts' spaces, line ends beside spaces) goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import prepare, resident
from lodestar.llm.wordhash import _P, _P_INVERSE, _powers, bytes_of, groups, mix

#: White space other than the space and the line end, by any library's reading of \s. With one of these only
#: the general cut is used.
_ODD = [chr(i) for i in (*range(9), *range(11, 32), 0x7F, 0x85, 0xA0, 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_GAP = re.compile("(?<=[!-~\xa1-\xac\xae-ɏ])(?= [!-~\xa1-\xac\xae-ɏ])")
#: A comma or stop behind a letter or digit is a piece of its own. A text with one behind anything else, or
#: with letters of other scripts, keeps its marks at the words.
_STRAY = re.compile("[,.](?<![A-Za-z0-9À-ÖØ-öø-ɏ][,.])")
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
#: Letters and marks are two pieces of the pre-tokenizer.
_MARKED = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,!?;:#*$%&|]+)")
#: Set before a piece that has no space before it.
_BARE = "\0"
#: Characters of a text that are worked on at once, and bytes that a worker's store of pieces may hold.
STRETCH, STORE = 1 << 20, 64 << 20
#: The byte-level alphabet: each byte's character. Bytes that Latin-1 doesn't show follow from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


def stretches(text: str, limit: int = STRETCH):
    """Cuts a long text at safe spaces only; a stretch without any stays whole."""
    at = 0
    while len(text) - at > limit:
        m = _GAP.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Coder:
    """ids(text): the ids as little-endian bytes of two or, for a large vocabulary, four each."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one text at a time: Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.direct = self.tokenizer.normalizer is None
        self.store: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def _piece(self, text: str) -> list[int]:
        """The ids of a text that the pre-tokenizer leaves in one piece."""
        shown = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(_ALPHABET)
        return [t.id for t in self.model.tokenize(shown)]

    def _encoded(self, x: str) -> bytes:
        bare = x[0] == _BARE
        y = x[1:] if bare else x
        if self.direct and y:
            if y.isalpha():  # letters behind one space are one piece of the pre-tokenizer
                return array(self.code, self._piece(y if bare else " " + y)).tobytes()
            if bare and y[0] == "\n" and y[1:].isalpha():
                return array(self.code, self._piece("\n") + self._piece(y[1:])).tobytes()
            if m := _MARKED.fullmatch(y):
                return array(self.code, self._piece(m[1] if bare else " " + m[1]) + self._piece(m[2])).tobytes()
        return array(self.code, self.tokenizer.encode(y if bare else " " + x, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        store, before, code, tokenize, held = self.store, self.before, self.code, self.model.tokenize, 0
        for x in pieces:
            b = before.get(x)
            if b is None:
                if x.isalpha() and x.isascii() and self.direct:  # letters behind one space are one piece
                    b = array(code, [t.id for t in tokenize("Ġ" + x)]).tobytes()
                else:
                    b = self._encoded(x)
            store[x] = b
            held += len(x) + len(b) + 150
        self.held += held

    def _joined(self, pieces: list[str]) -> bytes:
        out = list(map(self.store.get, pieces))
        if None in out:
            self._learn({x for x, b in zip(pieces, out, strict=True) if b is None})
            out = map(self.store.__getitem__, pieces)
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.held > STORE // 2:  # what is met again comes back from the half before
            self.before, self.store, self.held = self.store, {}, 0
        out = []
        for x in stretches(text):
            if "  " in x or "\n " in x or " \n" in x or x[-1] in " \n" or x[0] == "\n" or any(c in x for c in _ODD):
                out.append(self._joined([y[1:] if y[0] == " " and len(y) > 1 and y[1] != " " else _BARE + y for y in _GAP.split(x)]))
                continue
            if not _STRAY.search(x) and (x.isascii() or not _OTHER.search(x)):
                x = x.replace(", ", " \0, ").replace(". ", " \0. ").replace(".\n", " \0. \0\n")
            out.append(self._joined((x[1:] if x[0] == " " else _BARE + x).split(" ")))
        return b"".join(out)


_BYTES = np.arange(256)
_SEEN = ((_BYTES > 32) & (_BYTES < 127)) | (_BYTES > 127)
_ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_BREAK = (_BYTES == 32) | (_BYTES == 10)
#: First bytes of characters among which is white space beyond ASCII, with their second bytes.
_WIDE = {0xC2: (0x85, 0xA0), 0xE1: (0x9A, 0xA0), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
_RNG = np.random.Generator(np.random.PCG64(77))
_T = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of texts that are cut at once, slots of a worker's table of pieces, and ids that it holds.
GROUP, SLOTS, POOL = 1 << 20, 1 << 22, 1 << 24


class Pieces:
    """The ids of many texts at once. Pieces are found and hashed by array operations on the texts' bytes and looked up
    in a table of 64-bit hashes; only pieces that are new go to the library. Texts with white space beyond ASCII, which is
    also where pieces could be cut wrongly, and very long ones go through Coder.ids()."""

    def __init__(self, path: str) -> None:
        self.coder = Coder(path)
        self.dtype = self.coder.dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.offset, self.length = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used, self.filled = np.zeros(1 << 16, self.dtype), 0, 0

    def _cut(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of pieces in bytes b; first: starts of the texts, none of which is empty."""
        n = len(b)
        seen, start = _SEEN[b], np.zeros(n + 1, bool)
        before = np.empty(n, bool)
        before[1:] = seen[:-1]
        before[first] = False
        after = np.empty(n, bool)
        after[:-1] = seen[1:]
        after[first[1:] - 1] = False
        after[-1] = False
        both = before & after
        start[:-1] = (b == 32) & both
        lines = np.flatnonzero((b == 10) & both)
        start[lines] = True
        start[lines + 1] = True
        marks = np.flatnonzero((b == 44) | (b == 46))
        marks = marks[before[marks]]
        marks = marks[marks + 1 < n]
        last, two = b[marks - 1], b[np.maximum(marks - 2, 0)]
        letter = _ALNUM[last] | ((two == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        ends = np.zeros(n + 1, bool)
        ends[first] = True
        start[marks[letter & _BREAK[b[marks + 1]] & ~ends[marks + 1]]] = True
        start[first] = True
        return np.flatnonzero(start[:-1])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == h, at, -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
            got = self.keys[at[open_]]
            hit = got == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (got != 0)]
        return out

    def _learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        ids = []
        for x in texts:
            y = x.decode()
            ids.append(self.coder._encoded(y[1:] if y[0] == " " and len(y) > 1 else _BARE + y))
        n = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
        whole = np.frombuffer(b"".join(ids), self.dtype)
        while self.used + len(whole) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(whole)] = whole
        offset = self.used + np.cumsum(n) - n
        self.used += len(whole)
        self.filled += len(h)
        at, todo = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            slots, k = np.unique(at[free], return_index=True)
            self.keys[slots], self.offset[slots], self.length[slots] = h[free[k]], offset[free[k]], n[free[k]]
            done = np.zeros(len(h), bool)
            done[free[k]] = True
            todo = todo[~done[todo]]
            at[todo] = (at[todo] + 1) & (SLOTS - 1)

    def group(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of texts as bytes; together they should have about GROUP bytes."""
        size = np.diff(offsets)
        out = [b""] * len(size)
        if len(data) == 0 or offsets[-1] == offsets[0]:
            return out
        b = data[offsets[0] : offsets[-1]]
        first = offsets[:-1] - offsets[0]
        slow = np.zeros(len(size), bool)
        for lead, seconds in _WIDE.items():
            at = np.flatnonzero(b[:-1] == lead)
            if len(at):
                slow[np.searchsorted(first, at[np.isin(b[at + 1], seconds)], "right") - 1] = True
        if size.max() > 2 * GROUP:
            slow |= size > 2 * GROUP
        if slow.any():
            for i in np.flatnonzero(slow & (size > 0)).tolist():
                out[i] = self.coder.ids(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            keep = np.flatnonzero(~slow & (size > 0))
            b = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in keep.tolist()] or [b[:0]])
        else:
            keep = np.flatnonzero(size > 0)
        if not len(b):
            return out
        if self.filled > SLOTS * 5 // 8 or self.used > POOL:
            self.clear()
        n = size[keep]
        first = np.cumsum(n) - n
        s = self._cut(b, first)
        e = np.append(s[1:], len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        top = max(GROUP, len(b))
        np.cumsum(_T[b] * _powers(_P, top)[: len(b)], out=total[1:])
        h = mix((total[e] - total[s]) * _powers(_P_INVERSE, top)[s] + (e - s).astype(np.uint64))
        h[h == 0] = 1
        slot = self._find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            keys, k = np.unique(h[new], return_index=True)
            self._learn(keys, [b[x:y].tobytes() for x, y in zip(s[new[k]].tolist(), e[new[k]].tolist(), strict=True)])
            slot[new] = self._find(h[new])
        m = self.length[slot].astype(np.int64)
        upto = np.cumsum(m)
        ids = self.pool[np.repeat(self.offset[slot] - (upto - m), m) + np.arange(upto[-1])].tobytes()
        bounds = np.concatenate([[0], upto])[np.searchsorted(s, np.append(first, len(b)))] * self.dtype.itemsize
        for i, x, y in zip(keep.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[x:y]
        return out

    def column(self, texts: pa.Array) -> list[bytes]:
        data, offsets = bytes_of(texts)
        return [x for lo, hi in groups(offsets, GROUP) for x in self.group(data, offsets[lo : hi + 1])]


def coder(path: str) -> Pieces:
    return resident(("coder", path), lambda: Pieces(path))


#: counts is null but in a partition's last row, which has how often each id occurs in the partition.
TOKENS = "part int, row long, doc_id long, ahead long, n_tokens long, ids binary, counts binary"


def tokenize(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its partition and place there, the ids before it in that partition, its
    ids as bytes (two each where the vocabulary allows) and how many. A null or empty text has the end id alone.
    Equal ids and repeated rows stay separate rows; other columns are not read."""
    prepare(docs.sparkSession)

    def run(batches):
        c, part, row, ahead = coder(path), TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.array([end_id], c.dtype).tobytes()
        total = np.zeros(c.coder.tokenizer.get_vocab_size(), np.int64)

        def rows(doc_ids: pa.Array, ids: list[bytes], last: bool):
            nonlocal row, ahead
            n = np.array([len(x) // c.dtype.itemsize for x in ids], np.int64)
            upto = ahead + np.cumsum(n)
            k = len(ids)
            seen = np.bincount(np.frombuffer(b"".join(ids), c.dtype), minlength=len(total))
            total[:] += seen[: len(total)]
            counts = [None] * (k - 1) + [total.tobytes() if last else None]
            out = pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(np.arange(row, row + k)), doc_ids, pa.array(upto - n), pa.array(n), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], [x.split()[0] for x in TOKENS.split(", ")])
            row, ahead = row + k, int(upto[-1])
            return out

        held = None  # the last row, which waits for the end
        for b in batches:
            if not b.num_rows:
                continue
            ids = [x + end for x in c.column(b.column(1))]
            if held:
                yield rows(*held, False)
            if len(ids) > 1:
                yield rows(b.column(0).slice(0, len(ids) - 1), ids[:-1], False)
            held = (b.column(0).slice(len(ids) - 1), ids[-1:])
        if held:
            yield rows(*held, True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, TOKENS)


def id_width(tokens: DataFrame) -> int:
    """Bytes of each id in the rows that tokenize() wrote."""
    r = tokens.where("n_tokens > 0").select((F.octet_length("ids") / F.col("n_tokens")).cast("int").alias("n")).first()
    return r.n if r else 2
