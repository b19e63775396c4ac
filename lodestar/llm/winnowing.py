"""Benchmark decontamination by winnowing.

Of every K consecutive words the hash is taken, and of every W consecutive such hashes the smallest is a
fingerprint. Two texts that share K + W - 1 = WINDOW words in a row share a fingerprint, so none is missed.
Fingerprints of documents that are also fingerprints of a benchmark item are hits; at each hit the whole
window of WINDOW words is compared, first by hash and then by its words, and every word inside a window
that occurs is marked. Items shorter than WINDOW are one window; their fingerprint is the hash of all their words.

The benchmark is a stated query set. It is worked off in blocks of at most block_words words, so what is
broadcast is bounded; a benchmark of more blocks takes one pass over the documents for each.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import LOWER, arrow, prepare, resident, written
from lodestar.llm.wordhash import ALPHANUMERIC, Words, bytes_of, groups, runs, runs_at

WINDOW, K = 10, 5
W = WINDOW - K + 1
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_BITS = 22
#: Bytes of texts that are worked on at once; a longer text is alone.
GROUP = 1 << 20


@dataclass
class Index:
    """Fingerprints of a block of items: for each window length the sorted hashes of windows, their words and items."""

    fingerprints: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    windows: dict[int, tuple[np.ndarray, list[str], list[list[str]]]] = field(default_factory=dict)

    def seen(self, sorted_hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[sorted_hashes >> np.uint64(64 - _BITS)] = True
        return bits


def _sorted_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return np.where(table[at] == x, at, -1) if len(table) else np.full(len(x), -1)


def smallest(h: np.ndarray) -> np.ndarray:
    """The fingerprint of each window."""
    g, n = runs(h, K), len(h) - WINDOW + 1
    out = g[:n].copy()
    for j in range(1, W):
        np.minimum(out, g[j : n + j], out=out)
    return out


def build_index(items: list[tuple[str | None, str]]) -> Index:
    """items: (id, text). A null id can't be reported; its windows still hit."""
    found: dict[int, dict[int, tuple[str, set[str]]]] = {}
    prints = []
    for item, text in items:
        words = WORDS.findall(text.translate(LOWER))
        data, offsets = bytes_of(pa.array([text]))
        h = Words(data, offsets, ALPHANUMERIC).hash
        n = min(WINDOW, len(words))
        if not n:
            continue
        if n == WINDOW:
            prints.append(smallest(h))
        for i, x in enumerate(runs(h, n, 32).tolist()):
            of = found.setdefault(n, {}).setdefault(x, (" ".join(words[i : i + n]), set()))[1]
            if item is not None:
                of.add(item)
    out = Index(np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64))
    for n, table in found.items():
        keys = sorted(table)
        out.windows[n] = (np.array(keys, np.uint64), [table[k][0] for k in keys], [sorted(table[k][1]) for k in keys])
    return out


class Matcher:
    def __init__(self, index: Index) -> None:
        self.index = index
        self.bits = index.seen(index.fingerprints)
        self.window_bits = {n: index.seen(t[0]) for n, t in index.windows.items() if n < WINDOW}

    def match(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]], np.ndarray]:
        """Words of each text, marks of all words, items of the texts that have any, and each text's first word."""
        w = Words(data, offsets, ALPHANUMERIC)
        h, n = w.hash, len(w.hash)
        marked = np.zeros(n, bool)
        items: dict[int, set[str]] = {}
        text_of = w.text_of() if n else None
        for size, (keys, words, of) in self.index.windows.items():
            if n < size:
                continue
            if size == WINDOW:
                f = smallest(h)
                at = np.flatnonzero(self.bits[f >> np.uint64(64 - _BITS)])
                at = at[_sorted_in(f[at], self.index.fingerprints) >= 0]
                g = runs_at(h, size, at, 32)
            else:
                g = runs(h, size, 32)
                at = np.flatnonzero(self.window_bits[size][g >> np.uint64(64 - _BITS)])
                g = g[at]
            found = _sorted_in(g, keys)
            ok = (found >= 0) & (text_of[at] == text_of[at + size - 1])
            for i, k in zip(at[ok].tolist(), found[ok].tolist(), strict=True):
                raw = data[w.start[i] : w.end[i + size - 1]].tobytes().decode().translate(LOWER)
                if " ".join(WORDS.findall(raw)) == words[k]:
                    marked[i : i + size] = True
                    items.setdefault(int(text_of[i]), set()).update(of[k])
        return w.counts, marked, items, w.first


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Blocks of items; only one block's texts are on the driver at a time."""
    held: list[tuple[str | None, str]] = []
    n = 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).distinct().toLocalIterator():
        held.append((r[0], r[1]))
        n += len(r[1]) // 4
        if n >= block_words:
            yield held
            held, n = [], 0
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 2_000_000, suffix: str = "") -> DataFrame:
    """The rows and columns of docs and n_words, n_hit, spans (first word and the one after the last of each run
    of marked words) and items (ids as strings, sorted), each name with suffix. Null or empty texts and items have
    no words; repeated rows stay; an empty benchmark hits nothing. If docs has such names already, give a suffix."""
    spark = docs.sparkSession
    prepare(spark)
    names = [x + suffix for x in ("n_words", "n_hit", "spans", "items")]
    if set(names) & set(docs.columns):
        raise ValueError(f"docs has {sorted(set(names) & set(docs.columns))}; give a suffix")
    extra = T._parse_datatype_string("n_words long, n_hit long, spans array<struct<first: long, end: long>>, items array<string>")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, f.dataType) for k, f in zip(names, extra.fields, strict=True)]])
    place, own = docs.columns.index(text_col), len(docs.columns)
    to = arrow(schema)
    df = docs
    for i, block in enumerate(_blocks(benchmark, item_col, item_text_col, block_words)):
        if i:
            df = written(df, "winnow")
        shared = spark.sparkContext.broadcast(build_index(block))

        def run(batches, shared=shared, key=uuid.uuid4().hex, again=i > 0):
            m = resident(("winnow", key), lambda: Matcher(shared.value))
            for b in batches:
                data, offsets = bytes_of(b.column(place))
                words, hits, spans, items = [], [], [], []
                for lo, hi in groups(offsets, GROUP):
                    n, marked, found, first = m.match(data, offsets[lo : hi + 1])
                    words += n.tolist()
                    if again:
                        for k in range(lo, hi):
                            for s in b.column(own + 2)[k].as_py():
                                marked[first[k - lo] + s["first"] : first[k - lo] + s["end"]] = True
                            if old := b.column(own + 3)[k].as_py():
                                found.setdefault(k - lo, set()).update(old)
                    total = np.concatenate([[0], np.cumsum(marked)])
                    per = total[first[1:]] - total[first[:-1]]
                    hits += per.tolist()
                    for k in range(hi - lo):
                        items.append(sorted(found.get(k, ())))
                        if not per[k]:
                            spans.append([])
                            continue
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], marked[first[k] : first[k + 1]].astype(np.int8), [0]])))
                        spans.append([{"first": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
                columns = [*b.columns[:own], *(pa.array(v, t.type) for v, t in zip((words, hits, spans, items), list(to)[own:], strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(columns, to, strict=True)], schema=to)

        df = df.mapInArrow(run, schema)
    return df


def digest(df: DataFrame) -> DataFrame:
    """doc_id and the contract's columns of contamination()."""
    ids = F.array_join("items", ",")
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], bench: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, sha, contaminated) by comparing every window with every window."""
    items = [(str(i), w) for i, t in bench if (w := WORDS.findall((t or "").translate(LOWER)))]
    out = []
    for d, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        hit, got = set(), set()
        for i, x in items:
            n = min(WINDOW, len(x))
            of = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in of:
                    hit |= set(range(j, j + n))
                    got.add(i)
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out
