"""Word-bigram scores from sharded Elias-Fano tries over the whole corpus.

1. Each task cuts its documents into chunks of about chunk_words words. A chunk keeps the 64-bit hashes of its distinct
   words and its tokens as numbers of these.
2. Each chunk sends every shard, a range of context hashes, its distinct words and distinct bigrams with their training
   counts: hot words are one entry for each chunk. A shard adds up, builds its trie and answers each chunk with the
   word's count, the context's back-off weight and the bigram's probability, found in the trie.
3. Each chunk scores its documents from the answers.
What is gathered grows with the input; a shard has about shard_words words of it, a chunk chunk_words. A context that is
followed by more words than that is split: its successors go to shards of their own by ranges of their hashes.

Smoothing is Witten and Bell's: a context with c successors, t of them different, gives a bigram that was seen n times
n / (c + t), and leaves t / (c + t) to p0(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). It needs nothing but the context's own
counts, so scores are the same for any number of shards and chunks. Two different words share a hash with a chance of
about 2**-64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fold, prepare, reclaim, release, shuffle_parts, written
from lodestar.llm.elias_fano import Trie, quantised, unquantised
from lodestar.llm.wordhash import NOT_SPACE, Words, bytes_of, groups

#: What ends a text, and what stands before its first word; no word hashes to them but by a chance of 2**-64.
END, START = np.uint64(0x5BD1E995A5A5A5A5), np.uint64(0x27D4EB2F165667C5)

CHUNKS = "chunk long, ids binary, held binary, sizes binary, words binary, tokens binary"
REQUESTS = "chunk long, shard int, words binary, counts binary, degrees binary, names binary, which binary, pairs binary"
ANSWERS = "chunk long, shard int, counts binary, backoff binary, seen binary, shard_tokens long, shard_words long"


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    def run(batches):
        release()
        part, k = TaskContext.get().partitionId(), 0

        def chunk(t: pa.Table, offsets: np.ndarray, data: np.ndarray, lo: int, hi: int) -> pa.RecordBatch:
            nonlocal k
            w = Words(data, offsets[lo : hi + 1], NOT_SPACE)
            words, n = np.unique(np.append(w.hash, (END, START)), return_inverse=True)
            end, numbers = n[-2], n[:-2].astype(np.uint32)
            tokens = np.insert(numbers, w.first[1:], end)
            ids, held = t.column(0).slice(lo, hi - lo).to_pylist(), t.column(2).slice(lo, hi - lo).to_pylist()
            raw = "\n".join("" if x is None else str(x) for x in ids).encode()
            row = [(part << 32) | k, raw, np.array(held, bool).tobytes(), (w.counts + 1).astype("<i8").tobytes(), words.tobytes(), tokens.astype("<u4").tobytes()]
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(row)], [x.split()[0] for x in CHUNKS.split(", ")])

        rest = None  # what doesn't fill a chunk yet
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            data, offsets = bytes_of(t.column(1).combine_chunks())
            of = list(groups(offsets, chunk_bytes))
            for lo, hi in of[:-1]:
                yield chunk(t, offsets, data, lo, hi)
            rest = t.slice(of[-1][0]) if of else None
        if rest is not None and rest.num_rows:
            data, offsets = bytes_of(rest.column(1).combine_chunks())
            yield chunk(rest, offsets, data, 0, rest.num_rows)

    return docs.mapInArrow(run, CHUNKS)


class _Chunk:
    """A chunk's distinct words, tokens and distinct bigrams, in the order in which requests and answers have them."""

    def __init__(self, words: bytes, tokens: bytes, sizes: bytes, held: bytes) -> None:
        self.words, self.tokens = np.frombuffer(words, "<u8"), np.frombuffer(tokens, "<u4").astype(np.int64)
        self.sizes = np.frombuffer(sizes, "<i8")
        self.train = np.repeat(np.frombuffer(held, np.uint8) == 0, self.sizes)
        context = np.roll(self.tokens, 1)
        context[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.words, START)
        self.pairs, self.pair_of = np.unique((context << 32) | self.tokens, return_inverse=True)

    def divided(self, split: "Split") -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """The pairs of whole contexts, and shard, context and pairs of each part of those that are split."""
        at = np.searchsorted(self.words, split.hashes)
        whole, parts = np.ones(len(self.pairs), bool), []
        for i, h, base in zip(at.tolist(), split.hashes.tolist(), split.base.tolist(), strict=True):
            if i == len(self.words) or self.words[i] != h:
                continue
            lo, hi = np.searchsorted(self.pairs, (i << 32, (i + 1) << 32))
            whole[lo:hi] = False
            cuts = [0, *np.searchsorted(self.words[self.pairs[lo:hi] & 0xFFFFFFFF], split.cuts(h)).tolist(), hi - lo]
            parts += [(base + j, i, np.arange(lo + a, lo + b)) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return np.flatnonzero(whole), parts

    def cuts(self, shards: int) -> np.ndarray:
        """The first word of each shard and their number."""
        edges = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)
        return np.concatenate([[0], np.searchsorted(self.words, edges), [len(self.words)]])


def _narrow(x: np.ndarray) -> bytes:
    """Numbers below 2**32, in as few bytes as their largest needs; the first byte says how many."""
    t = np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(t).itemsize]) + x.astype(t).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


class Split:
    """Contexts that are split: hash -> (successors in all, different ones, shards). Their shards are numbered from `first`
    on, by hash of the context and then of the successor."""

    def __init__(self, first: int, contexts: dict[int, tuple[int, int, int]] | None = None) -> None:
        self.first, self.contexts = first, contexts or {}
        self.hashes = np.array(sorted(self.contexts), np.uint64)
        n = np.array([self.contexts[int(h)][2] for h in self.hashes], np.int64)
        self.base = first + np.cumsum(n) - n

    def cuts(self, h: int) -> np.ndarray:
        """The first successor's hash of each shard of a context but the first."""
        n = self.contexts[h][2]
        return (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)

    def __contains__(self, h: int) -> bool:
        return h in self.contexts


def _heavy(chunks: DataFrame, tokens: int, limit: int) -> dict[int, int]:
    """Contexts with over `limit` successors in the training texts, of which there are tokens / limit at most. A chunk names
    those that have half of that share in it; what it leaves out is less than half the limit in all."""

    def counted(wanted: np.ndarray | None):
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    c = _Chunk(r["words"], r["tokens"], r["sizes"], r["held"])
                    n = np.bincount((c.pairs >> 32)[c.pair_of[c.train]], minlength=len(c.words))
                    at = np.flatnonzero((n > 0) & (2 * n * tokens >= limit * len(c.tokens))) if wanted is None else np.flatnonzero(np.isin(c.words, wanted))
                    yield pa.RecordBatch.from_arrays([pa.array(c.words[at].view(np.int64)), pa.array(n[at].astype(np.int64))], ["word", "n"])

        return chunks.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))

    named = [r.word for r in counted(None).where(F.col("n") * 2 > limit).collect()]
    if not named:
        return {}
    found = counted(np.array(named, np.int64).view(np.uint64)).where(F.col("n") > limit).collect()
    return {int(np.int64(r.word).astype(np.uint64)): r.n for r in found}


def _requests(chunks: DataFrame, shards: int, split: Split, only_split: bool = False) -> DataFrame:
    names = [x.split()[0] for x in REQUESTS.split(", ")]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = _Chunk(r["words"], r["tokens"], r["sizes"], r["held"])
                counts = np.bincount(c.tokens[c.train], minlength=len(c.words))
                pairs = np.bincount(c.pair_of[c.train], minlength=len(c.pairs))
                rows = []

                def add(shard, words, pair):
                    """words: a range of words; pair: numbers of the pairs whose contexts lie in it."""
                    lo, hi = words
                    context, successor = c.pairs[pair] >> 32, c.pairs[pair] & 0xFFFFFFFF
                    used, which = np.unique(successor, return_inverse=True)
                    rows.append([r["chunk"], shard, c.words[lo:hi].tobytes(), _narrow(counts[lo:hi]), _narrow(np.bincount(context - lo, minlength=hi - lo)), c.words[used].tobytes(), _narrow(which), _narrow(pairs[pair])])

                whole, parts = c.divided(split)
                if not only_split:
                    cuts = c.cuts(shards)
                    at = np.searchsorted(c.pairs[whole] >> 32, cuts)
                    for s in range(shards):
                        add(s, (cuts[s], cuts[s + 1]), whole[at[s] : at[s + 1]])
                for shard, word, pair in parts:
                    add(shard, (word, word + 1), pair)
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return chunks.mapInArrow(run, REQUESTS)


def shard_trie(words: np.ndarray, counts: np.ndarray, degrees: np.ndarray, successors: np.ndarray, names: np.ndarray, pairs: np.ndarray, split: Split):
    """A trie of summed training counts: words (sorted) with counts, and their successors, numbers of names (sorted). What
    is known of contexts that are split comes from split."""
    context = np.repeat(np.arange(len(words)), degrees)
    total, kinds = np.bincount(context, pairs, len(words)), degrees.astype(np.float64)
    at = np.searchsorted(words, split.hashes)
    for i, h in zip(at.tolist(), split.hashes.tolist(), strict=True):
        if i < len(words) and words[i] == h:
            total[i], kinds[i], _ = split.contexts[h]
    backoff = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    seen = pairs / (total + kinds)[context]
    pointers = np.concatenate([[0], np.cumsum(degrees)])
    used, numbers = np.unique(successors, return_inverse=True)
    return Trie.build(words, counts, quantised(backoff), pointers, names[used], numbers, quantised(seen))


def _summed(table: pa.Table) -> tuple:
    """The requests of a shard added up: rows, words, each request's places in them, counts, names, each request's pairs,
    pairs (context * names + successor), their places in them and their counts."""
    rows = table.to_pylist()
    words = [np.frombuffer(r["words"], "<u8") for r in rows]
    all_words, word_of = np.unique(np.concatenate(words), return_inverse=True)
    names = [np.frombuffer(r["names"], "<u8") for r in rows]
    all_names, name_of = np.unique(np.concatenate(names), return_inverse=True)
    counts = np.bincount(word_of, np.concatenate([_wide(r["counts"]) for r in rows]), len(all_words)).astype(np.int64)
    keys, w0, n0 = [], 0, 0
    for r, w, n in zip(rows, words, names, strict=True):
        context = np.repeat(word_of[w0 : w0 + len(w)], _wide(r["degrees"]))
        keys.append(context * len(all_names) + name_of[n0 : n0 + len(n)][_wide(r["which"])])
        w0, n0 = w0 + len(w), n0 + len(n)
    pairs, pair_of = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(pair_of, np.concatenate([_wide(r["pairs"]) for r in rows]), len(pairs)).astype(np.int64)
    return rows, words, all_words, word_of, counts, all_names, keys, pairs, pair_of, times


def _kinds(table: pa.Table) -> pa.Table:
    """Different successors of a split context in one of its shards."""
    *_, all_words, _, _, _, _, _, _, times = _summed(table)
    return pa.table([pa.array(all_words.view(np.int64)), pa.array([int((times > 0).sum())], pa.int64())], names=["word", "n"])


def _answerer(split: Split):
    def answer(table: pa.Table) -> pa.Table:
        rows, words, all_words, word_of, counts, all_names, keys, pairs, pair_of, times = _summed(table)
        context, successor = pairs // max(1, len(all_names)), pairs % max(1, len(all_names))
        if rows[0]["shard"] >= split.first:
            counts[:] = 0  # the word itself is counted in its own shard
        kept, known = times > 0, np.zeros(len(all_words), bool)
        known[context[kept]] = True
        known |= (counts > 0) | np.isin(all_words, split.hashes)
        place = np.cumsum(known) - 1
        trie = Trie(shard_trie(all_words[known], counts[known], np.bincount(place[context[kept]], minlength=int(known.sum())), successor[kept], all_names, times[kept], split))

        # From here on everything comes from the trie.
        at = trie.words.find(all_words)
        count_of = np.where(at >= 0, trie.counts[np.maximum(at, 0)] if len(trie.counts) else 0, 0)
        back_of = np.where(at >= 0, trie.backoff[np.maximum(at, 0)] if len(trie.backoff) else 0, 0).astype("<u2")
        first = np.searchsorted(context, np.arange(len(all_words) + 1))
        seen = trie.look_up(all_words, first, all_names, successor)
        tokens, kinds = int(trie.counts.sum()), int((trie.counts > 0).sum())
        out, w0, p0 = [], 0, 0
        for r, w, k in zip(rows, words, keys, strict=True):
            mine = word_of[w0 : w0 + len(w)]
            out.append([r["chunk"], r["shard"], count_of[mine].astype("<i8").tobytes(), back_of[mine].tobytes(), seen[pair_of[p0 : p0 + len(k)]].astype("<u2").tobytes(), tokens, kinds])
            w0, p0 = w0 + len(w), p0 + len(k)
        kinds_of = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds_of, strict=True)], names=[x.split()[0] for x in ANSWERS.split(", ")])

    return answer


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(total: int, kinds: int, split: Split):
    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        r = chunk.to_pylist()[0]
        c = _Chunk(r["words"], r["tokens"], r["sizes"], r["held"])
        rows = sorted(answers.to_pylist(), key=lambda x: x["shard"])
        joined = lambda k, t, of: np.frombuffer(b"".join(x[k] for x in of), t)
        ranges, rest = [x for x in rows if x["shard"] < split.first], [x for x in rows if x["shard"] >= split.first]
        count, back = joined("counts", "<i8", ranges), joined("backoff", "<u2", ranges)
        whole, parts = c.divided(split)
        seen = np.empty(len(c.pairs), np.uint16)
        seen[whole] = joined("seen", "<u2", ranges)
        for (_, _, pair), x in zip(parts, rest, strict=True):
            seen[pair] = np.frombuffer(x["seen"], "<u2")
        p0 = (count + 0.5) / (total + 0.5 * (kinds + 1))
        context, successor = c.pairs >> 32, c.pairs & 0xFFFFFFFF
        p = np.where(seen < 65535, unquantised(seen), 0.0) + unquantised(back)[context] * p0[successor]
        first = np.cumsum(c.sizes) - c.sizes
        add = lambda x: np.add.reduceat(x, first)
        known = add((count[c.tokens] > 0).astype(np.int64))
        ids = [int(x) if x else None for x in r["ids"].decode().split("\n")]
        held = np.frombuffer(r["held"], np.uint8) != 0
        cols = [pa.array(ids, pa.int64()), pa.array(held), pa.array(c.sizes), pa.array(known), pa.array(np.full(len(ids), total)), pa.array(add(np.log10(p0)[c.tokens])), pa.array(add(np.log10(p)[c.pair_of]))]
        return pa.table(cols, names=[x.split()[0] for x in SCORES.split(", ")])

    return score


def score_corpus(docs: DataFrame, folds: int = 5, held_out: int = 1, chunk_words: int = 1 << 20, shard_words: int = 1 << 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES for each row of docs; null and empty texts are an end alone. A row without id trains. Repeated rows stay
    and count as often. Other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    held = F.coalesce(fold(id_col, folds) == held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    chunks = written(_chunks(rows, 6 * chunk_words), "chunks")
    size = chunks.agg(F.sum(F.length("tokens") / 4)).first()[0] or 0
    shards = max(1, min(4 * shuffle_parts(spark), math.ceil(size / (1 << 16))), math.ceil(size / shard_words))
    heavy = _heavy(chunks, int(size), shard_words) if size > shard_words else {}
    split = Split(shards, {h: (n, 0, math.ceil(n / shard_words)) for h, n in heavy.items()})
    if heavy:
        kinds = _requests(chunks, shards, split, only_split=True).groupBy("shard").applyInArrow(_kinds, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        split = Split(shards, {h: (heavy[h], r.n, math.ceil(heavy[h] / shard_words)) for r in kinds for h in [int(np.int64(r.word).astype(np.uint64))]})
    answers = written(_requests(chunks, shards, split).groupBy("shard").applyInArrow(_answerer(split), ANSWERS), "answers")
    reclaim(spark)
    total = answers.groupBy("shard").agg(F.max("shard_tokens").alias("n"), F.max("shard_words").alias("v")).agg(F.sum("n"), F.sum("v")).first()
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scorer(total[0] or 0, total[1] or 0, split), SCORES)
