"""Token ids in a compact file format: static range asymmetric numeral system.

The format is a folder with two tables.
  table/   one row (symbol, freq) for each id that occurs; freq is scaled to a sum of 2**SCALE.
  blocks/  one row for each block: part, block, first (ids before it in its part), n_tokens, doc_ids and
           doc_tokens (whole documents, in order), states (LANES final coder states), words (the 32-bit
           stream), checkpoints (step, word, states) and crc32 of the ids as little-endian 32-bit integers.
Id i of a block belongs to lane i % LANES; each lane has its own coder state and all lanes share one word
stream. A block can be decoded alone, and from each of its checkpoints, so decoding is parallel over blocks, and inside
of a block over the stretches between its checkpoints. Parts ascend by document id; blocks and documents ascend inside a part.
Blocks lie in Parquet so that Spark's writers and readers serve any file system, with its commit protocol.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import arrow, drop, new_path, prepare, resident, shuffle_parts, written
from lodestar.llm.encoding import id_width, tokenize

SCALE, LANES, STEPS = 18, 2048, 128
#: A block closes when it has so many ids; a longer document has a block of its own.
BLOCK = 1 << 19
LOW = np.uint64(1 << 31)
BLOCKS = "part int, block long, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, states binary, words binary, checkpoints array<struct<step: int, word: long, states: binary>>, crc32 long"


def scaled(counts: dict[int, int], scale: int = SCALE) -> tuple[list[int], list[int]]:
    """Frequencies of at least 1 with the sum 2**scale; what rounding leaves over goes to the most frequent."""
    if not counts:
        return [], []
    symbols, total, room = sorted(counts), sum(counts.values()), (1 << scale) - len(counts)
    if room < 0:
        raise ValueError(f"{len(counts)} symbols need a larger scale than {scale}")
    freq = [1 + counts[s] * room // total for s in symbols]
    freq[max(range(len(symbols)), key=lambda i: (freq[i], -i))] += (1 << scale) - sum(freq)
    return symbols, freq


class Table:
    def __init__(self, symbols, freq, scale: int = SCALE) -> None:
        self.scale, self.symbols, self.freq = scale, np.array(symbols, np.uint32), np.array(freq, np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.index = np.full(int(self.symbols.max(initial=0)) + 1, -1, np.int32)
        self.index[self.symbols] = np.arange(len(symbols))
        self.slot = np.repeat(np.arange(len(symbols), dtype=np.uint16 if len(symbols) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[tuple[int, int, bytes]]]:
        """Final states, words and checkpoints. The last lanes of an incomplete last step stay as they are."""
        k = np.uint64(self.scale)
        at = self.index[ids]
        x = np.full(LANES, LOW, np.uint64)
        steps = -(-len(ids) // LANES)
        out: list[np.ndarray] = []
        marks, written_words = [], 0
        for t in range(steps - 1, -1, -1):
            row = at[t * LANES : (t + 1) * LANES]
            n = len(row)
            f, c, y = self.freq[row], self.start[row], x[:n]
            full = y >= (f << (np.uint64(63) - k))
            if full.any():
                out.append(low := (y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written_words += len(low)
                y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[:n] = (q << k) + (y - q * f) + c
            if t % STEPS == 0 and t:
                marks.append((t, written_words, x.astype("<u8").tobytes()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        return x.astype("<u8").tobytes(), words.tobytes(), [(t, len(words) - w, s) for t, w, s in marks[::-1]]

    def decode(self, n: int, states: bytes, words: bytes, step: int = 0, word: int = 0, until: int | None = None) -> np.ndarray:
        """Ids from step (0, or a checkpoint's with its word and states) to until, or to the end."""
        k, x = np.uint64(self.scale), np.frombuffer(states, "<u8").astype(np.uint64)
        mask, stream, at = np.uint64((1 << self.scale) - 1), np.frombuffer(words, "<u4"), word
        end = -(-n // LANES) if until is None else until
        out = np.empty(max(0, min(n, end * LANES) - step * LANES), np.uint32)
        for t in range(step, end):
            m = min(LANES, n - t * LANES)
            y = x[:m]
            low = y & mask
            s = self.slot[low]
            out[(t - step) * LANES : (t - step) * LANES + m] = s
            y = self.freq[s] * (y >> k) + low - self.start[s]
            need = y < LOW
            r = int(np.count_nonzero(need))
            if r:
                y[need] = (y[need] << np.uint64(32)) | stream[at : at + r]
                at += r
            x[:m] = y
        return self.symbols[out]

    def decode_block(self, n: int, states: bytes, words: bytes, marks: list[tuple[int, int, bytes]]) -> np.ndarray:
        """All ids, from the start and all checkpoints at once: the stretches between checkpoints are worked off side by
        side, each with its own states and place in the words."""
        starts = [(0, 0, states), *marks]
        steps, whole = marks[0][0] if marks else -(-n // LANES), n // LANES
        k, mask, stream = np.uint64(self.scale), np.uint64((1 << self.scale) - 1), np.frombuffer(words, "<u4")
        x = np.stack([np.frombuffer(s, "<u8") for _, _, s in starts]).astype(np.uint64)
        at = [w for _, w, _ in starts]
        out = np.empty((len(starts), steps, LANES), self.slot.dtype)
        for t in range(steps):
            rows = len(starts) if starts[-1][0] + t < whole else len(starts) - 1  # only the last stretch may be shorter
            if not rows:
                break
            y = x[:rows]
            low = y & mask
            out[:rows, t] = s = self.slot[low]
            y = self.freq[s] * (y >> k) + low - self.start[s]
            need = y < LOW
            count = np.count_nonzero(need, axis=1).tolist()
            y[need] = (y[need] << np.uint64(32)) | np.concatenate([stream[a : a + r] for a, r in zip(at, count, strict=False)])
            at[:rows] = [a + r for a, r in zip(at, count, strict=False)]
            x[:rows] = y
        rest = n - whole * LANES
        if rest:
            out[-1, whole - starts[-1][0], :rest] = self.slot[x[-1, :rest] & mask]
        return self.symbols[out.reshape(-1)[:n]]


def _table(symbols: bytes, freq: bytes) -> Table:
    return resident(("table", symbols, freq), lambda: Table(np.frombuffer(symbols, "<u4"), np.frombuffer(freq, "<u8")))


def _packed(pairs: tuple) -> tuple[bytes, bytes]:
    return np.array(pairs[0], "<u4").tobytes(), np.array(pairs[1], "<u8").tobytes()


def count_symbols(tokens: DataFrame) -> dict[int, int]:
    """Occurrences of every id in all rows, from the counts of the partitions; bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                n = np.frombuffer(raw, np.int64)
                total = n + total if len(total) else n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["symbol", "n"])

    rows = tokens.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    return {r.symbol: r.n for r in rows}


def write_blocks(tokens: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes the rows of tokenize(), a written table, in ascending order of doc_id; rows of one doc_id in the
    order in which they lie in tokens. Extra: nothing is dropped, an empty table gives an empty folder."""
    spark, width = tokens.sparkSession, id_width(tokens)
    symbols, freq = scaled(count_symbols(tokens))
    spark.createDataFrame(list(zip(symbols, freq, strict=True)), "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    keys = _packed((symbols, freq))
    order = ["doc_id", "part", "row"]
    dealt = tokens.select(*order, "ids").repartitionByRange(parts or shuffle_parts(spark), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    schema = arrow(spark.createDataFrame([], BLOCKS).schema)

    def run(batches):
        t, part, block, first = _table(*keys), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close():
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            states, words, marks = t.encode(ids) if len(ids) else (b"", b"", [])
            row = [part, block, first, len(ids), docs, [len(x) // width for x in held], states, words, [{"step": a, "word": b, "states": c} for a, b, c in marks], zlib.crc32(ids.astype("<u4").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                held.append(raw)
                size += len(raw) // width
                if size >= BLOCK:
                    yield close()
                    block, first, docs, held, size = block + 1, first + size, [], [], 0
        if docs:
            yield close()

    dealt.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it in the whole file), n_tokens, ids_crc32 for each document, decoded from the
    blocks; with_ids adds the ids as little-endian 32-bit bytes. A block whose checksum differs is an error."""
    prepare(spark)
    table = spark.read.parquet(f"{path}/table").orderBy("symbol").collect()  # bounded by the vocabulary
    keys = _packed(([r.symbol for r in table], [r.freq for r in table]))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one for each part
    base, bases = 0, []
    for p, n in sums:
        bases.append((p, base))
        base += n
    starts = spark.createDataFrame(bases, "part int, base long")

    def run(batches):
        t = _table(*keys)
        for b in batches:
            for r in b.to_pylist():
                marks = [(m["step"], m["word"], m["states"]) for m in r["checkpoints"]]
                ids = t.decode_block(r["n_tokens"], r["states"], r["words"], marks) if r["n_tokens"] else np.zeros(0, np.uint32)
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
                n = np.array(r["doc_tokens"], np.int64)
                at = np.cumsum(n) - n
                whole = [raw[4 * a : 4 * (a + m)] for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(at + r["first"] + r["base"]), pa.array(n), pa.array([zlib.crc32(x) for x in whole], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(whole, pa.binary())] * with_ids], ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return blocks.join(F.broadcast(starts), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> str:
    """Tokenizes whole texts (null: empty), ends each with end_id and writes the file format; its path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "rans")
    tokens = written(tokenize(docs, tokenizer, end_id), "ids")
    write_blocks(tokens, path)
    drop(tokens)
    return path
