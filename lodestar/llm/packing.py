"""Packing: concatenate and cut.

Pass one writes the token ids of each partition with a running sum inside the partition. The totals of
the partitions, one number each, become global offsets by a prefix sum. Pass two places every document
at (offset of its partition + running sum) and cuts it at the fixed window boundaries. Nothing is
shuffled: the only row count that reaches the driver is the number of partitions.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import written
from lodestar.llm.encoding import id_width, tokenize

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def partition_bases(tokens: DataFrame) -> DataFrame:
    """(part, base): the ids in all partitions before. One row for each partition that has rows."""
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.max(F.col("ahead") + F.col("n_tokens")).alias("n")).collect())
    bases = [0, *accumulate(n for _, n in totals)]
    return tokens.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, bases, strict=False)], "part int, base long")


def pack_tokens(tokens: DataFrame, seq_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of the rows that tokenize() wrote; tokens must be a written table, so that its rows and places
    are the same at each reading. Every sequence but the last is full, so none but the last is ever padded.
    with_ids adds the piece's ids as bytes. Repeated rows and equal ids give pieces of their own."""
    width = id_width(tokens)
    placed = tokens.join(F.broadcast(partition_bases(tokens)), "part").select("doc_id", (F.col("base") + F.col("ahead")).alias("at"), "ids")

    def run(batches):
        for b in batches:
            rows: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = len(raw) // width
                ids = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                start = 0
                while start < n:
                    seq, off = divmod(at + start, seq_len)
                    m = min(n - start, seq_len - off)
                    piece = ids[4 * start : 4 * (start + m)]
                    for to, x in zip(rows, (doc, start, m, zlib.crc32(piece), n, seq, off, bytes(piece))[: 7 + with_ids], strict=True):
                        to.append(x)
                    start += m
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == "ids" else pa.int64()) for k, x in zip(names, rows, strict=True)], names)

    return placed.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, end_id: int = 1, seq_len: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenizes whole texts (null: empty), ends each with end_id, and packs them all. An empty table gives no pieces."""
    return pack_tokens(written(tokenize(docs, path, end_id), "pack"), seq_len, with_ids)
