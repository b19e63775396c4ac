"""Documents drawn so that their n-grams are distributed like those of a target corpus.

Features are runs of one to three words, hashed into buckets by CRC-32, which is composed from the words' CRCs
(crc_algebra.py). Buckets of the whole corpus and of the whole target are counted; a document's weight is the sum of its
features' log ratios, and Gumbel noise on top makes the highest scores a draw without replacement. Each pass goes over
whole texts; sums are one row for each bucket, and ranks come from a sort in ranges with prefix sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import prepare, shuffle_parts, written
from lodestar.llm.crc_algebra import run_crcs, word_crcs
from lodestar.llm.wordhash import ALPHANUMERIC, bytes_of, groups

BUCKETS, WORDS = 10_000, 3
#: Bytes of texts that are worked on at once; a longer text is alone and is taken in pieces.
GROUP = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and the text that it is of; data is bytes from offsets[0] on."""
    inside = ALPHANUMERIC[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(offsets))
    a, b = offsets[filled] - offsets[0], offsets[filled + 1] - offsets[0] - 1
    first[a], last[b] = inside[a], inside[b]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.searchsorted(offsets[1:] - offsets[0], start, "right")


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """Buckets of all features and their texts, for a few texts at a time. A text of more than GROUP bytes comes in
    pieces that end between words; the two last words of a piece begin the next one, for the runs across."""
    for lo, hi in groups(offsets, GROUP):
        a, end, keep = int(offsets[lo]), int(offsets[hi]), None
        while a < end:
            b = end if hi - lo > 1 else min(a + GROUP, end)
            while b < end and ALPHANUMERIC[data[b - 1]] and ALPHANUMERIC[data[b]]:
                step = np.flatnonzero(~ALPHANUMERIC[data[b : min(b + 4096, end)]])
                b = b + int(step[0]) if len(step) else min(b + 4096, end)
            low = _LOWER[data[a:b]]
            start, length, text = spans(low, offsets[lo : hi + 1] if hi - lo > 1 else np.array([a, b]))
            crc, old = word_crcs(low, start, length), 0
            if keep is not None:
                old = len(keep[0])
                crc, length, text = np.concatenate([keep[0], crc]), np.concatenate([keep[1], length]), np.concatenate([np.zeros(old, np.int64), text])
            found, of = [], []
            for k, (c, at) in enumerate(run_crcs(crc, length, text, WORDS)):
                new = at + k >= old  # runs that end in the words before are counted already
                found.append(c[new] % BUCKETS)
                of.append(text[at[new]] + lo)
            yield np.concatenate(found).astype(np.int64), np.concatenate(of), len(found[0]), hi - lo == 1
            keep, a = (crc[-(WORDS - 1) :], length[-(WORDS - 1) :]), b


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """The features of a whole table in each bucket. Each task sends its own sums, one row for each bucket at most."""
    prepare(texts.sparkSession)
    column = texts.select(F.col(text_col).cast("string").alias("t"))

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for found, *_ in _pieces(*bytes_of(b.column(0))):
                total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    out = np.zeros(BUCKETS, np.int64)
    for r in column.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    top, low = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * top / ((s + 1) * low))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(gain)
    schema = "doc_id long, n_words long, n_features long, weight long"

    def run(batches):
        gain = shared.value
        for b in batches:
            m = b.num_rows
            words, features, weight = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            for found, of, n_words, _ in _pieces(*bytes_of(b.column(1))):
                words += np.bincount(of[:n_words], minlength=m)
                features += np.bincount(of, minlength=m)
                order = np.argsort(of, kind="stable")
                total = np.concatenate([[0], np.cumsum(gain[found[order]])])
                edge = np.searchsorted(of[order], np.arange(m + 1))
                weight += total[edge[1:]] - total[edge[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """rows with rank, 1 to n, by falling score, then doc_id (null last), then row; null beyond n. Rows are dealt out in
    ranges of that order and numbered in each; the sizes of the ranges are what reaches the driver."""
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)

    def number(batches):
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            at = pa.array(np.arange(done + 1, done + b.num_rows + 1))
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), at], names=[*b.schema.names, "part", "at"])

    numbered = written(dealt.mapInArrow(number, "doc_id long, n_features long, weight long, score long, row long, part int, at long"), "ranges")
    before, total = [], 0
    for r in sorted(numbered.groupBy("part").count().collect()):
        before.append((r["part"], total))
        total += r["count"]
    where = spark.createDataFrame(before, "part int, before long")
    rank = F.col("before") + F.col("at")
    return numbered.join(F.broadcast(where), "part").withColumn("rank", F.when(rank <= n, rank))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) for each row of docs. Null and empty texts have no
    features and weight 0. A null id hashes as the empty text and comes after all others; repeated rows are
    documents of their own, in the order of the table; an empty target pulls every bucket alike; an empty table gives
    no rows. Other columns are not read, whatever their names."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = weighed(docs, gain, id_col, text_col).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "weights")
    enough = F.col("n_words") >= min_words
    n = percent * rows.where(enough).count() // 100
    columns = ["doc_id", "n_features", "weight", "score", "row"]
    drawn = _ranked(rows.where(enough).select(*columns), n)
    rest = rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*names).unionByName(rest.select(*names))
