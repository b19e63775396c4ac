"""Ranked lexical search over a clustered index of all documents.

Documents are dealt to shards by a tree of graph bisections of a sample and, in each shard, put in order by recursive
graph bisection (bisection.py). Runs of CLUSTER documents in that order are clusters: a row with the terms of its
documents, each term's highest impact and number of documents, its postings, and the ids that the places stand for. A query's
bound for a cluster is the sum of its terms' weights times their highest impacts. The most promising clusters of all
are searched first and give each query a score to beat; after that every task goes through its clusters by falling
bound and stops where no document can be among the best any more. All numbers are integers, so bounds and scores
are exact; equal scores are told apart by id, and a cluster whose bound is equal to the score to beat is left out only if its
ids are all larger.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.bisection import Graph, Routes, frequent, reorder
from lodestar.llm.common import new_path, prepare
from lodestar.llm.wordhash import ALPHANUMERIC, Words, bytes_of, groups

CLUSTER = 256
#: Stands for a null id; it comes after all others.
NO_ID = (1 << 63) - 1
#: Postings of a shard, and documents of the sample, at about. A shard has REPEATS times as many words at about.
SHARD, SAMPLE, REPEATS = 500_000, 4000, 4
#: Cuts of the sample, and the fewest documents of it in a leaf.
DEPTH, LEAF = 5, 32
GROUP = 1 << 20
#: Clusters that each query searches before the rest.
FIRST = 4
INDEX = "shard long, cluster int, lowest long, ids binary, terms binary, df binary, top binary, places binary, impacts binary"


def postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of texts: document, term hash and frequency of each posting, by document and term; and the words of
    each document."""
    data, offsets = bytes_of(column)
    docs, terms, often, n = [], [], [], []
    for lo, hi in groups(offsets, GROUP):
        w = Words(data, offsets[lo : hi + 1], ALPHANUMERIC)
        n.append(w.counts)
        doc = w.text_of()
        order = np.lexsort((w.hash, doc))
        d, h = doc[order], w.hash[order]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(d) else np.zeros(0, np.int64)
        docs.append(d[first] + lo)
        terms.append(h[first])
        often.append(np.diff(np.append(first, len(d))))
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return join(docs, np.int64), join(terms, np.uint64), join(often, np.int64), join(n, np.int64)


@dataclass
class Index:
    """Where the clusters are, N documents with a term and L terms of all documents."""

    clusters: DataFrame
    n_docs: int
    n_terms: int


def _routes(docs: DataFrame, total: int, id_col: str, text_col: str, sample: int) -> Routes:
    """From about `sample` documents, told by a hash of their ids."""
    step = max(1, total // sample)
    texts = docs.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0).select(F.col(text_col).cast("string")).limit(2 * sample).collect()
    doc, term, _, _ = postings(pa.array([r[0] for r in texts], pa.string()))
    names, number = np.unique(term, return_inverse=True)
    many = np.bincount(number, minlength=len(names)) > 1
    g: Graph = frequent(number, doc, len(texts), len(names))
    depth = max(0, min(DEPTH, int(math.log2(max(1, len(texts) / LEAF)))))
    return Routes(g, names[many], depth)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))


def _cluster_rows(shard: int, ids: np.ndarray, column: pa.Array, n_docs: int, n_terms: int, size: int) -> list[dict]:
    doc, term, tf, n = postings(column)
    names, number = np.unique(term, return_inverse=True)
    order = reorder(frequent(number, doc, len(ids), len(names)), size)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    value = impacts(tf, n[doc], n_docs, n_terms)
    by = np.lexsort((place[doc], number, place[doc] // size))
    at, number, value = place[doc][by], number[by], value[by]
    edge = np.searchsorted(at // size, np.arange(-(-len(ids) // size) + 1))
    out = []
    for c in range(len(edge) - 1):
        a, b = edge[c], edge[c + 1]
        mine = ids[order[c * size : (c + 1) * size]]
        first = np.flatnonzero(np.diff(number[a:b], prepend=-1))
        top = np.maximum.reduceat(value[a:b], first) if len(first) else value[:0]
        blobs = {"ids": mine.astype("<i8"), "terms": names[number[a:b][first]].astype("<u8"), "df": np.diff(np.append(first, b - a)).astype("<u4"), "top": top.astype("<u4"), "places": (at[a:b] - c * size).astype("<u2"), "impacts": value[a:b].astype("<u4")}
        out.append({"shard": shard, "cluster": c, "lowest": int(mine.min()), **{k: v.tobytes() for k, v in blobs.items()}})
    return out


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, sample: int = SAMPLE, cluster: int = CLUSTER) -> Index:
    """The index of all rows of docs, written to the shared folder. The tree is fitted on a bounded sample; every leaf is cut
    into as many shards as its postings and words need, by a hash of id and text, so that neither a hot topic nor a group of copies
    makes a large one. Texts cross the cluster once. Null texts have no terms."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    routes = spark.sparkContext.broadcast(_routes(rows, rows.count(), "doc_id", "text", sample))

    def leaves(column):
        doc, term, _, n = postings(column)
        return routes.value.leaf(term, doc, len(n)), np.bincount(doc, minlength=len(n)), n

    def measure(batches):
        total = np.zeros((1 << routes.value.depth, 3), np.int64)
        for b in batches:
            leaf, size, n = leaves(b.column(0))
            for k, x in enumerate((size, n, n > 0)):
                total[:, k] += np.bincount(leaf, x, len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *(pa.array(total[:, k]) for k in range(3))], names=["leaf", "postings", "terms", "docs"])

    sums = "leaf long, postings long, terms long, docs long"
    found = rows.select("text").mapInArrow(measure, sums).groupBy("leaf").agg(*[F.sum(x).alias(x) for x in ("postings", "terms", "docs")]).collect()
    n_docs, n_terms = sum(r.docs for r in found), sum(r.terms for r in found)
    count = np.ones(1 << DEPTH, np.int64)
    for r in found:
        count[r.leaf] = max(1, -(-r.postings // shard), -(-r.terms // (REPEATS * shard)))
    base = np.cumsum(count) - count

    def deal(batches):
        for b in batches:
            leaf, *_ = leaves(b.column(1))
            salt = b.column(2).to_numpy(zero_copy_only=False) % count[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(base[leaf] + salt), b.column(0), b.column(1).cast(pa.string())], names=["shard", "doc_id", "text"])

    dealt = rows.withColumn("h", F.xxhash64("doc_id", "text")).mapInArrow(deal, "shard long, doc_id long, text string")

    def pack(table):
        ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        out = _cluster_rows(table.column("shard")[0].as_py(), ids[order], table.column("text").combine_chunks().take(pa.array(order)), n_docs, max(1, n_terms), cluster)
        return pa.Table.from_pylist(out, schema=pa.schema([("shard", pa.int64()), ("cluster", pa.int32()), ("lowest", pa.int64()), *((k, pa.binary()) for k in ("ids", "terms", "df", "top", "places", "impacts"))]))

    dealt.groupBy("shard").applyInArrow(pack, INDEX).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path := new_path(spark, "index"))
    return Index(spark.read.schema(INDEX).parquet(path), n_docs, n_terms)


@dataclass
class Queries:
    """A block of queries: the sorted terms of all, and for each query where its terms are and what they weigh."""

    vocabulary: np.ndarray
    at: np.ndarray
    edge: np.ndarray
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, texts: list[str | None]) -> Queries:
        doc, term, _, _ = postings(pa.array(texts, pa.string()))
        vocabulary, at = np.unique(term, return_inverse=True)
        return cls(vocabulary, at, np.searchsorted(doc, np.arange(len(texts) + 1)))

    def __len__(self) -> int:
        return len(self.edge) - 1

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words of the vocabulary are among the sorted terms, and where."""
        at = np.searchsorted(terms, self.vocabulary)
        at[at == len(terms)] = 0
        known = np.flatnonzero(terms[at] == self.vocabulary) if len(terms) else np.zeros(0, np.int64)
        return known, at[known]

    def bounds(self, terms: np.ndarray, top: np.ndarray) -> np.ndarray:
        """For each query, a score that no document of the cluster goes beyond."""
        best = np.zeros(len(self.vocabulary), np.int64)
        known, at = self.found(terms)
        best[known] = top[at]
        total = np.concatenate([[0], np.cumsum((self.weight * best)[self.at])])
        return total[self.edge[1:]] - total[self.edge[:-1]]

    def scores(self, q: int, matrix: np.ndarray, row: np.ndarray) -> np.ndarray:
        mine = self.at[self.edge[q] : self.edge[q + 1]]
        mine = mine[row[mine] >= 0]
        return self.weight[mine] @ matrix[row[mine]]


class Best:
    """The k best (score, id) of each query, and what a document must beat: a higher score, or as high with a smaller id."""

    def __init__(self, queries: Queries, k: int, score: np.ndarray, last: np.ndarray) -> None:
        self.queries, self.k, self.score, self.last = queries, k, score.copy(), last.copy()
        self.kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(queries)

    def hopeful(self, bound: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Pairs of cluster and query that may still hold one of the best."""
        return (bound > self.score) | ((bound == self.score) & (lowest[:, None] <= self.last))

    def visit(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero((scores > self.score[q]) | ((scores == self.score[q]) & (ids <= self.last[q])))
        if not len(good):
            return
        s, i = scores[good], ids[good]
        if self.kept[q] is not None:
            s, i = np.concatenate([self.kept[q][0], s]), np.concatenate([self.kept[q][1], i])
        order = np.lexsort((i, -s))[: self.k]
        self.kept[q] = s[order], i[order]
        if len(order) == self.k:
            self.score[q], self.last[q] = s[order[-1]], i[order[-1]]

    def search(self, clusters: list[dict[str, np.ndarray]], allowed: np.ndarray | None = None) -> None:
        """Each query goes through the clusters by falling bound, until none is hopeful. allowed: a mask of pairs."""
        bound = np.stack([self.queries.bounds(c["terms"], c["top"]) for c in clusters])
        lowest = np.array([c["ids"].min() for c in clusters])
        hopeful = self.hopeful(bound, lowest)
        if allowed is not None:
            hopeful &= allowed
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in np.flatnonzero(hopeful.any(0)).tolist():
            mine = np.flatnonzero(hopeful[:, q])
            for c in mine[np.argsort(-bound[mine, q], kind="stable")].tolist():
                if bound[c, q] < self.score[q]:
                    break
                if bound[c, q] == self.score[q] and lowest[c] > self.last[q]:
                    continue
                if c not in made:
                    made[c] = self._matrix(clusters[c])
                self.visit(q, self.queries.scores(q, *made[c]), clusters[c]["ids"])

    def _matrix(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Impacts of the vocabulary's words in each document of a cluster, and each word's row."""
        known, at = self.queries.found(c["terms"])
        start = np.cumsum(c["df"], dtype=np.int64) - c["df"]
        n = c["df"][at].astype(np.int64)
        from_ = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        matrix = np.zeros((len(known), len(c["ids"])), np.int64)
        matrix[np.repeat(np.arange(len(known)), n), c["places"][from_]] = c["impacts"][from_]
        row = np.full(len(self.queries.vocabulary), -1)
        row[known] = np.arange(len(known))
        return matrix, row


_TYPES = {"ids": "<i8", "terms": "<u8", "df": "<u4", "top": "<u4", "places": "<u2", "impacts": "<u4"}


def _clusters(b: pa.RecordBatch) -> list[dict[str, np.ndarray]]:
    columns = {k: b.column(k) for k in _TYPES if k in b.schema.names}
    return [{k: np.frombuffer(v[i].as_buffer() or b"", _TYPES[k]) for k, v in columns.items()} for i in range(b.num_rows)]


def _batches(batches, bytes_at_once: int = 1 << 26):
    """Smaller ones, where rows are large."""
    for b in batches:
        n = max(1, b.num_rows * bytes_at_once // max(1, b.nbytes))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def _searched(clusters: DataFrame, shared, k: int, pairs=None) -> DataFrame:
    """q, doc_id and score of documents that may be among the best k, k for each query and task at most. pairs: the queries of
    each (shard, cluster), where not all are asked."""

    def run(batches):
        queries, score, last = shared.value
        best = Best(queries, k, score, last)
        for b in _batches(batches):
            allowed = None
            if pairs is not None:
                allowed = np.zeros((b.num_rows, len(queries)), bool)
                for i, key in enumerate(zip(b.column("shard").to_pylist(), b.column("cluster").to_pylist(), strict=True)):
                    allowed[i, pairs.value.get(key, [])] = True
            best.search(_clusters(b), allowed)
        for q, kept in enumerate(best.kept):
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept[0]), q)), pa.array(kept[1]), pa.array(kept[0])], names=["q", "doc_id", "score"])

    return clusters.mapInArrow(run, "q long, doc_id long, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("q").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_block(index: Index, texts: list[str | None], k: int) -> DataFrame:
    """q (the place in texts), rank, doc_id and score: the best k documents of each query of a block."""
    spark, clusters = index.clusters.sparkSession, index.clusters
    queries = Queries.of(texts)

    def frequencies(batches):
        total = np.zeros(len(shared.value.vocabulary), np.int64)
        for b in _batches(batches):
            for c in _clusters(b):
                known, at = shared.value.found(c["terms"])
                total[known] += c["df"][at]
        known = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total[known])], names=["term", "df"])

    shared = spark.sparkContext.broadcast(queries)
    weight = np.zeros(len(queries.vocabulary), np.int64)
    for r in clusters.select("terms", "df").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weight[r.term] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1)))
    queries.weight = weight
    nothing = np.zeros(len(queries), np.int64), np.full(len(queries), -1, np.int64)  # scores must be above 0
    weighed = spark.sparkContext.broadcast((queries, *nothing))

    def promising(batches):
        queries = weighed.value[0]
        held = [np.zeros((0, len(queries)), np.int64), np.zeros((0, len(queries)), np.int64), np.zeros((0, len(queries)), np.int64)]
        for b in _batches(batches):
            bound = np.stack([queries.bounds(c["terms"], c["top"]) for c in _clusters(b)])
            names = [np.broadcast_to(b.column(x).to_numpy()[:, None], bound.shape) for x in ("shard", "cluster")]
            held = [np.concatenate([x, y]) for x, y in zip(held, (bound, *names), strict=True)]
            order = np.argsort(-held[0], axis=0, kind="stable")[:FIRST]
            held = [np.take_along_axis(x, order, 0) for x in held]
        some = held[0] > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[1]), *(pa.array(x[some].astype(np.int64)) for x in held)], names=["q", "bound", "shard", "cluster"])

    first = clusters.select("shard", "cluster", "terms", "top").mapInArrow(promising, "q long, bound long, shard long, cluster long")
    w = W.partitionBy("q").orderBy(F.col("bound").desc(), "shard", "cluster")
    pairs: dict[tuple[int, int], list[int]] = {}
    for r in first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FIRST).collect():  # FIRST for each query
        pairs.setdefault((r.shard, r.cluster), []).append(r.q)
    if not pairs:
        return spark.createDataFrame([], "q long, rank int, doc_id long, score long")
    score, last = nothing
    named = spark.createDataFrame(list(pairs), "shard long, cluster int")
    some = clusters.join(F.broadcast(named), ["shard", "cluster"], "left_semi").select(*clusters.columns)
    ahead = _top(_searched(some, weighed, k, spark.sparkContext.broadcast(pairs)), k)
    for r in ahead.where(F.col("rank") == k).collect():
        score[r.q], last[r.q] = r.score, r.doc_id
    return _top(_searched(clusters, spark.sparkContext.broadcast((queries, score, last)), k), k).select("q", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 50, block: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id and score for each row of queries, which is a stated query set: it is worked off in blocks of at
    most `block` characters (a longer query is alone), so what is broadcast is bounded. Null and empty queries find
    nothing, nor do rows without terms; repeated queries are answered each, and repeated rows are found each."""
    spark, out = queries.sparkSession, None
    kind = queries.schema[id_col].dataType.simpleString()

    def answer(items):
        found = search_block(index, [t for _, t in items], k)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"q long, item_id {kind}")
        doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        return found.join(F.broadcast(names), "q").select("item_id", "rank", doc, "score")

    held, n = [], 0
    for r in queries.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        if held and n + len(r[1] or "") > block:
            part = answer(held)
            out, held, n = part if out is None else out.unionByName(part), [], 0
        held.append((r[0], r[1]))
        n += len(r[1] or "")
    part = answer(held) if held else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return part if out is None else out.unionByName(part)
