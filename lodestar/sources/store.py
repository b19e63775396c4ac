"""A graph as a store: terms as dense numbers, edges in two orders, in files of even size.

Terms are numbered in their own order from 1, so numbers compare as terms do. Edges are dealt out in ranges of
(predicate, subject, object) and sorted in them, and once more of (predicate, object, subject): a pattern reads the row
groups of its predicate and constants, and neither a predicate nor a node with most of the edges makes a large file.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.ranges import kept, places

#: Rows of a file at most, and where there are fewer files than cores, at least.
MOST, LEAST = 2_000_000, 100_000


@dataclass(frozen=True)
class Graph:
    """edges: s, p, o, further columns, and the numbers si, pi, oi; terms: term, i; predicates: p, pi. backward: pi, oi, si,
    or None for a graph that isn't written."""

    edges: DataFrame
    terms: DataFrame
    predicates: DataFrame
    backward: DataFrame | None = None

    def numbered(self, df: DataFrame, term: str, to: str) -> DataFrame:
        """df with the number of the term in a column; null where no edge can have it."""
        return df.join(self.terms.select(F.col("term").alias(term), F.col("i").alias(to)), term, "left")


def source_key(spark: SparkSession, paths: Iterable[str]) -> str:
    """Changes when a file at one of the paths (globs too) does: names, sizes and times. FileNotFoundError if one is missing."""
    import hashlib

    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    seen = []
    for path in paths:
        at = hadoop.Path(path)
        fs = at.getFileSystem(conf)
        found = fs.globStatus(at) or []
        if not found:
            raise FileNotFoundError(path)
        for one in found:
            files = fs.listFiles(one.getPath(), True)
            while files.hasNext():
                f = files.next()
                seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("|".join(sorted(seen)).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def even(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """In ranges of the order, one for each file, sorted in each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(-(-rows // MOST), min(cores, -(-rows // LEAST)), 1)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def coded(triples: DataFrame) -> Graph:
    """The graph of a set of triples, kept but not written."""
    triples = kept(triples)
    terms = places(triples.select(F.col("s").alias("term")).union(triples.select("o")).distinct(), "i", F.col("term"))
    predicates = places(triples.select("p").distinct(), "pi", F.col("p"))
    edges = triples.join(predicates, "p").join(terms.select(F.col("term").alias("s"), F.col("i").alias("si")), "s").join(terms.select(F.col("term").alias("o"), F.col("i").alias("oi")), "o")
    return Graph(edges.select(*triples.columns, "si", "pi", "oi"), terms, predicates)


def write(triples: DataFrame, folder: str) -> None:
    """Writes the graph of a set of triples; done, a part at a time, so a folder with all four marks is whole."""
    g = coded(triples)
    edges = kept(g.edges)
    rows = edges.count()
    g.predicates.write.mode("overwrite").parquet(f"{folder}/predicates")
    even(g.terms, g.terms.count(), "term").write.mode("overwrite").parquet(f"{folder}/terms")
    even(edges.select("pi", "oi", "si"), rows, "pi", "oi", "si").write.mode("overwrite").parquet(f"{folder}/backward")
    even(edges, rows, "p", "s", "o").write.mode("overwrite").parquet(f"{folder}/edges")


def is_whole(spark: SparkSession, folder: str) -> bool:
    return all(exists(spark, f"{folder}/{x}/_SUCCESS") for x in ("predicates", "terms", "backward", "edges"))


def read(spark: SparkSession, folder: str, further: str = "") -> Graph:
    """further: the type of the other columns, such as `o_is_iri boolean`."""
    edges = spark.read.schema("s string, p string, o string, " + (f"{further}, " if further else "") + "si long, pi long, oi long").parquet(f"{folder}/edges")
    return Graph(edges, spark.read.schema("term string, i long").parquet(f"{folder}/terms"), spark.read.schema("p string, pi long").parquet(f"{folder}/predicates"), spark.read.schema("pi long, oi long, si long").parquet(f"{folder}/backward"))
