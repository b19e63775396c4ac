"""N-Triples text to triples (s, p, o, o_kind), with the graph cache.

o_kind is iri, literal or bnode. IRIs carry no angle brackets in s and p; o is kept as written in the star dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.ranges import kept
from lodestar.sources.store import even, exists, source_key

#: The line formats of the two dialects.
STAR_LINE = r"^(<[^>]+>)\s+(<[^>]+>)\s+(.+?)\s*\.$"
EDGE_LINE = r"^<([^>]+)>\s+<([^>]+)>\s+<([^>]+)>\s*\.\s*$"

TRIPLES = "s string, p string, o string, o_kind string"


def o_kind(o: Column) -> Column:
    return F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, gzip too; the column is `value`. A gzip file is one task, so its lines are dealt out."""
    lines = spark.read.text(path)
    return lines.repartition("value") if path.endswith(".gz") else lines


def parse_star(lines: DataFrame) -> DataFrame:
    """Any object. White space around a line, blank lines, comments and lines of other forms are left out; lines with
    blank-node subjects are of another form. A fourth term stays in the object. Repeated lines stay."""
    t = F.regexp_replace("value", r"^\s+|\s+$", "")
    part = lambda i: F.regexp_extract(t, STAR_LINE, i)
    ok = lines.where(t.rlike(STAR_LINE) & ~t.startswith("#"))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    return ok.select(part(1).alias("a"), part(2).alias("b"), part(3).alias("o")).select(inner("a").alias("s"), inner("b").alias("p"), "o", o_kind(F.col("o")).alias("o_kind"))


def parse_edges(lines: DataFrame) -> DataFrame:
    """IRI objects only; lines must start with the subject. The object has no angle brackets."""
    part = lambda i: F.regexp_extract("value", EDGE_LINE, i)
    return lines.where(F.col("value").rlike(EDGE_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), F.lit("iri").alias("o_kind"))


def to_lines(triples: DataFrame) -> DataFrame:
    """Triples (s, p, o, o_is_iri) as N-Triples lines."""
    o = F.when(F.col("o_is_iri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.col("o"))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def cached_graph(spark: SparkSession, path: str, folder: str, dialect: str = "star", use_cache: bool = True) -> DataFrame:
    """The parsed graph as a table in ranges of predicate, subject and object. Its key has the sources' sizes and times, so
    that a changed source is parsed anew; a table without its success mark is written again."""
    table = f"{folder}/graph-{source_key(spark, [path])}-{dialect}"
    if not (use_cache and exists(spark, f"{table}/_SUCCESS")):
        rows = kept({"star": parse_star, "edges": parse_edges}[dialect](read_lines(spark, path)))
        even(rows, rows.count(), "p", "s", "o").write.mode("overwrite").parquet(table)
    return spark.read.schema(TRIPLES).parquet(table).select("s", "p", "o", "o_kind")
