"""Connected components of a table of links, by alternating large and small stars.

Each round is a written table, so lost executors cost at most that round. Nothing but row counts and a
checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop, written


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): links has longs a and b; each node of a link gets the smallest node that it reaches.
    Links of a node with itself, repeated links and nulls are left out; no links give no rows."""
    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(e)
    while state[0]:
        new = written(_small(_large(e)), "links")
        drop(e)
        e, before, state = new, state, _state(new)
        if state == before:
            break
    # Every node but the smallest now has its component as its only neighbour.
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", F.col("b").alias("component")).distinct())
