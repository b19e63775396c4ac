"""Exact duplicates by a heavy-hitter split, in DataFrame functions only.

The texts are read once, into a narrow table of digests. Misra-Gries counters, merged over all tasks, name every
digest that more than `support` of the rows have (and some that are rarer). These candidates are counted exactly with
sums in each task, and what proves to be repeated is broadcast: rows of large groups get their result where they are
and never go through a shuffle. The other digests, none of which has more than that share, are shuffled as usual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import written

_BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text (null: empty) without ASCII white space."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), _BLANKS, F.coalesce(text.cast("string"), F.lit("")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars of the original, text_sha256 of the normalised text, and a number of the row, as a written table."""
    text = F.col(text_col)
    n = F.coalesce(F.length(text.cast("string")), F.lit(0)).cast("long")
    return written(docs.select(F.col(id_col).alias("doc_id"), n.alias("n_chars"), F.sha2(normalised(text), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")


def _first() -> Column:
    """What stays: most characters, then the smallest id (null after all others), then the first of repeated rows."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")


def heavy_hitters(rows: DataFrame, support: float) -> DataFrame:
    """text_sha256, group_size and best of digests that are repeated: all that more than `support` of the rows have, 1 / support
    rows at most. The counters hold 64-bit hashes of digests; the counts are of whole digests."""
    h = F.xxhash64("text_sha256").alias("h")
    candidates = rows.select(h).stat.freqItems(["h"], support).select(F.explode("h_freqItems").alias("h"))
    some = rows.withColumn("h", h).join(F.broadcast(candidates), "h", "left_semi")
    counts = some.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(_first()).alias("best"))
    return written(counts.where("group_size > 1"), "heavy")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of docs. Of rows whose texts are equal but for ASCII
    white space one is kept, as told by _first(). A null text is empty, and empty texts and those of white space are one
    group. Of repeated rows one at most is kept; an empty table gives no rows; other columns are not read. support: the
    share of rows from which a group is sure to be broadcast, 0.0001 at least; it changes no result."""
    rows = digests(docs, id_col, text_col)
    heavy = heavy_hitters(rows, support)
    w = W.partitionBy("text_sha256")
    light = rows.join(F.broadcast(heavy), "text_sha256", "left_anti").select("*", F.count("*").over(w).alias("group_size"), F.min(_first()).over(w).alias("best"))
    both = rows.join(F.broadcast(heavy), "text_sha256").unionByName(light)
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
