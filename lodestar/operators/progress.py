"""The passes of a run as tables in a folder that outlives the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.store import exists


class Progress:
    """A pass is done once its log entry is: rows are written first, then the entry, and Spark's output committer gives
    each its success mark last. What a killed driver left behind without an entry is written again. One run writes to
    a folder at a time; the folder belongs to one configuration and one state of its sources."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, n: int, what: str) -> str:
        return f"{self.folder}/pass-{n:05d}/{what}"

    def rows(self, n: int) -> DataFrame:
        return self.spark.read.parquet(self._at(n, "rows"))

    def write(self, df: DataFrame, n: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(n, "rows"))
        return self.rows(n)

    def commit(self, n: int, entry: dict) -> None:
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("overwrite").text(self._at(n, "entry"))

    def done(self) -> list[dict]:
        """The entries of the passes done, up to the first that isn't."""
        out: list[dict] = []
        while exists(self.spark, self._at(len(out), "entry") + "/_SUCCESS"):
            out.append(json.loads(self.spark.read.text(self._at(len(out), "entry")).first()[0]))
        return out
