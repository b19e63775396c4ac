"""N-Triples as they arrive: parsed rows and running degrees. An extension; a batch reads the same lines the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.ntriples import parse_edges, parse_star


def read_stream(spark: SparkSession, folder: str, dialect: str = "star", files_per_trigger: int = 100) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return {"star": parse_star, "edges": parse_edges}[dialect](lines)


def running_degrees(stream: DataFrame) -> DataFrame:
    """Triples of each subject so far; write it in update mode."""
    return stream.groupBy("s").agg(F.count("*").alias("n_triples"))
