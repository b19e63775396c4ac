"""Rows in a global order without a single task: ranges, places in them, and prefix sums over the ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lazily_kept(df: DataFrame) -> DataFrame:
    """As a table in the checkpoint folder, which is written in one job and takes less room than a checkpoint; cached where
    no folder is set."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.cache()
    path = f"{folder}/lodestar-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Worked out now, and kept."""
    out = lazily_kept(df)
    out.count()
    return out


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """With _part and _at: ranges of the order, and the place in each from 1. It is kept, as another reading could cut
    the ranges elsewhere; equal rows of the order lie in one range."""
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(*names).withColumn("_part", F.spark_partition_id())
    at = F.row_number().over(W.partitionBy("_part").orderBy(*names)).cast("bigint")
    return lazily_kept(dealt.withColumn("_at", at).drop(*names))


def carried(df: DataFrame, before: list[tuple[int, int]]) -> DataFrame:
    """With _before: a number for each part."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before bigint")), "_part")


def places(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """With `name`: the place of each row in the order, from 1: places in ranges and a prefix sum over the ranges, whose
    sizes are all that reaches the driver."""
    d, before, n = ordered(df, *order), [], 0
    for r in d.groupBy("_part").count().orderBy("_part").collect():
        before.append((r["_part"], n))
        n += r["count"]
    return carried(d, before).withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
