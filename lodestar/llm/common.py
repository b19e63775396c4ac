"""What the operators share: folders that every executor sees, Arrow helpers, words and folds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-cases A-Z only.
LOWER = {i: i + 32 for i in range(65, 91)}
#: The same word pattern for Java and DuckDB expressions.
SPACE_SQL = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: whole texts are in it twice while it is worked on.
BATCH = 2500
#: What Python workers run with: large arrays go back to the system when they are freed.
_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 22), "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> None:
    """Lets Python workers on the driver's machine import this package. On a cluster ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    of = spark.sparkContext.environment
    paths = of.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        of["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)
    for k, v in _MEMORY.items():
        of.setdefault(k, v)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests on one machine, a new local folder."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_lodestar_dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, own, True)
        at = sc._lodestar_dir = "file://" + own
        sc.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by written()."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._lodestar_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer referenced; a second round finds what the first let go."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


_RESIDENT: dict = {}


def resident(key, make):
    """What a Python worker keeps from task to task, made at its first use. Workers are shared by all stages of a
    session, so there is one such thing at a time; another one takes its place."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def release() -> None:
    """Frees what a Python worker has kept, at the start of tasks that need their memory for something else."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # gives freed memory back to the system, where there is such a call


def fold(col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
