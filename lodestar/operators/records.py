"""Query records as JSON files: readers, writers, cleaning, combination, statistics."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "query string, triples array<array<string>>, x array<string>, y bigint, source_subject string, star_size bigint, query_hash string, "
    "predicates_used array<string>, instantiated_objects array<string>, object_instantiation_pattern array<bigint>, n_objects_instantiated bigint"
)
#: The shapes whose folders are cleaned.
CLEANED_SHAPES = ("cycle", "diamond", "flower", "snowflake", "binary_tree", "path_star_ends")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files that hold an array each; `path` may be a pattern. A file with anything else than records
    gives none of its rows. Each row has its file's name."""
    df = spark.read.option("multiLine", True).schema(RECORD + ", _corrupt_record string").json(os.path.expanduser(path))
    ok = F.col("_corrupt_record").isNull() & (F.col("query").isNotNull() | F.col("triples").isNotNull() | F.col("y").isNotNull() | F.col("x").isNotNull())
    return df.withColumn("file", F.col("_metadata.file_path")).where(ok).drop("_corrupt_record")


def write_json(df: DataFrame, path: str) -> int:
    """One JSON array, indented, through a temporary file and a rename. For results of bounded size: rows come to the
    driver one partition at a time. Returns the number of rows."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(f"{path}.part", "w") as f:
        f.write("[")
        for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator(prefetchPartitions=True):
            text = json.dumps(json.loads(r.j), indent=2, ensure_ascii=False)
            f.write(("," if n else "") + "\n  " + text.replace("\n", "\n  "))
            n += 1
        f.write("\n]\n" if n else "]\n")
    os.replace(f"{path}.part", path)
    return n


def output_name(dataset: str, kind: str, n: int, method: str | None = None, final: bool = False, at: float | None = None) -> str:
    """{dataset}_{kind}_{time}_{n}[_method][_final].json; n is the triples of each query."""
    stamp = time.strftime("%Y-%m-%d_%H-%M-%S", time.localtime(at))
    return "_".join([dataset, kind, stamp, str(n), *([method] if method else []), *(["final"] if final else [])]) + ".json"


def clean(df: DataFrame) -> DataFrame:
    """Without records whose count failed, which is -1. A missing count stays."""
    return df.where(~F.col("y").eqNullSafe(F.lit(-1)))


def nonempty(df: DataFrame) -> DataFrame:
    return df.where("y > 0")


def clean_folders(spark: SparkSession, root: str) -> dict[str, tuple[int, int]]:
    """<root>/*_<shape>_queries/raw/queries.json of the six shapes, rewritten in place where something goes: rows before
    and after by file."""
    import glob

    out = {}
    for path in sorted(glob.glob(os.path.join(os.path.expanduser(root), "*_queries", "raw", "queries.json"))):
        folder = path.split(os.sep)[-3]
        if not any(f"_{s}_queries" in folder for s in CLEANED_SHAPES):
            continue
        with open(path) as f:
            rows = json.load(f)
        kept = [r for r in rows if r.get("y") != -1]  # the file is one JSON value and is rewritten whole
        if len(kept) < len(rows):
            with open(f"{path}.part", "w") as f:
                json.dump(kept, f, indent=2)
            os.replace(f"{path}.part", path)
        out[path] = (len(rows), len(kept))
    return out


def combine(spark: SparkSession, pattern: str, output: str = "") -> tuple[DataFrame, str]:
    """Valid records of all files; written to output, or where that is empty to combined_queries_{time}.json."""
    df = clean(read_records(spark, pattern)).drop("file")
    path = output or f"combined_queries_{time.strftime('%Y-%m-%d_%H-%M-%S')}.json"
    path = os.path.join(os.getcwd(), os.path.expanduser(path))
    write_json(df, path)
    return df, path


def statistics(df: DataFrame) -> DataFrame:
    """Count, and least and greatest size, bound objects and counts; what is missing is 0."""
    size = F.coalesce(F.size("triples"), F.lit(0))
    size = F.when(size < 0, 0).otherwise(size)
    bound, y = F.coalesce("n_objects_instantiated", F.lit(0)), F.coalesce("y", F.lit(0))
    return df.agg(F.count("*").alias("n_queries"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.min(bound).alias("min_bound"), F.max(bound).alias("max_bound"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))
