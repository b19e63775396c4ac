"""The corpus pipeline: stages over documents, each written as a table and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import drop, fold, table, written
from lodestar.llm.langid import learn as learn_languages
from lodestar.llm.langid import predict as predict_language
from lodestar.llm.packing import pack
from lodestar.llm.partenum import without_copies
from lodestar.llm.toxicity import learn as learn_toxicity
from lodestar.llm.toxicity import score as score_toxicity
from lodestar.llm.winnowing import contamination

#: Suffix of the columns that a stage adds and takes away again.
_OWN = "__stage"
#: Bits for each byte of a text in its cheapest language above which, and beyond so many bits more, it is in none: texts of
#: a learned language cost 2 to 5, letters by chance 11, other languages 6 to 16.
FOREIGN, LEEWAY = 6.0, 64.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Those without text or letters, and those that cost so many bits in every
    language as letters by chance or other languages do, are rejected; where no language can be learned, all are."""
    samples = learn_languages(docs.where(F.coalesce(fold("doc_id", 4), F.lit(0)) != 2))
    out = predict_language(docs, samples, keep=True, suffix=_OWN)
    known = F.col("level" + _OWN) <= FOREIGN + LEEWAY / F.greatest(F.octet_length("text"), F.lit(1))
    return out.where((F.col("lang_pred" + _OWN) != "und") & known).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    learned = learn_toxicity(docs.where(fold("doc_id", 4) != 2), table(sf_dir, "labels", spark))
    out = score_toxicity(docs, learned, threshold=0.3, keep=True, suffix=_OWN)
    return out.where(F.col("predicted" + _OWN) == 0).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id, of rows alike in id and text one. An id may name
    several texts; documents without words stay."""
    return without_copies(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    out = contamination(docs, table(sf_dir, "benchmark", spark), suffix=_OWN)
    return out.where(F.col("n_hit" + _OWN) == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    import public_tokenizers

    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), end_id=1, seq_len=2048)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the last one's rows."""
    docs, before = table(sf_dir, "documents", spark), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs


#: Model scores, library tokenizers and similarity joins have no SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
