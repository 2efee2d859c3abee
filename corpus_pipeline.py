"""A training corpus from raw documents, in stages.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written as
Parquet and read again as the next one's documents. All but the last keep the columns of
the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from areashift.llm.decontaminate import drop_leaks
from areashift.llm.exact_dedup import drop_copies
from areashift.llm.mixing import mix_sources
from areashift.llm.ngram_join import Similarity, drop_near_copies
from areashift.llm.storage import prepared, stored
from areashift.llm.toxicity import drop_toxic, train
from areashift.session import free_scratch, scratch_made


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, fitted on the labels of the tables."""
    prepared(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, five words and a similarity of 0.8, the smallest doc_id."""
    return drop_near_copies(docs, Similarity(n=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepared(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken, repeats counted."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifier cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables.

    What a stage wrote on its way goes when its result is stored, and that result when the
    next one is.
    """
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        before = set(scratch_made())
        docs = stored(stage(spark, docs, sf_dir), name)
        *made, result = [p for p in scratch_made() if p not in before]
        free_scratch(spark, [*made, *([last] if last else [])])
        last = result
    return STAGES[-1][1](spark, docs, sf_dir)
