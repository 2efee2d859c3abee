"""One query per operator of this package, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areashift.llm.conversation_repair import damaged_and_repaired
from areashift.llm.decontaminate import LEAKS_SQL, find_leaks
from areashift.llm.exact_dedup import grace_dedup
from areashift.llm.fill_middle import MIDDLE_SQL, fill_in_middle, with_restored
from areashift.llm.html_extract import extract_main_text
from areashift.llm.mixing import MIX_SQL, mix_sources
from areashift.llm.ngram_join import near_duplicates
from areashift.llm.pii import find_personal_data
from areashift.llm.storage import prepared
from areashift.llm.suffix_dedup import suffix_dedup
from areashift.llm.substring_dedup import substring_dedup
from areashift.llm.toxicity import score_toxicity, train
from areashift.llm.vector_join import VECTORS_SQL, near_vectors
from areashift.llm.warc import WARC_SQL, archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "question_overlap", "answer_overlap")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_restored(fill_in_middle(table(spark, sf_dir, "documents")))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this module by name."""
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    """The same results as SQL for DuckDB over views of the tables."""
    return {
        "op1_warc": WARC_SQL,
        "op2_decontaminate": LEAKS_SQL,
        "op6_mix_sources": MIX_SQL.replace("{docs}", "documents"),
        "op10_exact_dedup": DEDUP_SQL,
        "op11_fill_middle": MIDDLE_SQL,
        "op12_vector_join": VECTORS_SQL,
    }
