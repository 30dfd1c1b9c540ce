"""From raw documents to packed training sequences, in five stages.

Each stage is a function ``(spark, docs, folder) -> DataFrame``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``. ``folder`` holds the
other tables. Stages handle null and empty texts, repeated rows and empty tables as their operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.storage import staged
from gridwright.llm import decontamination, near_dedup, packing, quality_classifier, secret_scan
from gridwright.llm.common import spare, table
from gridwright.llm.queries import GOOD, fitted_classifier, public_tokens, test_items


def classify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the compression classifier, learned from the labelled ones among them, does not reject."""
    model = fitted_classifier(docs, table(spark, folder, "labels"))
    return quality_classifier.reject(docs, model, GOOD)


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal or near-equal ones."""
    return near_dedup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, test_items(spark, folder), name="item_id", question="question", answer="answer")


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew where the text has changed."""
    before = spare(docs, "text_before_")
    masked = secret_scan.mask(docs.withColumn(before, F.col("text")), ranks=secret_scan.word_ranks(docs))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    return masked.withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).drop(before)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The tokens of all documents, packed into sequences."""
    return packing.pack(docs, public_tokens)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]
#: Compression, sampled draws and byte-pair tokens have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
