"""Cleaning pipeline over ``documents``: stages applied in order, each to all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet to the shared folder and read back as the next stage's ``docs``.  All but
the last return the columns of ``documents`` (extra columns pass through).

Defined results: rows with a NULL text fail the quality rules; rows with a NULL id
are judged by their content and never dropped as duplicates; repeated rows count as
copies of each other; an empty table stays empty through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import decontamination, packing, personal_data, quality_rules, simhash
from cohortlab.llm.common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_documents(docs, quality_rules.quality_rules(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return simhash.keep_first(docs, simhash.near_duplicates(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no n-gram of the benchmark."""
    return decontamination.remove_documents(decontamination.scan(docs, table(spark, sf_dir, "benchmark")))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; ``n_chars`` follows the text."""
    out = personal_data.mask(personal_data.find(docs, personal_data.fit_model(docs)))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: the stages hold fitted models and searches that SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
