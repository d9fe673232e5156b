"""Corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``:

1. quality rules: rejected documents go, failing lines leave the text;
2. toxicity: documents scored 0.7 or more go (labels are read from ``sf_dir``);
3. near-duplicates: of each group of linked documents the one with the smallest id stays;
4. repeated passages: words covered by a 20-word window that also starts earlier leave the text;
5. packing: the documents' token ids placed in sequences of 2048.

Null texts are empty texts, so the first stage rejects them; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import minhash, packing, quality, substrings, toxicity
from lodestar.llm.common import staged, table
from lodestar.llm.queries import WORD_VOCABULARY
from lodestar.llm.tokens import vocabulary_path
from lodestar.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return substrings.clean_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs, vocabulary_path(WORD_VOCABULARY))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxic_documents), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("best_fit_packing", best_fit_packing)]

#: Trained models, minima and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
