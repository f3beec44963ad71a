"""A training corpus from raw documents: five stages, each written as Parquet before the next reads it.

Null, empty and repeated rows, and rows without an identifier, pass through every stage as its docstring says; an
empty table gives no rows; texts are read whole. Columns of any other name come along and clash with nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from segno.llm import decontaminate, exact_dedup, langid, packing, simhash
from segno.llm.common import shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject.

    Null and empty texts and those without a letter go, as do longer ones in no learned language. Repeated rows
    stay or go together. Where no row has a language, only the former go.
    """
    return langid.drop_unknown_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest doc_id, null ranking below all.

    Null equals empty. Of rows that repeat text and identifier one stays.
    """
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id.

    A row without an identifier stays only where its whole group has none. Rows that repeat an identifier are
    judged by their own texts.
    """
    return simhash.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate.

    The text alone decides, so rows that share an identifier, or have none, are judged apart. Items without an
    identifier count like others.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 4096 tokens; a null text is packed as an empty one."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("packing", packed),
]

#: SQL expresses neither the fingerprints nor the tokenizer; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
