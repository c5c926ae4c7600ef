"""A corpus pipeline: five stages, each one operator of cohortforge.llm over all its predecessor kept.

Rows that repeat have one fate each by their own texts and ids; other columns, whatever
their names, pass through all stages but the last, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortforge.llm import decontaminate, quality, sentencepiece_codec, simhash, suffix_dedup
from cohortforge.llm.shared import materialise, release, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of these, does not reject.

    A null or empty text is judged by the zero vector; a row without an id is judged by its text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels, F.lit(True)))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that of the smallest doc_id.

    Null and empty texts are one group; rows that repeat the smallest doc_id all stay, and so does a row without one.
    """
    return simhash.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings of 100 bytes that started earlier.

    No row goes: null texts become empty, rows that repeat an id and its text are one
    document, and a row without an id is compared with none.
    """
    return suffix_dedup.strip_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, rows without an id are judged by their texts."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of the documents that are left, a row for each; null and empty texts have no ids."""
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding", encoding_stage),
]

#: Models and hashes of these stages are not to be had in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what a stage wrote on the way goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            kept.append(materialise(stage(spark, docs, sf_dir)))
        release(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
