"""From raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept. All but the last return the columns of documents.

Null and empty texts hold no language and go in the first stage. Rows that repeat
an id are judged alike where their texts are equal; rows without an id are never
copies of others and stay until they are packed. Empty tables pass through all
stages. Further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import jaccard_join, language_id, line_dedup, packing, substring_dedup
from keystrata.llm.common import persist, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found.

    A text without a letter goes, and so does a long one that is like no language
    learned. Where no document has a language, every one with a letter stays.
    """
    return language_id.keep_languages(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that equal or nearly equal an earlier line."""
    return line_dedup.line_dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group, and those in none.

    Rows that share an id are one document and stay together.
    """
    groups = jaccard_join.jaccard_groups(docs)
    return docs.join(groups.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document of smaller id has."""
    return substring_dedup.substring_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in its sequence."""
    return packing.op6_pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("substring_dedup", dedup_substrings),
    ("packing", pack),
]

#: No stage has a form in SQL that is feasible on whole tables; tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
