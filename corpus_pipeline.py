"""A corpus pipeline of five stages: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``, and whatever other columns there are.

Defined results: a null or empty text is judged by the classifier like any other; where it stays, all empty texts are one
group of exact copies. Of copies the longest text stays, then the smallest doc_id; of near copies the smallest doc_id. A
null doc_id is larger than any other there, and is neither held out nor looked up elsewhere. Repeated rows are copies, so
one stays. Texts of any length are read whole in every stage. An empty table goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataform.llm import bpe, decontaminate, exact_dedup, near_copies, quality
from strataform.llm.shared import drop, scratch, table, tidied, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) stays."""
    return near_copies.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents' ids as little-endian unsigned 32-bit integers."""
    return bpe.encode_documents(docs, *bpe.default_files()).select("doc_id", "n_tokens", "token_ids")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("decontaminate", drop_leaks), ("encode", encode)]

#: The classifier can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``: doc_id, n_tokens, token_ids.

    What a stage needed is deleted when its result is written, and that result when the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        at = scratch(spark, f"stage-{name}")
        with tidied(spark):
            docs = written(stage(spark, docs, sf_dir), name, at)
        drop(spark, *before)
        before = [at]
    return docs
