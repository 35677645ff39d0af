"""From raw documents to token ids in five stages; each stage's rows are written as Parquet and read as the next one's documents.

Quality, repeated lines, near-duplicate documents, benchmark passages, BPE. All but the last return the columns of documents,
whatever they are named. Null and empty texts, ties, repeated rows and empty tables are handled as the operators state.
Each stage's docs must be written rows, as `run` hands them on: a stage begins by deleting the intermediate rows of the
stages before it. So one pipeline runs at a time in a process.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhani.llm import bpe, decontaminate, lines, minhash, quality
from lekhani.llm.common import settle, sweep, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier rejects go. It learns from all rows of labels."""
    sweep(docs)
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another line stands for go from the texts; n_chars follows."""
    sweep(docs)
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8."""
    sweep(docs)
    # The ids are written, so Spark knows their size and sends them to all tasks only if they are few enough by its own measure.
    copies = settle(minhash.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct())
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    sweep(docs)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the decoded text of every document that stayed."""
    sweep(docs)
    return bpe.encode_texts(docs, bpe.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: No SQL expresses a learnt classifier; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
