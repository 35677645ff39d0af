"""Readers and writers of corpora, topics, judgments, query sheets and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CORPUS = "docid string, title string, text string"
#: Forms of the annotation sheets: three annotators' Roman spellings, the original, code-mixed and English.
SHEET = "row string, qid string, devanagari string, roman string, code_mixed string, english string"


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """qid, text of lines `qid<TAB>text`; blank lines are skipped."""
    cut = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("f"))
    return cut.select(F.get("f", F.lit(0)).alias("qid"), F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, docid, rel of lines with four fields; of repeated pairs the last line counts."""
    # Lines of one file are numbered in their order; of several files the last by name counts.
    cut = spark.read.text(path).select(F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("n"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("f")).where(F.size("f") == 4)
    rows = cut.select("n", F.col("f")[0].alias("qid"), F.col("f")[2].alias("docid"), F.col("f")[3].cast("int").alias("rel"))
    return rows.groupBy("qid", "docid").agg(F.max_by("rel", "n").alias("rel"))


def relevant_docs(qrels: DataFrame) -> DataFrame:
    return qrels.where("rel > 0").select("qid", "docid")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """docid, title, text from JSON lines, packed or not."""
    return spark.read.schema(CORPUS).json(path)


def scan_corpus(spark: SparkSession, path: str, keep: Column) -> tuple[int, DataFrame]:
    """The number of documents, packed or not, and those that a condition keeps. One pass counts; the rows are a plan."""
    rows = read_corpus(spark, path)
    return rows.count(), rows.where(keep)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, text of a TSV with a header; rows whose text is blank or SKIP go."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="qid string, text string", quote="")
    return rows.where("text is not null and trim(text) <> '' and trim(text) <> 'SKIP'")


def write_queries(queries: DataFrame, path: str) -> None:
    queries.select("qid", "text").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_forms(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """form, qid, text of one file for each form."""
    out = None
    for form, path in paths.items():
        one = read_queries(spark, path).select(F.lit(form).alias("form"), "qid", "text")
        out = one if out is None else out.unionByName(one)
    return out


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Columns of an annotation sheet; short rows are padded with ""."""
    return spark.read.csv(path, sep="\t", header=True, schema=SHEET, quote="").na.fill("")


def sample_queries(queries: DataFrame, n: int, seed: str) -> DataFrame:
    """n queries by the order of a hash, the same on every run, numbered from 1 by qid."""
    drawn = queries.orderBy(F.md5(F.concat(F.lit(seed), F.col("qid").cast("string"))), "qid").limit(n)
    return drawn.select(F.row_number().over(W.orderBy("qid")).cast("string").alias("row"), F.col("qid").cast("string").alias("qid"), "text")  # n rows


def blank_sheet(sample: DataFrame) -> DataFrame:
    """sample: row, qid, text. An annotation sheet with the texts, to be filled in."""
    return sample.select("row", "qid", F.col("text").alias("devanagari"), *(F.lit("").alias(c) for c in ("roman", "code_mixed", "english")))


def usable(text):
    return (F.trim(text) != "") & (F.upper(F.trim(text)) != "SKIP")


def human_forms(sheets: list[DataFrame]) -> DataFrame:
    """form, qid, text: F1, H-R1.., H-CM and H-EN of the sheets; unusable texts go; no form at all if only F1 is left."""
    out = None
    for i, s in enumerate(sheets, 1):
        rows = s.select("qid", F.expr(f"stack(4, 'F1', devanagari, 'H-R{i}', roman, 'H-CM', code_mixed, 'H-EN', english) as (form, text)"))
        out = rows if out is None else out.unionByName(rows)
    out = out.where(usable(F.col("text"))).groupBy("form", "qid").agg(F.min("text").alias("text"))
    any_other = out.where("form <> 'F1'").select(F.lit(1).alias("one")).limit(1)
    return out.crossJoin(any_other).drop("one")


def write_rows(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_runs(runs: DataFrame, path: str) -> None:
    """Runs and per-query metrics, by system and form."""
    runs.write.mode("overwrite").partitionBy(*[c for c in ("system", "form") if c in runs.columns]).parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """doc_id, v as floats; a failed task is simply run again."""
    vectors.select("doc_id", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, v of written vectors."""
    return spark.read.parquet(path).select("doc_id", F.col("v").cast("array<double>").alias("v"))
