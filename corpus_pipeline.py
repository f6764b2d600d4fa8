"""A training corpus in five stages: language, near duplicates, benchmarks, personal data, packing.

Each stage is a function of (spark, documents, sf_dir).  All but the last
return the columns of documents.

Cases: a null doc_id is kept by the near-duplicate stage, as no decision can
name it, and judged by its text in the others; rows that share a doc_id but not
the text are all kept or all dropped with their group, and equal rows of one
doc_id and text stay once (the one with the least other columns); a null or
empty text is no language and goes in the first stage; an empty table gives an
empty result; columns with any other name are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.decontaminate import clean_documents
from ledgerlark.llm.language_id import keep_language
from ledgerlark.llm.ngram_join import jaccard_components
from ledgerlark.llm.packing import pack
from ledgerlark.llm.pii import redact
from ledgerlark.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is no language."""
    return keep_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies.

    What goes is a small part of the ids, so texts are shuffled only where even
    that is too much to send.
    """
    found = jaccard_components(docs).where("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select("doc_id")
    gone = Scratch(spark, "pipeline").save(gone, "gone")
    return once_each(docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti"), docs)


def once_each(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the kept rows of ``docs`` one for each doc_id and text: the one whose other columns come first as JSON.

    Only rows that repeat a doc_id are compared, by a hash of their text; rows
    without a doc_id all stay.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows_of_id")).where("rows_of_id > 1").select("doc_id")
    twice = Scratch(docs.sparkSession, "pipeline").save(twice, "twice")
    row = F.struct(*map(F.col, docs.columns))
    first = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("text_of_id")).agg(F.min_by(row, F.to_json(row)).alias("row_of_id"))
    return kept.join(twice, "doc_id", "left_anti").unionByName(first.select("row_of_id.*"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by benchmark items."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of personal data; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows of 1024 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmarks),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Models and a tokenizer take part: SQL can't state the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
