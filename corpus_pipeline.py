"""A training-corpus pipeline: each stage takes (spark, docs, sf_dir), and its result, written and read again, is the
next one's docs. All stages but the last keep the columns of documents.

Cases, at every stage: an empty table gives an empty table, and extra columns pass unchanged up to the packing. NULL, empty and
blank texts are depleted at the first stage and go there. Rows with the same id are all edited and scored alike; the near-copy
stage keeps one of them. Documents without id stay (they can't be named as a copy) and are packed with a NULL id. Very long
texts are processed whole. Ties go to the smallest id, and equal rows are chosen together by the mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import line_frequency, mixing, near_duplicates, packing, toxicity
from millrace.llm._shared import discard, tables, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that recur across a host's documents; depleted documents go."""
    return line_frequency.drop_frequent_lines(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among docs, finds toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, score=None)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_duplicates.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to the target weights; a document stands as often as the mixture repeats it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that hold the documents' pieces."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near duplicates", near_copies), ("mixing", mixture), ("packing", packed)]
#: The classifier, the fingerprints, the token counts and the packing have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; a stage's tables go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        used = tables() - before
        docs = written(out, name.replace(" ", "-"))
        discard(used)
    return docs
