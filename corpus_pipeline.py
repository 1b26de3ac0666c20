"""A corpus pipeline of five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import drop, shared_dir, table, temporary
from docloom.llm.lines import without_repeated_lines
from docloom.llm.packing import FILE, NAMED, pack_documents
from docloom.llm.quality import keep_good
from docloom.llm.simhash import keep_first_of_group
from docloom.llm.suffix import without_repeated_passages
from docloom.llm.vocab import vocabulary_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; the others are cut out of their documents."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_first_of_group(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document before has too are cut out."""
    return without_repeated_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences, with the ids."""
    return pack_documents(docs, vocabulary_file(FILE), vocabulary_file(NAMED), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("packing", packing),
]

#: SQL expresses neither MinHash components nor packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; stages lie in the shared folder, and go when the next one is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/docloom/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop(spark, f"{folder}/{k - 1}")
    return docs
