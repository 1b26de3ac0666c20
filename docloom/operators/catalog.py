"""What a store of chunks holds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(chunks: DataFrame) -> DataFrame:
    """One row: documents (distinct filenames) and chunks."""
    return chunks.agg(F.count_distinct("filename").alias("total_documents"), F.count("*").alias("total_chunks"))


def filenames(chunks: DataFrame) -> DataFrame:
    return chunks.select("filename").distinct()
