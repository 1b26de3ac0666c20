"""What several operators share: tables in the shared folder, whitespace, row packing."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words.
WHITE = " \t\n\x0b\x0c\r"
OWN_DIR = "/tmp/checkpoints/docloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is set, one of our own in local mode, as in tests, and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/") if named else OWN_DIR


#: Paths of the tables that were stored, newest last.
_STORED: list[str] = []


@contextmanager
def temporary(spark: SparkSession):
    """Tables that are stored inside go at the end; for steps that write their result there."""
    first = len(_STORED)
    try:
        yield
    finally:
        for path in _STORED[first:]:
            drop(spark, path)
        del _STORED[first:]


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark's own switch that drops a query's shuffle files when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives the loss of executors, is read by several branches.

    The shuffle files that made it aren't needed any more and go at once. The table stays until its folder is cleared, as
    results are read from it later; steps inside temporary() leave none.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/docloom/{what}-{uuid.uuid4().hex}", spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to every task if it has at most `rows` rows, else to be joined by key. df should be cheap to read, as a stored table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(docs: DataFrame, *wanted: str) -> DataFrame:
    """The columns wanted beside `_row`, a struct of all columns, so that no name of docs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *wanted)


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Deals the rows out evenly if df has fewer partitions than the cluster has cores; small inputs only."""
    n = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
