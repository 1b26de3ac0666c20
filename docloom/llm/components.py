"""Connected components of a graph that is as large as the corpus: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (src, dst: long, either order, repeats and loops allowed) -> (node, component), component = smallest node reachable.

    Each round is two minimum-per-node aggregations (combined before the shuffle) and two joins on the node, which
    adaptive execution splits if a node is hot; no neighbour list is ever gathered. The round's edges are written to
    the shared folder. Rounds grow with the logarithm of the longest path. No edges: no rows; null ends are ignored.
    """
    e = (
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").cast("long").alias("a"), F.least("src", "dst").cast("long").alias("b"))
        .distinct()
    )
    e, before = stored(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now
        e = stored(_small_star(_large_star(e)), "edges")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
