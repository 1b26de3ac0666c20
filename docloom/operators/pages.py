"""Histories as pages of bounded size: messages are numbered by ranges, so no key's rows are ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages on a page; turns that make a range of a conversation.
PAGE, RANGE = 256, 4096


def numbered(rows: DataFrame, key: str, order: list[str], cut: Column, after: DataFrame | None = None) -> DataFrame:
    """rows with `position` (long): their number from 1 within their key by `order`, nulls first.

    cut: a row's range, as an hour or some thousand turns, that must not decrease along `order`; null ranges come first. Rows are
    numbered within a range and the counts of the key's earlier ranges are added, so what meets in a task is one range's rows and one key's
    counts. Rows that tie in `order` are numbered in any order; a null key is a key. after: (key, _after), numbers to start behind.
    """
    # Fields of a struct are equal if both are null, so the rows keep one partitioning for their numbers and for the join.
    rows = rows.withColumn("_range", F.struct(F.col(key).alias("k"), cut.alias("c")))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_key", F.struct("_range.k"))
    earlier = Window.partitionBy("_key").orderBy(F.asc_nulls_first("_range.c")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", "_key", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if after is not None:
        start = after.select(F.struct(F.col(key).alias("k")).alias("_key"), "_after")
        before = before.join(start, "_key", "left").withColumn("_before", F.col("_before") + F.coalesce("_after", F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*[F.asc_nulls_first(c) for c in order]))
    found = rows.withColumn("_own", own).join(before.select("_range", "_before"), "_range")
    return found.withColumn("position", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def _gathered(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, position, _m) -> pages."""
    page = F.expr(f"(position - 1) DIV {size}")
    said = F.array_sort(F.collect_list(F.struct("position", "_m")))
    rows = rows.groupBy(key, page.alias("page")).agg(said.alias("_said"))
    return rows.select(key, "page", F.transform("_said", lambda x: x["_m"]).alias("messages"))


def paged(rows: DataFrame, key: str, order: list[str], message: Column, cut: Column, size: int = PAGE) -> DataFrame:
    """(key, page, messages): a key's messages in order, `size` on each page but the last, pages from 0 without a gap.

    Null messages keep their place; no rows give no page. cut as in `numbered`.
    """
    kept = rows.withColumn("_m", message)
    return _gathered(numbered(kept, key, order, cut).select(key, "position", "_m"), key, size)


def messages_of(pages: DataFrame, key: str, size: int = PAGE) -> DataFrame:
    """(key, position, message): pages as rows again, numbered from 1."""
    rows = pages.select(key, "page", F.posexplode("messages").alias("_at", "message"))
    return rows.select(key, (F.col("page") * size + F.col("_at") + 1).alias("position"), "message")


def appended(pages: DataFrame, rows: DataFrame, key: str, order: list[str], message: Column, cut: Column, size: int = PAGE) -> DataFrame:
    """The pages that change or come when rows follow what their keys' pages hold: each key's unfilled last page, and those behind it.

    Full pages are neither read for their messages nor written. All of rows come after all that is stored, in `order` among themselves.
    """
    own = F.struct(F.col(key).alias("k"))
    touched = rows.select(own.alias("_key")).distinct()
    ends = pages.groupBy(own.alias("_key")).agg(F.sum(F.size("messages")).alias("_after")).join(touched, "_key", "left_semi")
    new = numbered(rows.withColumn("_m", message), key, order, cut, ends.select(F.col("_key.k").alias(key), "_after")).select(key, "position", "_m")
    last = ends.select(F.struct("_key.k", F.expr(f"_after DIV {size}").alias("p")).alias("_place"))
    open_pages = pages.withColumn("_place", F.struct(F.col(key).alias("k"), F.col("page").alias("p"))).join(last, "_place", "left_semi")
    held = messages_of(open_pages, key, size).withColumnRenamed("message", "_m")
    return _gathered(held.unionByName(new), key, size)
