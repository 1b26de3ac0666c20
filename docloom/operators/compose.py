"""Context, answers and confidence from search hits (query_id, rank, content, score)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import informative_lines, ordered_join, preview


def hits(found: DataFrame) -> DataFrame:
    """Search hits as (query_id, rank, content, score, metadata)."""
    return found.select("query_id", "rank", "content", F.col("similarity").alias("score"), "metadata")


def rag_context(found: DataFrame, label: str = "Source") -> DataFrame:
    """(query_id, context): a numbered block with a score of two digits for each hit, joined by blank lines."""
    block = F.format_string(f"[{label} %d, relevance: %.2f]\n%s", F.col("rank"), F.col("score"), F.col("content"))
    return found.groupBy("query_id").agg(ordered_join(F.col("rank"), block, "\n\n").alias("context"))


def answer_context(found: DataFrame, label: str = "Source") -> DataFrame:
    """(query_id, context): a labelled block for each hit, each followed by a blank line."""
    block = F.format_string(f"{label} %d:\n%s\n\n", F.col("rank"), F.col("content"))
    return found.groupBy("query_id").agg(ordered_join(F.col("rank"), block, "").alias("context"))


def search_listing(queries: DataFrame, found: DataFrame, header: str = "Results for '%s':", none: str = "Nothing found.") -> DataFrame:
    """queries (query_id, query) -> (query_id, listing): contents with scores of three digits, or `none`."""
    block = F.format_string("%d. %s\n(relevance: %.3f)", F.col("rank"), F.col("content"), F.col("score"))
    body = found.groupBy("query_id").agg(ordered_join(F.col("rank"), block, "\n\n").alias("_b"))
    listing = F.when(F.col("_b").isNull(), F.lit(none)).otherwise(F.concat(F.format_string(header, F.col("query")), F.lit("\n\n"), F.col("_b")))
    return queries.join(body, "query_id", "left").select("query_id", listing.alias("listing"))


def confidence(queries: DataFrame, found: DataFrame, factor: float = 1.2) -> DataFrame:
    """(query_id, confidence): the mean score times factor, 1 at most; 0 without hits."""
    mean = found.groupBy("query_id").agg(F.avg("score").alias("_m"))
    return queries.select("query_id").join(mean, "query_id", "left").select("query_id", F.when(F.col("_m").isNull(), 0.0).otherwise(F.least(F.col("_m") * factor, F.lit(1.0))).alias("confidence"))


def extractive_answer(context: Column, header: str, footer: str) -> Column:
    """header, the first four lines of over twenty characters as bullets, footer."""
    return F.concat(F.lit(header), F.array_join(F.transform(informative_lines(context), lambda x: F.concat(F.lit("• "), x)), "\n"), F.lit(footer))


def answers(queries: DataFrame, found: DataFrame, header: str, footer: str, none: str) -> DataFrame:
    """(query_id, answer, sources, confidence): the whole answer without a language model."""
    sources = F.array_sort(F.collect_list(F.struct("rank", preview(F.col("content")).alias("content"), "score")))
    told = found.groupBy("query_id").agg(F.transform(sources, lambda s: F.struct(s.content.alias("content"), s.score.alias("score"))).alias("sources"))
    rows = queries.select("query_id").join(answer_context(found), "query_id", "left").join(told, "query_id", "left").join(confidence(queries, found), "query_id")
    answer = F.when(F.col("context").isNull(), F.lit(none)).otherwise(extractive_answer(F.col("context"), header, footer))
    return rows.select("query_id", answer.alias("answer"), F.coalesce("sources", F.array().cast("array<struct<content:string,score:double>>")).alias("sources"), "confidence")


def switched_context(queries: DataFrame, found: DataFrame, on: Column, label: str = "Source") -> DataFrame:
    """queries (query_id, ...) -> (query_id, context): the context where the knowledge base is switched `on` and has hits, else ''."""
    rows = queries.select("query_id", F.coalesce(on, F.lit(False)).alias("_on")).join(rag_context(found, label), "query_id", "left")
    return rows.select("query_id", F.when(F.col("_on"), F.coalesce("context", F.lit(""))).otherwise(F.lit("")).alias("context"))
