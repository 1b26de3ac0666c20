"""Prompts, history windows, request payloads and counters over tables of messages (conv_id, turn, role, text)."""

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Earlier messages that go to the model; messages that the two simple bots keep.
SENT, KEPT_BASIC, KEPT_ADVANCED = 10, 20, 40
TEMPERATURE, MAX_TOKENS_RAG, MAX_TOKENS, TOP_P = 0.7, 2000, 2048, 0.9


def prompt_lookup(rows: DataFrame, prompts: DataFrame, key: str, default: str) -> DataFrame:
    """rows with `name` and `prompt` of their key; an unknown or null key gets the default's. prompts: (key, name, prompt), a short table."""
    p = prompts.select(F.col("key").alias("_k"), "name", "prompt")
    d = p.where(F.col("_k") == default).select(F.col("name").alias("_dn"), F.col("prompt").alias("_dp"))
    found = rows.join(p, F.col(key) == F.col("_k"), "left").join(d, F.lit(True), "left")
    return found.select(*rows.columns, F.coalesce("name", "_dn").alias("name"), F.coalesce("prompt", "_dp").alias("prompt"))


def prompt_change(rows: DataFrame, prompts: DataFrame, asked: str, current: str) -> DataFrame:
    """rows with `accepted` and `active`: the key asked for if it is known, else the current one."""
    p = prompts.select(F.col("key").alias("_k"))
    ok = F.col("_k").isNotNull()
    return rows.join(p, F.col(asked) == F.col("_k"), "left").select(*rows.columns, ok.alias("accepted"), F.when(ok, F.col(asked)).otherwise(F.col(current)).alias("active"))


def list_prompts(prompts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """prompts (key, name, prompt) -> (key, name, uses): the listing, with how many of rows use each."""
    uses = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("uses"))
    return prompts.join(uses, F.col("key") == F.col("_k"), "left").select("key", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


def with_context(prompt: Column, context: Column, heading: str = "Context:") -> Column:
    """The system prompt, with the context under a heading if there is any."""
    some = F.coalesce(context, F.lit(""))
    return F.when(some != "", F.concat(prompt, F.lit(f"\n\n{heading}\n"), some)).otherwise(prompt)


def earlier(key: str, order: list[str], message: Column, n: int = SENT) -> Column:
    """The n messages before each one, oldest first."""
    return F.collect_list(message).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-n, -1))


def with_earlier(rows: DataFrame, key: str, order: list[str], message: Column, cut: Column, n: int = SENT, out: str = "earlier") -> DataFrame:
    """rows with the n messages before each one, oldest first, as `earlier` gives them, where a key may hold any share of the rows.

    cut: a row's range, as a day or a thousand turns, that must not decrease along `order`; null ranges come first. A key's rows
    are dealt out by their ranges, and each range gets what it needs from the ranges before it: the last n messages of each of the
    n ranges before. Only those, n a range at most, meet by key. Rows that tie in `order` come in any order.
    """
    rows = rows.withColumns({"_cut": cut, "_message": F.struct(message.alias("m"))})
    own = Window.partitionBy(key, "_cut")
    ends = rows.withColumn("_back", F.row_number().over(own.orderBy(*[F.desc_nulls_last(c) for c in order]))).where(F.col("_back") <= n)
    ends = ends.groupBy(key, "_cut").agg(F.reverse(F.array_sort(F.collect_list(F.struct("_back", "_message")))).alias("_ends"))
    ranges = Window.partitionBy(key).orderBy(F.asc_nulls_first("_cut")).rowsBetween(-n, -1)
    ends = ends.withColumn("_before", F.flatten(F.collect_list(F.transform("_ends", lambda e: e["_message"])).over(ranges)))
    ends = ends.select(F.col(key).alias("_key"), F.col("_cut").alias("_of"), F.when(F.size("_before") > n, F.slice("_before", -n, n)).otherwise(F.col("_before")).alias("_before"))
    rows = rows.withColumn("_own", F.collect_list("_message").over(own.orderBy(*order).rowsBetween(-n, -1)))
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_cut").eqNullSafe(F.col("_of")))
    both = F.concat("_before", "_own")
    last = F.when(F.size(both) > n, F.slice(both, -n, n)).otherwise(both)
    # collect_list leaves nulls out, so messages are wrapped; null messages are left out here, as `earlier` does.
    return rows.withColumn(out, F.filter(F.transform(last, lambda x: x.m), lambda m: m.isNotNull())).drop("_cut", "_message", "_own", "_key", "_of", "_before")


def newest(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Each key's n newest rows; tasks drop older ones before the shuffle."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def since_clear(rows: DataFrame, key: str, order: str, text: str, command: str = "/clear") -> DataFrame:
    """Rows after their key's last clear command."""
    last = rows.where(F.lower(F.trim(text)) == command).groupBy(key).agg(F.max(order).alias("_at"))
    return rows.join(last, key, "left").where(F.col("_at").isNull() | (F.col(order) > F.col("_at"))).drop("_at")


def messages(system: Column, history: Column, current: Column) -> Column:
    """System message if there is one, history, then the current message: array of (role, content)."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = F.when(system.isNotNull(), F.array(said("system", system))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(head, history, F.array(said("user", current)))


def payload(model: Column, said: Column, max_tokens: int = MAX_TOKENS_RAG, advanced: bool = False) -> Column:
    """The request body as JSON text."""
    more = [F.lit(TOP_P).alias("top_p"), F.lit(0.0).alias("frequency_penalty"), F.lit(0.0).alias("presence_penalty")] if advanced else []
    return F.to_json(F.struct(model.alias("model"), said.alias("messages"), F.lit(TEMPERATURE).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), *more, F.lit(False).alias("stream")))


def role_counts(rows: DataFrame) -> DataFrame:
    """(conv_id, total, user_messages, assistant_messages)"""
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages")
    )


def usage(rows: DataFrame, success: Column, tokens: Column, n_hits: Column) -> DataFrame:
    """One row of counters: answered messages, tokens (null: 0), retrievals with a hit."""
    return rows.agg(
        F.count_if(success).alias("total_messages"),
        F.coalesce(F.sum(F.when(success, F.coalesce(tokens, F.lit(0)))), F.lit(0)).alias("total_tokens"),
        F.count_if(n_hits > 0).alias("total_rag_queries"),
    )


def generate(rows: DataFrame, request: str, client: Callable[[str], str]) -> DataFrame:
    """rows with `answer` and `error`: client turns a request body into an answer and may raise; an error is kept apart from answers."""

    @F.pandas_udf("answer string, error string")
    def run(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for b in bodies:
            try:
                out.append((None if b is None else client(b), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["answer", "error"], dtype=object)

    return rows.withColumn("_g", run(F.col(request))).select("*", "_g.answer", "_g.error").drop("_g")


def turn_pair(rows: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Answered rows (keys, message, answer) -> their user and assistant rows (keys, part, role, text), to be appended to the log."""
    both = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("message").alias("text")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return rows.where("answer IS NOT NULL").select(*keys, F.inline(both))
