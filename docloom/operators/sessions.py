"""Sessions as a log of messages (session_id, seq, role, content, ts)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import PAGE, numbered, paged


def with_session(requests: DataFrame, apart: list[str] | None = None) -> DataFrame:
    """requests with a session id: the one they name, known or not, else a new one.

    apart: columns that tell requests apart, as an id or a time and a number; a new id is made of them, so a task that runs again
    gives the same one. Without them new ids are random, and the result should be stored before it is used twice.
    """
    new = F.concat(F.lit("new-"), F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in apart]), 256)) if apart else F.expr("uuid()")
    return requests.withColumn("session_id", F.coalesce("session_id", new))


def log_rows(replies: DataFrame) -> DataFrame:
    """replies (session_id, ts, message, answer, error) -> log rows: user and assistant on success, the error as assistant row alone otherwise."""
    row = lambda part, role, text: F.struct(F.lit(part).alias("part"), F.lit(role).alias("role"), text.alias("content"))
    good = F.array(row(0, "user", F.col("message")), row(1, "assistant", F.col("answer")))
    return replies.select("session_id", "ts", F.inline(F.when(F.col("error").isNull(), good).otherwise(F.array(row(1, "assistant", F.col("error"))))))


def active(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("session_id").alias("active_sessions"))


def history(log: DataFrame, n: int | None = None) -> DataFrame:
    """(session_id, created_at, message_count, messages): messages in order of ts and seq, with n only the newest n.

    Without n a session's messages are one row, as an API returns them; where sessions may grow without bound, give n, or take messages() or history_pages().
    """
    counts = log.groupBy("session_id").agg(F.min("ts").alias("created_at"), F.count("*").alias("message_count"))
    if n is not None:
        newest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq"))
        log = log.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    said = log.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "role", "content"))).alias("messages"))
    return counts.join(said, "session_id")


def messages(log: DataFrame) -> DataFrame:
    """(session_id, position, role, content, ts): a row for each message, numbered from 1 by ts and seq within its session.

    Numbers are counted by hours (`pages.numbered`), so a session of any length is never gathered. Rows without a session id are a
    session of their own, of a null id.
    """
    return numbered(log, "session_id", ["ts", "seq"], _hour()).select("session_id", "position", "role", "content", "ts")


def history_pages(log: DataFrame, size: int = PAGE) -> DataFrame:
    """(session_id, page, messages): as history, but on pages of `size` messages, so a session of any length is never one row."""
    return paged(log, "session_id", ["ts", "seq"], F.struct("ts", "seq", "role", "content"), _hour(), size)


def _hour() -> Column:
    return F.date_trunc("hour", F.col("ts").cast("timestamp"))


def lookup(log: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (session_id) with `status` 200 or 404 and the message count."""
    counts = log.groupBy("session_id").agg(F.count("*").alias("message_count"))
    found = asked.join(counts, "session_id", "left")
    return found.select("session_id", F.when(F.col("message_count").isNull(), 404).otherwise(200).alias("status"), F.coalesce("message_count", F.lit(0)).alias("message_count"))


def visits(log: DataFrame, idle: int = 1800) -> DataFrame:
    """(session_id, opened, last, message_count, user_messages): a session's stretches without more than `idle` seconds between messages.

    Stretches are found within a session's hours first, and those that touch are then joined, so a session of any length is never
    gathered: only its rows of one hour, and its stretches, meet in a task. Rows without a ts are left out; those without a session id
    are a session of their own, of a null id.
    """
    one, ts = F.lit(1).cast("long"), F.col("ts")
    by_user = F.coalesce((F.col("role") == "user").cast("long"), F.lit(0))
    rows = log.where("ts IS NOT NULL").select("session_id", F.date_trunc("hour", "ts").alias("_hour"), ts.alias("opened"), ts.alias("last"), one.alias("message_count"), by_user.alias("user_messages"))
    for key in (["session_id", "_hour"], ["session_id"]):
        order = Window.partitionBy(*key).orderBy("opened", "last")
        gap = F.col("opened") - F.lag("last").over(order) > F.make_dt_interval(secs=F.lit(idle))
        rows = rows.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_stretch", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.groupBy(*key, "_stretch").agg(F.min("opened").alias("opened"), F.max("last").alias("last"), F.sum("message_count").alias("message_count"), F.sum("user_messages").alias("user_messages"))
    return rows.select("session_id", "opened", "last", "message_count", "user_messages")
