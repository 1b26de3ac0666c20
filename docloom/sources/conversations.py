"""Three JSON forms of a saved conversation, a folder of them, and conversations of any length kept on pages."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.pages import RANGE, appended, paged


def history_of(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, history: array of role, content in order): a conversation's messages, bounded by what its bot keeps. Longer ones go on pages."""
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content"))))
    return rows.groupBy(key).agg(F.transform(said, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("history"))


def as_array(history: Column) -> Column:
    return F.to_json(history)


def from_array(json: Column) -> Column:
    return F.from_json(json, schemas.CONVERSATION_ARRAY)


def as_object(history: Column, timestamp: Column, model: Column, key: Column, name: Column, content: Column) -> Column:
    prompt = F.struct(key.alias("key"), name.alias("name"), content.alias("content"))
    return F.to_json(F.struct(timestamp.alias("timestamp"), model.alias("model"), prompt.alias("system_prompt"), history.alias("history")))


def from_object(json: Column, default_key: str = "general_assistant") -> tuple[Column, Column]:
    """(history, prompt key), with an empty history and the default key where they are missing."""
    o = F.from_json(json, schemas.CONVERSATION_OBJECT)
    return F.coalesce(o.history, F.array().cast(schemas.CONVERSATION_ARRAY)), F.coalesce(o.system_prompt.key, F.lit(default_key))


def as_state(history: Column, messages: Column, tokens: Column, queries: Column, start: Column, model: Column, prompt: Column, saved: Column) -> Column:
    """start and saved are timestamps and are written as ISO text."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    stats = F.struct(messages.alias("total_messages"), tokens.alias("total_tokens"), queries.alias("total_rag_queries"), iso(start).alias("start_time"))
    return F.to_json(F.struct(history.alias("conversation_history"), stats.alias("stats"), model.alias("current_model"), prompt.alias("current_system_prompt"), iso(saved).alias("saved_at")))


def from_state(json: Column) -> Column:
    return F.from_json(json, schemas.CONVERSATION_STATE)


def _listed(saved: Column | None = None) -> list[Column]:
    """(timestamp, prompt_name, messages, error) of a saved object's fields, with defaults for what is missing."""
    field = lambda name: F.col(name) if saved is None else saved[name]
    prompt = field("system_prompt")["name"]
    return [
        F.coalesce(field("timestamp"), F.lit("unknown")).alias("timestamp"),
        F.coalesce(prompt, F.lit("unknown")).alias("prompt_name"),
        F.when(field("history").isNull(), 0).otherwise(F.size(field("history"))).alias("messages"),
        field("_broken").isNotNull().alias("error"),
    ]


_SAVED = T.StructType([*schemas.CONVERSATION_OBJECT.fields, T.StructField("_broken", T.StringType())])
_READ = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def listing(rows: DataFrame, json: str) -> DataFrame:
    """rows with (timestamp, prompt_name, messages, error) of the saved object in column `json`; what can't be read has error true."""
    rows = rows.withColumn("_saved", F.from_json(json, _SAVED, _READ))
    return rows.select(*[c for c in rows.columns if c not in ("_saved", json)], *_listed(F.col("_saved")))


def list_saved(spark: SparkSession, folder: str) -> DataFrame:
    """(path, timestamp, prompt_name, messages, error) for each saved object in a folder; an unreadable file has error true."""
    rows = spark.read.schema(_SAVED).options(multiLine=True, pathGlobFilter="*.json", **_READ).json(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), *_listed())


class PagedConversations:
    """Conversations of any length under a folder: rows (key, page, messages) of `size` messages, each save a version of its own.

    A save brings the pages that it changes, each key's last and those behind it, and leaves full pages alone, so its cost does not
    grow with what is stored. The newest version of a page counts. A save reads only versions before its own, so one that failed
    or runs again under its number gives what it would have given. Of saves under one number the last one stays; numbers are the
    caller's, as those of a stream's batches.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int, key: str = "conv_id", key_type: str = "long"):
        self.spark, self.folder, self.size, self.key = spark, folder, size, key
        self.schema = f"{key} {key_type}, page long, messages array<struct<role:string,content:string>>, version long"

    def pages(self, before: int | None = None) -> DataFrame:
        """(key, page, messages), of versions under `before` if it is given."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema).drop("version")
        found = self.spark.read.schema(self.schema).parquet(self.folder)
        if before is not None:
            found = found.where(F.col("version") < before)
        return found.groupBy(self.key, "page").agg(F.max_by("messages", "version").alias("messages"))

    def save(self, rows: DataFrame, version: int, order: str = "turn") -> None:
        """Appends rows (key, order, role, text) to their conversations."""
        cut, said = F.floor(F.col(order) / RANGE), F.struct("role", F.col("text").alias("content"))
        new = appended(self.pages(version), rows, self.key, [order], said, cut, self.size) if version else paged(rows, self.key, [order], said, cut, self.size)
        new.write.mode("overwrite").parquet(f"{self.folder}/version={version}")
