"""Explicit schemas of the data model; nothing is inferred."""

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_size", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("file_size", T.IntegerType()),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("chunk_id", T.IntegerType()),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
    ]
)
STORE_FILE = T.StructType(
    [
        T.StructField("documents", T.ArrayType(CHUNK)),
        T.StructField("metadata", T.StructType([T.StructField("created_at", T.StringType()), T.StructField("total_documents", T.IntegerType()), T.StructField("total_chunks", T.IntegerType())])),
    ]
)
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CONVERSATION_ARRAY = T.ArrayType(MESSAGE)
CONVERSATION_OBJECT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("system_prompt", T.StructType([T.StructField("key", T.StringType()), T.StructField("name", T.StringType()), T.StructField("content", T.StringType())])),
        T.StructField("history", CONVERSATION_ARRAY),
    ]
)
CONVERSATION_STATE = T.StructType(
    [
        T.StructField("conversation_history", CONVERSATION_ARRAY),
        T.StructField(
            "stats",
            T.StructType(
                [
                    T.StructField("total_messages", T.LongType()),
                    T.StructField("total_tokens", T.LongType()),
                    T.StructField("total_rag_queries", T.LongType()),
                    T.StructField("start_time", T.StringType()),
                ]
            ),
        ),
        T.StructField("current_model", T.StringType()),
        T.StructField("current_system_prompt", T.StringType()),
        T.StructField("saved_at", T.StringType()),
    ]
)
EMBEDDING_RESPONSE = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType()))])))])
MODEL_LIST = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField("id", T.StringType())])))])
COMPLETION = T.StructType(
    [
        T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]))),
        T.StructField("usage", T.StructType([T.StructField("total_tokens", T.LongType())])),
    ]
)
REQUEST = T.StructType([T.StructField("message", T.StringType()), T.StructField("session_id", T.StringType())])
