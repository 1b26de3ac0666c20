"""Files that come to a folder, chunked into the store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..sources.files import ChunkStore


def ingest_stream(texts: DataFrame, store: ChunkStore, chunks: Callable[[DataFrame], DataFrame], checkpoint: str, name: str) -> DataStreamWriter:
    """A stream of (path, filename, text), as `files.text_stream`, written into the store; to be started with a trigger.

    Each batch is one commit under the stream's name and its number: a batch that runs again after a failure finds its commit, or
    without it has left nothing that counts, and files whose content the store has are not chunked again.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.ingest(batch, chunks, f"{name}:{number}")

    return texts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
