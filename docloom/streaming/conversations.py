"""Conversations as state of a stream: each message goes to the model with the last ones of its own conversation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chat import KEPT_BASIC, MAX_TOKENS_RAG, SENT, TEMPERATURE

OUTPUT = "conv_id string, seq long, answer string, error string, kept long"


def request(history: list[tuple[str, str]], message: str, model: str, system: str | None) -> str:
    """The request body as JSON text: system message if there is one, history, current message."""
    said = [("system", system)] * (system is not None) + history + [("user", message)]
    messages = [{"role": role, "content": content} for role, content in said]
    return json.dumps({"model": model, "messages": messages, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS_RAG, "stream": False}, ensure_ascii=False)


class Conversation(StatefulProcessor):
    """Holds a conversation's newest `keep` messages, calls the client, appends the pair only if it answers.

    A message without an answer leaves no row behind, and its error is told apart. State is bounded by `keep` messages, however long
    a conversation lasts. A batch that runs again calls the client again from the state before it, and its pairs count once.
    """

    def __init__(self, client: Callable[[str], str], model: str, system: str | None, sent: int, keep: int, ttl_ms: int | None):
        self.client, self.model, self.system, self.sent, self.keep, self.ttl_ms = client, model, system, sent, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "role string, content string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        history = [tuple(m) for m in self.messages.get()]
        before, out = list(history), []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            answer = error = None
            try:
                answer = self.client(request(history[-self.sent :] if self.sent else [], r.message, self.model, self.system))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            if answer is not None:
                history = [*history, ("user", r.message), ("assistant", answer)][-self.keep :]
            elif error is None:
                error = "no answer"
            out.append((key[0], r.seq, answer, error, len(history)))
        if history != before:
            self.messages.put(history)
        yield pd.DataFrame(out, columns=["conv_id", "seq", "answer", "error", "kept"]).astype({"answer": object, "error": object})

    def close(self) -> None:
        pass


def conversation_stream(
    requests: DataFrame, client: Callable[[str], str], model: str, system: str | None = None, sent: int = SENT, keep: int = KEPT_BASIC, ttl_ms: int | None = None
) -> DataFrame:
    """A stream of (conv_id, ts, seq, message) -> (conv_id, seq, answer, error, kept messages), a row for each request, for append mode.

    Requests of one conversation are answered in order of ts and seq within a batch, and batch after batch; blank and null messages
    and ids are left out. The state store has to be RocksDB (`sessions.ROCKSDB`).
    """
    rows = requests.where("conv_id IS NOT NULL AND trim(message) <> ''")
    own = Conversation(client, model, system, sent, keep, ttl_ms)
    return rows.groupBy("conv_id").transformWithStateInPandas(own, outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
