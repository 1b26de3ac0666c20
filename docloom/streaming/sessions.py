"""A session log kept as state of a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The provider that list state needs; set spark.sql.streaming.stateStore.providerClass to it when the session is built.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "session_id string, message_count long, last_role string, last_content string"


class SessionLog(StatefulProcessor):
    """Appends each request's rows to its session's list and emits the session as it then is; ttl_ms drops idle rows and counts.

    The count is a value of its own, so a request costs what it brings, however long its session is.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "role string, content string", self.ttl_ms)
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            for r in pdf.sort_values(["ts", "seq"]).itertuples():
                if pd.isna(r.error):
                    new += [("user", r.message), ("assistant", r.answer)]
                else:
                    new.append(("assistant", r.error))
        self.rows.appendList(new)
        count = len(new) + (self.count.get()[0] if self.count.exists() else 0)
        self.count.update((count,))
        yield pd.DataFrame({"session_id": [key[0]], "message_count": [count], "last_role": [new[-1][0]], "last_content": [new[-1][1]]})

    def close(self) -> None:
        pass


def session_stream(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, ts, seq, message, answer, error) -> sessions that changed, for update mode.

    A request without a session id opens a session of its own, named by the request, so that a batch that runs again names it alike.
    """
    own = F.sha2(F.to_json(F.struct("ts", "seq", "message", "answer", "error")), 256)
    rows = requests.withColumn("session_id", F.coalesce("session_id", F.concat(F.lit("new-"), own)))
    mode = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy("session_id").transformWithStateInPandas(SessionLog(ttl_ms), outputStructType=OUTPUT, outputMode="Update", timeMode=mode)


CLOSED = "session_id string, opened timestamp, last timestamp, message_count long, user_messages long"


class Visit(StatefulProcessor):
    """A session's open stretches, each closed by a timer once the watermark has passed its last message by more than `idle`.

    A message that comes late, but not behind the watermark, may widen a stretch or join two; one behind the watermark is left out and
    opens nothing. State is a row for each open stretch, whatever a session's length.
    """

    def __init__(self, idle: int):
        self.idle = idle * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "opened long, last long, n long, users long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(r.us), int(r.us), 1, int(r.role == "user")) for pdf in rows for r in pdf.itertuples() if r.us >= since]
        old, joined = [tuple(x) for x in self.open.get()], []
        for o, last, n, users in sorted(old + new):
            if joined and o - joined[-1][1] <= self.idle:
                a, b, m, u = joined[-1]
                joined[-1] = (a, max(b, last), m + n, u + users)
            else:
                joined.append((o, last, n, users))
        self._keep(joined)
        yield pd.DataFrame(columns=["session_id", "opened", "last", "message_count", "user_messages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.open.get()]
        over = [x for x in held if x[1] + self.idle < now]
        self._keep([x for x in held if x not in over])
        closed = pd.DataFrame(over, columns=["opened", "last", "message_count", "user_messages"])
        closed.insert(0, "session_id", key[0])
        yield closed.assign(opened=pd.to_datetime(closed.opened, unit="us"), last=pd.to_datetime(closed["last"], unit="us"))

    def _keep(self, held: list[tuple[int, int, int, int]]) -> None:
        """Holds these stretches, with a timer for each one's end and no other."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for x in held:
            self.handle.registerTimer((x[1] + self.idle) // 1000 + 1)
        if held:
            self.open.put(held)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def visit_stream(log: DataFrame, idle: int = 1800, late: str = "10 minutes") -> DataFrame:
    """A stream of (session_id, ts, role) -> the stretches of `operators.sessions.visits`, each once, when it is over, for append mode.

    Rows without a session id or ts are left out. The session's time zone has to be UTC, as pandas has none, and the state store RocksDB.
    """
    rows = log.where("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select("session_id", "ts", F.unix_micros("ts").alias("us"), "role")
    return rows.groupBy("session_id").transformWithStateInPandas(Visit(idle), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime")
