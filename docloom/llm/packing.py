"""Vector bin packing of token sequences: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vocab import encoder, vocabulary_file

#: Limits of a sequence; a document's first token bears no loss, as nothing precedes it.
TOKENS, SEGMENTS, LOSS = 1024, 128, 1024
#: Examples that wait in a task to be placed.
POOL = 1024
#: The id that ends a document, and rows that become Python strings at once.
END, STEP = 0, 256


@dataclass
class Packer:
    """Places examples of one task. An example is (key, ids, loss): loss marks the ids that bear loss.

    A bin's next example is the one of the pool that fits whole and whose demand (tokens, one segment, loss tokens,
    each over its limit) has the largest dot product with what is left of the bin. If none fits, the largest one is cut
    at the bin's end, so bins are full unless another limit than tokens closes them; what is left when the task ends is
    cut into bins whose lengths are powers of two, which need no padding.
    """

    base: int
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = LOSS
    pool: list = field(default_factory=list)
    done: list = field(default_factory=list)
    bins: int = 0

    def __post_init__(self):
        self.limit = np.array([self.tokens, self.segments, self.loss], float)
        self.need = np.zeros((0, 3))

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> None:
        at, n = 0, len(ids)
        while n - at >= self.tokens and loss[at : at + self.tokens].sum() <= self.loss:
            self._emit([(key, at, ids[at : at + self.tokens], n)])
            at += self.tokens
        if at < n:
            self.pool.append((key, at, ids[at:], loss[at:], n))

    def _refresh(self) -> None:
        """pool's demands; `need` is kept in step with pool from here on."""
        self.need = np.array([(len(p[2]), 1, int(p[3].sum())) for p in self.pool], float).reshape(-1, 3)

    def drain(self, down_to: int) -> None:
        """Fills bins until the pool holds at most `down_to` examples, and at the end all of them."""
        self._refresh()
        alive = np.ones(len(self.pool), bool)
        while (n := int(alive.sum())) > down_to:
            room, held = self.limit.copy(), []
            left = self.need[alive, 0].sum()
            if down_to == 0 and left < self.tokens:
                room[0] = 1 << int(left).bit_length() - 1  # the tail: powers of two
            while n:
                fit = alive & (self.need <= room + 1e-9).all(axis=1)
                if not fit.any():
                    break
                i = int(np.argmax(np.where(fit, (self.need / self.limit) @ (room / self.limit), -1)))
                key, at, ids, _, of = self.pool[i]
                held.append((key, at, ids, of))
                room -= self.need[i]
                alive[i], n = False, n - 1
            if n and room[0] >= 1 and room[1] >= 1:
                i = int(np.argmax(np.where(alive, self.need[:, 0], -1)))
                key, at, ids, loss, of = self.pool[i]
                k = min(len(ids), int(room[0]), int(np.searchsorted(np.cumsum(loss), room[2], side="right")))
                if k:
                    held.append((key, at, ids[:k], of))
                    self.pool[i] = (key, at + k, ids[k:], loss[k:], of)
                    self.need[i] = (len(ids) - k, 1, int(loss[k:].sum()))
                    alive[i] = k < len(ids)
            self._close(held)
        self.pool = [p for p, keep in zip(self.pool, alive, strict=True) if keep]

    def _close(self, held: list) -> None:
        """A bin that a limit other than tokens closed is cut down to powers of two where that needs no padding."""
        total = sum(len(h[2]) for h in held)
        while held and total < self.tokens and total & (total - 1):
            size, now, used = 1 << total.bit_length() - 1, [], 0
            while used < size:
                key, at, ids, of = held.pop(0)
                k = min(len(ids), size - used)
                now.append((key, at, ids[:k], of))
                used += k
                if k < len(ids):
                    held.insert(0, (key, at + k, ids[k:], of))
            self._emit(now)
            total -= size
        if held:
            self._emit(held)

    def _emit(self, held: list) -> None:
        at = 0
        for key, start, ids, of in held:
            self.done.append((key, start, ids, of, self.base + self.bins, at))
            at += len(ids)
        self.bins += 1

    def take(self) -> list:
        out, self.done = self.done, []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _rows(pieces: list, with_ids: bool) -> pa.RecordBatch:
    columns = {
        "doc_id": pa.array([p[0] for p in pieces], pa.int64()),
        "start": pa.array([p[1] for p in pieces], pa.int64()),
        "length": pa.array([len(p[2]) for p in pieces], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(p[2].astype("<u4").tobytes()) for p in pieces], pa.int64()),
        "doc_tokens": pa.array([p[3] for p in pieces], pa.int64()),
        "sequence_id": pa.array([p[4] for p in pieces], pa.int64()),
        "offset": pa.array([p[5] for p in pieces], pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array([p[2].astype(np.int32) for p in pieces], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def _pack(df: DataFrame, examples, with_ids: bool, limits: dict) -> DataFrame:
    """Each task packs its own rows: nothing is shuffled, and a bin never waits for another task."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        packer = Packer(base=TaskContext.get().partitionId() << 36, **limits)
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                for example in examples(b.slice(at, STEP)):
                    packer.add(*example)
                if len(packer.pool) > POOL:
                    packer.drain(POOL // 2)
                if packer.done:
                    yield _rows(packer.take(), with_ids)
        packer.drain(0)
        if packer.done:
            yield _rows(packer.take(), with_ids)

    return df.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, file: str, special: str | None = None, with_ids: bool = False, **limits: int) -> DataFrame:
    """docs (doc_id, text, ...) -> a row for each piece of a document's ids: where it lies in the document and in its sequence.

    file: a rank file; special: a JSON vocabulary whose special tokens keep their ids. A document is its text's ids and END; null and empty texts are END alone. limits: tokens,
    segments, loss. with_ids adds the ids. Repeated rows and null doc_ids are packed like others. Other columns are not
    read. Sequence ids carry the task's number, so they are unique, and a task that runs again repeats them.
    """

    def examples(b: pa.RecordBatch):
        encode = encoder(file, special).encode_to_numpy
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text, allowed_special="all") if text else np.zeros(0, np.uint32), np.uint32(END))
            loss = np.ones(len(ids), bool)
            loss[0] = False
            yield key, ids, loss

    return _pack(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), examples, with_ids, limits)


def pack_conversations(turns: DataFrame, file: str, special: str | None = None, bearing: str = "assistant", with_ids: bool = False, **limits: int) -> DataFrame:
    """turns (conv_id, turn, role, text) -> pieces as of pack_documents, with conv_id as doc_id; only turns of role `bearing` bear loss.

    Each turn ends with END. Turns of a conversation are gathered in order of turn, role and text; a conversation is one
    example and thus bounded. Null roles and texts count as ''; a turn with a null conv_id is an example of its own.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = turns.select(F.col("conv_id").cast("long").alias("doc_id"), alone.alias("_alone"), "turn", "role", "text")
    talks = turns.groupBy("doc_id", "_alone").agg(ordered.alias("turns")).select("doc_id", "turns")

    def examples(b: pa.RecordBatch):
        encode = encoder(file, special).encode_to_numpy
        for key, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts = [np.append(encode(s["text"], allowed_special="all") if s["text"] else np.zeros(0, np.uint32), np.uint32(END)) for s in said]
            loss = np.concatenate([np.full(len(p), s["role"] == bearing) for p, s in zip(parts, said, strict=True)])
            yield key, np.concatenate(parts), loss

    return _pack(talks, examples, with_ids, limits)


#: The vocabulary, and the rank file with the same ids.
NAMED, FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Loss-bearing tokens and segments of a sequence of conversations.
TALK_LOSS, TALK_SEGMENTS = 640, 2


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_file(FILE), vocabulary_file(NAMED))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: only the assistant's turns bear loss, and each of the three limits can close a sequence."""
    return pack_conversations(table(spark, sf_dir, "conversations"), vocabulary_file(FILE), vocabulary_file(NAMED), loss=TALK_LOSS, segments=TALK_SEGMENTS)


QUERIES = {"op5_packing": op5, "pack_conversations": talks}
