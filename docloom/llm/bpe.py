"""Byte-level BPE by recursive DuckDB queries inside each partition, and decoding by ordered aggregation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vocab import read_ranks, split_pattern, vocabulary_file

#: Text that is worked on at once, distinct pieces of a recursive query, pieces that a worker remembers, tokens of a decoding query.
CHARS, PIECES, KNOWN, TOKENS = 1 << 22, 1 << 14, 800_000, 1 << 18
#: Pieces from this many bytes on are encoded by tiles; rows of all rounds that a query may keep.
LONG, KEPT = 256, 1 << 23
#: Bytes of a tile (each starts in the middle of the one before), tiles that are encoded together, bytes of wider windows.
TILE, TILES, WIDE = 64, 8192, (1024, 16384)

#: A word's rows are its tokens by position. Each round joins neighbours with the merge table, takes each word's pair of
#: least rank (the leftmost of equals, as the number holds rank, then position), contracts it and closes the gap; words
#: without a pair drop out. The rows of a word's last round are its encoding.
ENCODE = """
WITH RECURSIVE s(round, w, pos, tok) AS (
    SELECT 0, w, pos, tok FROM start_rows
  UNION ALL
    SELECT s.round + 1, s.w, s.pos - CAST(s.pos > b.at AS INT), CASE WHEN s.pos = b.at THEN b.merged ELSE s.tok END
    FROM s JOIN (
      SELECT w, CAST(min(k) >> 32 AS INT) AS merged, CAST(min(k) & 4294967295 AS INT) AS at
      FROM (
        SELECT x.w, (CAST(m.merged AS BIGINT) << 32) | x.pos AS k
        FROM s x JOIN s y ON (CAST(x.w AS BIGINT) << 32 | (x.pos + 1)) = (CAST(y.w AS BIGINT) << 32 | y.pos) JOIN merges m ON x.tok = m.a AND y.tok = m.b)
      GROUP BY w) b ON s.w = b.w
    WHERE s.pos <> b.at + 1)
SELECT s.w, tok FROM s JOIN (SELECT w, max(round) AS last FROM s GROUP BY w) f ON s.w = f.w AND s.round = f.last ORDER BY s.w, pos"""

#: The same for stretches of long pieces, in many places of a word in one round. A pair is contracted if it has the least rank, and is the
#: leftmost of that rank, among all pairs within {reach} tokens, the length of the longest token: whatever is contracted
#: farther away before it can't grow up to it. Other pairs of that rank (a line of dashes has many) are contracted in the
#: same round, in a run of overlapping ones each second from the left, if the whole run has the least rank and no pair of
#: the rank nearby would, once contracted, stand beside a token with which it makes a pair of a lower rank.
ENCODE_LONG = """
WITH RECURSIVE s(round, w, pos, tok) AS (
    SELECT 0, w, pos, tok FROM start_rows
  UNION ALL
    SELECT round + 1, w, CAST(row_number() OVER (PARTITION BY w ORDER BY pos) - 1 AS INT), tok
    FROM (
      SELECT round, w, pos, CASE WHEN here THEN merged ELSE tok END AS tok,
        coalesce(lag(here) OVER (PARTITION BY w ORDER BY pos), false) AS gone, bool_or(here) OVER (PARTITION BY w) AS going
      FROM (
        SELECT *, merged IS NOT NULL AND (k = best OR coalesce(whole AND coalesce(uneasy > merged, true) AND (pos - since) % 2 = 0, false)) AS here
        FROM (
          SELECT *, min(pos) OVER (PARTITION BY w, run) AS since, bool_and(merged = best >> 32) OVER (PARTITION BY w, run) AS whole,
            min(CASE WHEN lower THEN merged END) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS uneasy
          FROM (
            SELECT c.*, sum(CASE WHEN c.merged = c.before THEN 0 ELSE 1 END) OVER (PARTITION BY c.w ORDER BY c.pos) AS run,
              coalesce(least(x.merged, y.merged, z.merged) < c.merged, false) AS lower
            FROM (
              SELECT *, CASE WHEN merged = best >> 32 THEN merged END AS made
              FROM (
                SELECT *, lag(merged) OVER (PARTITION BY w ORDER BY pos) AS before,
                  min(k) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS best
                FROM (
                  SELECT p.*, m.merged, (CAST(m.merged AS BIGINT) << 32) | p.pos AS k
                  FROM (
                    SELECT *, lag(tok) OVER (PARTITION BY w ORDER BY pos) AS prev, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, lead(tok, 2) OVER (PARTITION BY w ORDER BY pos) AS third
                    FROM s WHERE round < {rounds}) p
                  LEFT JOIN merges m ON p.tok = m.a AND p.nxt = m.b))) c
            LEFT JOIN merges x ON x.a = c.prev AND x.b = c.made
            LEFT JOIN merges y ON y.a = c.made AND y.b = c.third
            LEFT JOIN merges z ON z.a = c.made AND z.b = c.made))))
    WHERE going AND NOT gone)
SELECT s.w, s.pos, tok FROM s JOIN (SELECT w, max(round) AS last FROM s GROUP BY w) f ON s.w = f.w AND s.round = f.last ORDER BY s.w, s.pos"""

DECODE = "SELECT d, array_to_string(list(hex ORDER BY pos), '') AS hex FROM ids JOIN vocab USING (tok) GROUP BY d ORDER BY d"


@lru_cache(maxsize=1)
def _database(file: str):
    """(connection with tables merges and vocab, ranks); one for each worker process, in memory, one thread, no files of its own."""
    import duckdb

    ranks = read_ranks(file)
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
    splits = ((t[:i], t[i:], r) for t, r in ranks.items() for i in range(1, len(t)))
    merges = np.array([(ranks[a], ranks[b], r) for a, b, r in splits if a in ranks and b in ranks], np.int32)
    con.register("_m", pa.table({"a": merges[:, 0], "b": merges[:, 1], "merged": merges[:, 2]}))
    con.register("_v", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
    con.execute("CREATE TABLE merges AS SELECT * FROM _m")
    con.execute("CREATE TABLE vocab AS SELECT * FROM _v")
    con.unregister("_m")
    con.unregister("_v")
    return con, ranks


def _rows(pieces: list[bytes], ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    n = np.array([len(p) for p in pieces])
    w = np.repeat(np.arange(len(pieces), dtype=np.int32), n)
    pos = np.arange(len(w), dtype=np.int32) - np.repeat(np.cumsum(n) - n, n).astype(np.int32)
    first = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
    return {"w": w, "pos": pos, "tok": first[np.frombuffer(b"".join(pieces), np.uint8)]}


def _contract(con, sql: str, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    con.register("start_rows", pa.table(rows))
    got = con.execute(sql).fetchnumpy()
    con.unregister("start_rows")
    return {k: np.asarray(v) for k, v in got.items()}


def _contracted(pieces: list[bytes], con, ranks: dict[bytes, int]) -> list[np.ndarray]:
    """The ids of each piece, all of them short: as many at once as keep a bounded number of rows over all rounds."""
    out, at = [], 0
    while at < len(pieces):
        to, kept = at, 0
        while to < len(pieces) and (to == at or to - at < PIECES and kept + len(pieces[to]) ** 2 // 2 <= KEPT):
            kept += len(pieces[to]) ** 2 // 2
            to += 1
        got = _contract(con, ENCODE, _rows(pieces[at:to], ranks))
        ends = np.searchsorted(got["w"], np.arange(1, to - at))
        out += np.split(got["tok"].astype(np.int32), ends)
        at = to
    return out


def _fixpoint(stretch: bytes, con, ranks: dict[bytes, int]) -> np.ndarray:
    """The ids of one stretch, contracted in many places a round; the query starts again from its last round's rows as often as needed."""
    rows, before, reach = _rows([stretch], ranks), -1, max(map(len, ranks))
    while len(rows["tok"]) != before:
        before = len(rows["tok"])
        rows = _contract(con, ENCODE_LONG.format(reach=reach, rounds=max(1, KEPT // 4 // before)), rows)
    return rows["tok"].astype(np.int32)


class _Tokens:
    """The tokens of a stretch of a piece, and where they start in the piece."""

    def __init__(self, at: int, ids: np.ndarray, sizes: np.ndarray):
        starts = at + np.concatenate([[0], np.cumsum(sizes[ids])])
        self.ids, self.starts, self.end = ids, starts[:-1].tolist(), int(starts[-1])
        self.place = {x: k for k, x in enumerate(zip(self.starts, ids.tolist(), strict=True))}

    def meets(self, other: _Tokens, since: int) -> tuple[int, int] | None:
        """The last token from number `since` on that both have, by its numbers here and there."""
        both = self.place.keys() & other.place.keys()
        k = max((self.place[x] for x in both), default=-1)
        return None if k < max(since, 0) else (k, other.place[self.starts[k], int(self.ids[k])])


def _encode_long(piece: bytes, con, ranks: dict[bytes, int], sizes: np.ndarray) -> np.ndarray:
    """The ids of a piece of any length, in memory that doesn't grow with the work of its rounds.

    Overlapping stretches are encoded on their own and put together where both have the same token. That is exact: tokens are
    the encoding of their text if each two neighbours are that of theirs, as the first contraction across a border would take
    place between these two alone as well. Neighbours within a stretch are, and a shared token stands in both stretches. Tiles are tried first, all
    by one query; where two of them share no token (in periodic text their phases may differ) wider windows from a token's
    start on, at last the whole piece.
    """
    half, tiles, wide = TILE // 2, {}, {}

    def tile(at: int) -> _Tokens:
        if at not in tiles:
            tiles.clear()
            texts = {s: piece[s : s + TILE] for s in range(at, min(len(piece), at + TILES * half), half)}
            distinct = list(set(texts.values()))
            ids = dict(zip(distinct, _contracted(distinct, con, ranks), strict=True))
            tiles.update((s, ids[t]) for s, t in texts.items())
        return _Tokens(at, tiles[at], sizes)

    def window(at: int, size: int) -> _Tokens:
        text = piece[at : at + size]
        if text not in wide:
            if len(wide) >= 64:
                wide.clear()
            wide[text] = _fixpoint(text, con, ranks)
        return _Tokens(at, wide[text], sizes)

    def following():
        """Stretches that reach farther than the present one, by the work they take."""
        yield tile((now.end - half) // half * half)
        margin = min(max(map(len, ranks)), (now.end - now.starts[0]) // 2)
        late = max(k for k, s in enumerate(now.starts) if s <= now.end - margin)
        for size in WIDE:
            for k in sorted({max(late, done - 1, 0), max(done - 1, 0)}, reverse=True):
                if now.starts[k] + size > now.end:
                    yield window(now.starts[k], size)

    out, now, done = [], tile(0), 0
    while now.end < len(piece):
        found = next(((x, m) for x in following() if (m := now.meets(x, done - 1))), None)
        if found is None:
            return _fixpoint(piece, con, ranks)
        then, (here, there) = found
        out.append(now.ids[done : here + 1])
        now, done = then, there + 1
    return np.concatenate([*out, now.ids[done:]])


def encode_pieces(pieces: list[bytes], file: str) -> list[bytes]:
    """The ids of each distinct piece, as the bytes of 32-bit numbers; a piece that is a token itself is that token."""
    con, ranks = _database(file)
    out = [np.int32(ranks[p]).tobytes() if p in ranks else b"" for p in pieces]
    todo = [i for i, p in enumerate(pieces) if p not in ranks]
    short, long = [i for i in todo if len(pieces[i]) < LONG], [i for i in todo if len(pieces[i]) >= LONG]
    for i, ids in zip(short, _contracted([pieces[i] for i in short], con, ranks), strict=True):
        out[i] = ids.tobytes()
    if long:
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(t) for t in ranks]
        for i in long:
            out[i] = _encode_long(pieces[i], con, ranks, sizes).tobytes()
    return out


def decode_ids(lists: list[np.ndarray], file: str) -> list[bytes]:
    """The bytes of each list of ids; a query takes TOKENS ids at most, so a long list goes through several."""
    con, _ = _database(file)
    cuts = [(i, x[k : k + TOKENS]) for i, x in enumerate(lists) for k in range(0, len(x), TOKENS)]
    out, at = [[] for _ in lists], 0
    while at < len(cuts):
        to, n = at, 0
        while to < len(cuts) and (to == at or n + len(cuts[to][1]) <= TOKENS):
            n += len(cuts[to][1])
            to += 1
        d = np.repeat(np.arange(at, to, dtype=np.int32), [len(x) for _, x in cuts[at:to]])
        con.register("ids", pa.table({"d": d, "pos": np.arange(len(d), dtype=np.int64), "tok": np.concatenate([x for _, x in cuts[at:to]]).astype(np.int32)}))
        for k, h in con.execute(DECODE).fetchall():
            out[cuts[k][0]].append(bytes.fromhex(h))
        con.unregister("ids")
        at = to
    return [b"".join(x) for x in out]


class _Memory:
    """Encodes texts, and remembers the ids of the pieces that a worker has met."""

    def __init__(self, file: str):
        import regex

        self.file = file
        self.pattern = regex.compile(split_pattern().replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > KNOWN:
            self.pieces = {}
        split = [self.pattern.findall(t) for t in texts]
        new = list(set().union(*split) - self.pieces.keys())
        self.pieces.update(zip(new, encode_pieces([p.encode() for p in new], self.file), strict=True))
        get = self.pieces.__getitem__
        return [np.frombuffer(b"".join(map(get, ps)), np.int32) for ps in split]


@lru_cache(maxsize=1)
def _memory(file: str) -> _Memory:
    return _Memory(file)


@lru_cache(maxsize=1)
def _names(file: str):
    """Gives an id's decimal digits."""
    return [str(i) for i in range(max(_database(file)[1].values()) + 1)].__getitem__


def _parts(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch in parts of about CHARS characters."""
    keys, texts, n = [], [], 0
    for k, t in zip(b.column(0), b.column(1), strict=True):
        keys.append(k.as_py())
        texts.append(t.as_py() or "")
        n += len(texts[-1])
        if n >= CHARS:
            yield keys, texts
            keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def encode_documents(docs: DataFrame, file: str) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids: array of int): the ids that the tiktoken library gives for ordinary text.

    Null and empty texts have no ids. Rows stay in their task, repeated rows and null doc_ids too; other columns are
    not read. Only distinct pieces of a task's text go through the recursive query. A piece of n bytes takes up to n
    rounds over n rows; a long one (no space or mark in LONG bytes) is encoded by overlapping tiles, so its length is no limit.
    """

    def run(batches):
        memory = _memory(file)
        for b in batches:
            for keys, texts in _parts(b):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(memory.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, bytes: binary). Null ids decode to no bytes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lists = [np.array(x or [], np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(decode_ids(lists, file), pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """docs -> (doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so ids need not leave the task."""

    def run(batches):
        memory, names = _memory(file), _names(file)
        for b in batches:
            for keys, texts in _parts(b):
                ids = memory.encode(texts)
                back = decode_ids(ids, file)
                columns = [
                    pa.array(keys, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(names, x.tolist())).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


FILE = "byte_bpe_multi_50k.tiktoken"


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_file(FILE))


QUERIES = {"op6_byte_bpe": op6}
