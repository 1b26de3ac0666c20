"""Repeated passages by suffix order: threshold-bounded interval expansion on Burrows-Wheeler transforms of text shards.

A window is a string of WINDOW bytes. It is routed by its anchor, the least hashed ANCHOR-byte string inside it, which is
the same wherever the window occurs. So all occurrences of a window meet in one shard, and a shard needs only the
stretches of text whose anchors occur in two documents. A shard's transform is expanded breadth-first by one symbol
before the strings known so far, which yields common-prefix lengths in increasing order, and stops at WINDOW.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sent_if_small, stored, table

#: A multiple of 8; the longer the anchor, the fewer texts share it by chance, and the shorter the stretches.
WINDOW, ANCHOR = 50, 24
#: Bytes of distinct stretches in a shard, about. An anchor with more distinct stretches than a shard holds (HOT, each of
#: about 64 bytes) is dealt to several shards, so that a task's memory is bounded.
SHARD = 1 << 19
HOT = SHARD // 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Text that is hashed at once, and copies up to which their ids are sent to every task.
PART, SENT = 1 << 20, 500_000


def anchors(text: bytes, window: int = WINDOW) -> np.ndarray:
    """The anchor hash of each window of the text."""
    n = len(text) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > PART:
        return np.concatenate([anchors(text[i : i + PART + window - 1], window) for i in range(0, n, PART)])
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,)).astype(np.uint64)
    m = len(text) - ANCHOR + 1
    h = words[:m] * _A
    for at in range(8, ANCHOR, 8):
        h = ((h ^ (h >> np.uint64(29))) * _B) + words[at : at + m]
    h = (h ^ (h >> np.uint64(32))) * _A
    h ^= h >> np.uint64(29)
    width, span = window - ANCHOR + 1, 1
    while span < width:  # least hash of `span` neighbours
        step = min(span, width - span)
        h = np.minimum(h[:-step], h[step:])
        span += step
    return h


def runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of each run of windows with one anchor hash."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], first, np.diff(np.append(first, len(h)))


def stretches(text: bytes, wanted: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs whose anchor is among the sorted `wanted`."""
    h, first, n = runs(anchors(text, window))
    if not len(h) or not len(wanted):
        return h[:0], first[:0], n[:0]
    keep = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
    return h[keep], first[keep], n[keep]


def bounded_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of symbols t (0 to 256) by the first `depth` or more symbols, by doubling; the end counts as symbol 0."""
    n, reach = len(t), 7
    padded = np.concatenate([t, np.zeros(reach, t.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(reach):
        key = key << 9 | padded[i : i + n]
    while True:
        order = np.argsort(key)  # equal keys may come in any order: only the first `depth` symbols matter
        if reach >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        later = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, n), np.int64)])[:n]
        key = rank * (n + 2) + later
        reach *= 2


def common_prefix_runs(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each rank, whether its suffix differs from the one before within `depth` symbols.

    Breadth first: an interval holds the suffixes that start with a string of length l. Each symbol before it leads, by
    the last-to-first mapping, to the interval of that symbol and the string. Where the new interval's end isn't known
    yet as a boundary, the common prefix there is l, and the new interval is expanded in the next round.
    """
    n = len(t)
    before = t[order - 1]  # the transform; the first suffix is preceded by the last symbol, a separator
    psi = np.argsort(before, kind="stable")
    first_to = np.empty(n, np.int64)
    first_to[psi] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(depth):
        size = right - left
        owner = np.repeat(np.arange(len(left)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(left, size)
        to = first_to[place]
        by = np.argsort(to)
        to, owner = to[by], owner[by]
        symbol = before[psi[to]]
        cut = np.flatnonzero((to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))
        ends, starts = to[np.append(cut, len(to) - 1)] + 1, to[np.concatenate([[0], cut + 1])]
        new = ~known[ends]
        known[ends] = True
        left, right = starts[new], ends[new]
        if not len(left):
            break
    return known[:n]


def window_minima(texts: list[bytes], docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each text, the least document of each of its windows, over all texts (text i occurs first in docs[i])."""
    size = np.array([len(x) + 1 for x in texts])
    t = np.zeros(int(size.sum()), np.int16)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    ends = np.cumsum(size)
    raw[ends - 1] = 0
    t[:] = raw
    owner = np.repeat(np.arange(len(texts)), size)
    order = bounded_order(t, window)
    run = np.flatnonzero(common_prefix_runs(t, order, window))
    least = np.minimum.reduceat(docs[owner[order]], run)
    of = np.empty(len(t), np.int64)
    of[order] = np.repeat(least, np.diff(np.append(run, len(t))))
    return [of[e - s : e - window] for e, s in zip(ends, size, strict=True)]


def _text_key() -> list[Column]:
    """Two hashes that stand for a text."""
    t = F.col("text").cast("string")
    return [F.xxhash64(t).alias("t1"), F.xxhash64(t, F.lit(1)).alias("t2")]


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2) of texts that a smaller doc_id has too: all their windows are repeats, so they need no comparison."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), *_text_key())
    least = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return rows.join(least, ["t1", "t2"]).where("doc_id > first").select("doc_id", "t1", "t2").distinct()


def _utf8(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, b: the text's bytes) of the texts that aren't copies."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("b"), *_text_key())
    return rows.join(sent_if_small(copies, SENT), ["doc_id", "t1", "t2"], "left_anti").select("doc_id", "b")


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """(h, doc_id): a document's distinct anchors."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                found = [np.unique(runs(anchors(x.as_py(), window))[0]) for x in part.column(1)]
                ids = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids)], ["h", "doc_id"])

    return texts.mapInArrow(run, "h long, doc_id long")


def _stretch_rows(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(h, doc_id, start, s): the stretches of each document around its wanted anchors (doc_id, hs)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                hs, ids, starts, out = [], [], [], []
                for doc, text, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    h, first, n = stretches(text, np.sort(want.values.to_numpy().view(np.uint64)), window)
                    hs.append(h.view(np.int64))
                    ids.append(np.full(len(h), doc, np.int64))
                    starts.append(first)
                    out += [text[i : i + k + window - 1] for i, k in zip(first.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(starts)), pa.array(out, pa.binary())], ["h", "doc_id", "start", "s"])

    return texts.join(wanted, "doc_id").select("doc_id", "b", "hs").mapInArrow(run, "h long, doc_id long, start long, s binary")


def _shard_minima(rows: DataFrame, shard: list[str], window: int) -> DataFrame:
    """(h, k, doc0, s, shard columns) -> (h, k, minima): the least document of each window of s within the shard."""

    def run(group: pa.Table) -> pa.Table:
        minima = window_minima([x.as_py() for x in group.column("s")], group.column("doc0").to_numpy(), window)
        flat = pa.array(np.concatenate(minima))
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in minima])]).astype(np.int32))
        return pa.table({"h": group.column("h"), "k": group.column("k"), "minima": pa.ListArray.from_arrays(offsets, flat)})

    return rows.groupBy(*shard).applyInArrow(run, "h long, k long, minima array<long>")


def _minima(cut: DataFrame, window: int) -> DataFrame:
    """cut (h, k, doc_id, s, ...): stretches by anchor -> (h, k, doc0, minima); null minima: doc0 for every window.

    k is a hash of s, so (h, k) stands for a stretch. Only anchors with several stretches need their bytes.
    """
    distinct = stored(cut.groupBy("h", "k").agg(F.min("doc_id").alias("doc0")), "stretches-distinct")
    n = stored(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors-several")
    met = stored(cut.join(n, "h").groupBy("h", "k", "s", "n").agg(F.min("doc_id").alias("doc0")), "stretches-met", "zstd")
    shards = int((met.agg(F.sum(F.length("s"))).first()[0] or 0) // SHARD + 1)
    cold = _shard_minima(met.where(F.col("n") <= HOT).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))), ["shard"], window)
    hot = met.where(F.col("n") > HOT).withColumn("part", F.pmod(F.xxhash64("k", F.lit(3)), F.ceil(F.col("n") / HOT)))
    local = _shard_minima(hot, ["h", "part"], window).join(hot.select("h", "k", "s"), ["h", "k"])
    windows = local.select("h", "k", "s", F.posexplode("minima").alias("i", "doc")).withColumn("w", F.expr(f"substring(s, i + 1, {window})")).drop("s")
    least = windows.groupBy("h", "w").agg(F.min("doc").alias("least"))
    merged = windows.join(least, ["h", "w"]).groupBy("h", "k").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("m"))
    found = cold.unionByName(merged.select("h", "k", F.col("m.least").alias("minima")))
    return distinct.join(found, ["h", "k"], "left")


def repeated_spans(docs: DataFrame, copies: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, spans: array of (start, stop)): bytes covered by a window that a smaller doc_id has too.
    Texts that are copies of a smaller doc_id's are left out, as they are covered whole.

    Spans may touch or overlap. Steps, each written to the shared folder: anchors that two documents have; for each
    document those of its anchors; distinct stretches around them with their least document; per shard the least
    document of each window; back to the occurrences. Copies collapse to one stretch before shards are formed. Rows of
    one doc_id are one document; rows with a null doc_id or text take no part.
    """
    texts = _utf8(docs, copies)
    rows = _anchor_rows(texts, window)
    met = rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    met = stored(met, "anchors-met")
    wanted = _anchor_rows(texts, window).join(met, "h").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
    wanted = stored(wanted, "anchors-wanted")
    cut = _stretch_rows(texts, wanted, window).withColumn("k", F.xxhash64("s", F.lit(5)))
    cut = stored(cut, "stretches", "zstd")
    minima = stored(_minima(cut, window), "stretch-minima")
    places = cut.select("h", "k", "doc_id", "start", (F.length("s") - (window - 1)).alias("n")).join(minima, ["h", "k"]).where("minima IS NOT NULL OR doc0 < doc_id")

    def run(batches):
        for b in batches:
            whole = b.filter(pc.is_null(b.column(4)))
            docs, starts, n = (whole.column(i).to_numpy() for i in range(3))
            out = [(docs, starts, starts + n + window - 1)]
            rest = b.filter(pc.is_valid(b.column(4)))
            docs, starts, n = (rest.column(i).to_numpy() for i in range(3))
            ends = np.cumsum(n)
            owner = np.repeat(np.arange(len(n)), n)
            less = rest.column(4).flatten().to_numpy() < docs[owner]
            edge = np.zeros(len(less) + 1, bool)  # between windows of two stretches
            edge[np.concatenate([ends - n, ends])] = True
            up, down = np.concatenate([[False], less]), np.concatenate([less, [False]])
            first, last = np.flatnonzero(down & (~up | edge)), np.flatnonzero(up & (~down | edge))
            of = owner[first]
            at = starts[of] - (ends - n)[of]
            out.append((docs[of], at + first, at + last + window - 1))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "stop"])

    spans = places.select("doc_id", "start", F.col("n").cast("long"), "doc0", "minima").mapInArrow(run, "doc_id long, start long, stop long")
    return spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged_spans(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


def passages(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), or with keep_text (_row, kept: string).

    Null texts count as empty. Every row gives a row; rows with a null doc_id lose nothing. Other columns aren't read
    (with keep_text they are in `_row`, and bytes of a character that a cut leaves incomplete go with it).
    """
    copies = stored(_copies(docs), "text-copies")
    spans = stored(repeated_spans(docs, copies, window), "spans")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_text else F.lit(None).cast("int")
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(own.alias("_row"), F.col("doc_id").cast("long"), text.alias("b"), *_text_key())
    rows = rows.join(sent_if_small(copies.withColumn("copy", F.lit(True)), SENT), ["doc_id", "t1", "t2"], "left").join(spans, "doc_id", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("b").cast("long").alias("stop")))
    none = F.array().cast(spans.schema["spans"].dataType)
    rows = rows.withColumn("spans", F.when(F.col("copy"), F.when(F.length("b") >= window, whole).otherwise(none)).otherwise(F.coalesce("spans", none)))

    def pairs(column):
        return [merged_spans([(x["start"], x["stop"]) for x in s]) if s else [] for s in column.to_pylist()]

    if keep_text:

        def cut(batches):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    p = b.slice(at, 256)
                    kept = [_kept(x, s).decode("utf-8", "ignore") for x, s in zip(p.column(1).to_pylist(), pairs(p.column(2)), strict=True)]
                    yield pa.RecordBatch.from_arrays([p.column(0), pa.array(kept, pa.string())], ["_row", "kept"])

        schema = rows.select("_row", F.col("b").cast("string").alias("kept")).schema
        return rows.select("_row", "b", "spans").mapInArrow(cut, schema)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                texts, spans = p.column(1).to_pylist(), pairs(p.column(2))
                columns = [
                    p.column(0),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([hashlib.sha256(_kept(x, s)).hexdigest() for x, s in zip(texts, spans, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "b", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of `text` and `n_chars` (if there is one) counted anew; same columns, every row stays.

    Null texts stay null.
    """
    text = F.when(F.col("_row.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0))}
    out = passages(docs, keep_text=True)
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_array_dedup": op8}
