"""Fuzzy line dedup: MinHash over character shingles, high-recall banding, exact Jaccard, union-find, one line per component."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import jaccard_reaches, may_reach, similar_stars, tiles
from .common import WHITE, sent_if_small, stored, table, whole
from .components import components

#: Characters of a shingle (a shorter line is one shingle), and the Jaccard similarity from which lines are linked.
SHINGLE, SIMILAR = 9, 0.8
#: A pair at that similarity shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.998, a more similar one with more.
BANDS, ROWS = 12, 4
#: Lines under SHORT characters are also compared by shingles of SHORT_SHINGLE characters, so that one changed character leaves
#: lines from 39 characters on similar, and one changed five-letter word lines from 75 on; the long shingles bear it from 89 and 125 on.
SHORT, SHORT_SHINGLE = 128, 4
#: Short shingles are shared by chance more often; longer bands keep such pairs apart. Recall at SIMILAR is 0.998 again.
SHORT_BANDS, SHORT_ROWS = 21, 6
#: Rows of numbers up to which a side of a join is sent to every task.
SENT = 500_000
#: Members from which a band is compared tile by tile, and members of bands that a task sorts at once, about.
CROWD, PART = 32, 1 << 20
#: One line in SAMPLE is looked at beforehand; bands with MANY of them (some 256 lines) aren't sorted by one task.
SAMPLE, MANY = 64, 4
#: Lines whose bands are computed at once.
STEP = 512


def _seeds(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, (n, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


_SEEDS, _SHORT_SEEDS = _seeds(20, BANDS * ROWS), _seeds(21, SHORT_BANDS * SHORT_ROWS)
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 1_000_003


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _hashes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle of `width` characters, where a line's first one is); every line has a character."""
    points = np.frombuffer("".join(x.ljust(width, "\0") for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([max(len(x), width) for x in lines])
    ends = np.cumsum(n)
    h, have = points, 1  # of the `have` characters from each place on
    for bit in bin(width)[3:]:
        h, have = h[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:], 2 * have
        if bit == "1":
            h, have = h[:-1] * np.uint64(_BASE) + points[have:], have + 1
    inside = np.ones(len(points), bool)
    for k in range(1, width):
        inside[ends - k] = False
    return _mixed(h)[inside[: len(h)]], np.cumsum(n - width + 1) - (n - width + 1)


def _bands(lines: list[str], width: int, seeds: np.ndarray, rows: int, first: int) -> np.ndarray:
    """(lines x bands) of values over `rows` MinHash numbers each, the band's number from `first` on in the lowest bits."""
    h, starts = _hashes(lines, width)
    h = (h >> np.uint64(32)).astype(np.uint32)
    out, own = np.zeros((len(seeds) // rows, len(lines)), np.uint64), np.empty_like(h)
    for i, (a, b) in enumerate(seeds):
        np.multiply(h, a, out=own)
        own += b
        out[i // rows] = _mixed(out[i // rows] ^ np.minimum.reduceat(own, starts).astype(np.uint64) + np.uint64(i))
    return (out.T & ~np.uint64(63) | np.arange(first, first + len(out), dtype=np.uint64)).view(np.int64)


def line_bands(ids: np.ndarray, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(band, id) of each line: by long shingles, and by short ones if it has under SHORT characters."""
    long = _bands(lines, SHINGLE, _SEEDS, ROWS, 0)
    short = [i for i, x in enumerate(lines) if len(x) < SHORT]
    if not short:
        return long.ravel(), np.repeat(ids, BANDS)
    more = _bands([lines[i] for i in short], SHORT_SHINGLE, _SHORT_SEEDS, SHORT_ROWS, BANDS)
    return np.concatenate([long.ravel(), more.ravel()]), np.concatenate([np.repeat(ids, BANDS), np.repeat(ids[short], SHORT_BANDS)])


def _cut(line: str, width: int) -> set[str]:
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def shingles(line: str) -> tuple[set[str], set[str] | None]:
    """The long shingles, and the short ones of a line under SHORT characters."""
    return _cut(line, SHINGLE), _cut(line, SHORT_SHINGLE) if len(line) < SHORT else None


def similar(a: tuple[set[str], set[str] | None], b: tuple[set[str], set[str] | None]) -> bool:
    """By the long shingles, or by the short ones if both lines have them. What is meant by similar lines; _similar_pairs tells it of many pairs at once."""
    return jaccard_reaches(a[0], b[0], SIMILAR) or (a[1] is not None and b[1] is not None and jaccard_reaches(a[1], b[1], SIMILAR))


def _members(lines: DataFrame) -> DataFrame:
    """(id, line) -> (band, id)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                band, ids = line_bands(part.column(0).to_numpy(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(ids)], ["band", "id"])

    return lines.select("id", "line").mapInArrow(run, "band long, id long")


def _similar_pairs(b: pa.RecordBatch) -> pa.RecordBatch:
    """(src, dst, a, b) -> (src, dst) of the similar ones; not to many rows, as all their shingles are held."""
    ids = np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()])
    _, first, at = np.unique(ids, return_index=True, return_inverse=True)
    lines = pa.concat_arrays([b.column(2), b.column(3)]).take(pa.array(first)).to_pylist()
    x, y = at[: b.num_rows], at[b.num_rows :]
    alike, short = _alike(lines, x, y, SHINGLE), np.array([len(t) < SHORT for t in lines], bool)
    rest = np.flatnonzero(~alike & short[x] & short[y])
    alike[rest] = _alike(lines, x[rest], y[rest], SHORT_SHINGLE)
    return b.select([0, 1]).filter(pa.array(alike))


def _alike(lines: list[str], x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Whether lines x[i] and y[i] are similar by shingles of `width` characters: their hashes leave most other pairs out, shingles decide the rest."""
    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    if not len(used):
        return np.zeros(0, bool)
    h, starts = _hashes([lines[i] for i in used], width)
    alike = may_reach(np.split(h, starts[1:]), at[: len(x)], at[len(x) :], SIMILAR)
    last, cut = -1, set()
    for k in sorted(np.flatnonzero(alike).tolist(), key=y.__getitem__):
        if y[k] != last:
            last, cut = y[k], _cut(lines[y[k]], width)
        alike[k] = jaccard_reaches(_cut(lines[x[k]], width), cut, SIMILAR)
    return alike


def _verified(pairs: DataFrame) -> DataFrame:
    """(src, dst, a, b) with similar texts a and b -> (src, dst); a line is hashed once for STEP pairs."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                yield _similar_pairs(b.slice(at, STEP))

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    h, starts = _hashes(group["line"].tolist(), SHINGLE if group["band"].iat[0] & 63 < BANDS else SHORT_SHINGLE)
    return similar_stars(np.split(h, starts[1:]), group["id"].to_numpy(), SIMILAR)


def _dealt(lines: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """(id, line) -> (part, crowded, bands, ids): members of bands packed by the part of their band; those of hot bands apart, in any part.

    hot: sorted, at most SENT bands. Packed members cost the shuffle two numbers each and no rows.
    """
    sent = lines.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        held, n = [], 0

        def rows():
            band, ids = (np.concatenate([h[i] for h in held]) for i in range(2))
            at = np.minimum(np.searchsorted(sent.value, band), max(0, len(sent.value) - 1))
            crowded = sent.value[at] == band if len(sent.value) else np.zeros(len(band), bool)
            part = ((band >> 6) % parts).astype(np.int32)
            part[crowded] = np.arange(crowded.sum()) // STEP % parts
            by = np.argsort(part.astype(np.int64) << 1 | crowded, kind="stable")
            band, ids, part, crowded = band[by], ids[by], part[by], crowded[by]
            cuts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (crowded[1:] != crowded[:-1]), [True]]))
            at = pa.array(cuts.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (band, ids)]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(crowded[cuts[:-1]]), *lists], ["part", "crowded", "bands", "ids"])

        for b in batches:
            for at in range(0, b.num_rows, STEP):
                p = b.slice(at, STEP)
                held.append(line_bands(p.column(0).to_numpy(), p.column(1).to_pylist()))
                n += len(held[-1][0])
                if n >= PART:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()

    return lines.select("id", "line").mapInArrow(run, "part int, crowded boolean, bands array<long>, ids array<long>")


def _met(dealt: DataFrame, partitions: int) -> DataFrame:
    """dealt members -> (src, dst, null) for every pair of a band with few ids, once for each band, and (id, null, band) for members of others."""

    def out(src, dst, band) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) if len(x) else pa.nulls(max(map(len, (src, dst, band))), pa.int64()) for x in (src, dst, band)], ["src", "dst", "band"])

    def pairs(held):
        band, ids = (np.concatenate([h[i] for h in held]) for i in range(2))
        by = np.argsort(band)
        band, ids = band[by], ids[by]
        cuts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
        size = np.diff(cuts)
        crowd = np.repeat(size >= CROWD, size)
        if crowd.any():
            yield out(ids[crowd], (), band[crowd])
        keep = np.repeat((size > 1) & (size < CROWD), size)
        band, ids = band[keep], ids[keep]
        for step in range(1, CROWD):  # the pairs that lie `step` rows apart
            same = np.flatnonzero(band[step:] == band[:-step])
            if not len(same):
                break
            yield out(np.minimum(ids[same], ids[same + step]), np.maximum(ids[same], ids[same + step]), ())

    def run(batches):
        held, now = [], None
        for b in batches:
            for k in range(b.num_rows):
                part, crowded = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                band, ids = (b.column(i)[k].values.to_numpy() for i in (2, 3))
                if crowded:
                    yield out(ids, (), band)
                    continue
                if part != now and held:
                    yield from pairs(held)
                    held = []
                now = part
                held.append((band, ids))
        if held:
            yield from pairs(held)

    return dealt.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(run, "src long, dst long, band long")


def line_links(lines: DataFrame) -> DataFrame:
    """lines (id, line), each text once -> (src, dst): links enough to connect all lines that similar ones connect.

    Bands that many lines share are found through one line in SAMPLE, the SENT largest at most, so that no task is handed
    all their members; all bands of CROWD lines or more are compared tile by tile, the pairs of the others are made by one
    sort. Both ways verify texts, and the look at the sample changes no link.
    """
    spark = lines.sparkSession
    seen = _members(lines.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).groupBy("band").agg(F.count("*").alias("n"))
    hot = seen.where(F.col("n") >= MANY).orderBy(F.desc("n"), "band").limit(SENT).select("band")
    hot = np.sort(hot.toArrow().column("band").to_numpy())  # at most SENT numbers
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = int(max(4 * partitions, lines.count() * 20 // PART + 1))
    met = stored(_met(_dealt(lines, hot, parts), partitions), "line-meetings")
    near, large = met.where("band IS NULL").select("src", "dst").distinct(), met.where("band IS NOT NULL").select("band", F.col("src").alias("id"))
    needed = stored(met.select(F.col("src").alias("id")).union(met.where("dst IS NOT NULL").select("dst")).distinct(), "line-needed")
    texts = stored(lines.select("id", "line").join(sent_if_small(needed, SENT), "id", "left_semi"), "line-texts", "zstd")
    pairs = near.join(texts.select(F.col("id").alias("src"), F.col("line").alias("a")), "src").join(texts.select(F.col("id").alias("dst"), F.col("line").alias("b")), "dst")
    sizes = large.groupBy("band").agg(F.count("*").alias("_n"))
    dealt = tiles(large.join(sizes, "band"), ["band"], "id").join(texts, "id").groupBy("band", "_i", "_j").applyInPandas(_tile, "src long, dst long")
    return _verified(pairs).unionByName(dealt)


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) for each line with a word."""
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(WHITE)) != "")


def _twice_hashed(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def removed_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, removed: array of line numbers from 0), for documents that lose a line.

    Of each component of similar lines, the one that comes first by doc_id and number stays. Texts are split at newlines;
    lines without a word are neither compared nor removed. In crowded bands shingles are compared by 64-bit hashes. Equal lines are one node, with their least document, before any
    comparison; they are found again by two 64-bit hashes.
    """
    places = _places(docs)
    lines = places.groupBy("line").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    lines = stored(lines.select(F.monotonically_increasing_id().alias("id"), "line", *_twice_hashed(F.col("line")), "first", "n"), "lines", "zstd")
    found = components(line_links(lines))
    own = lines.select("id", "h1", "h2", "first", "n").join(found, lines.id == found.node, "left")
    own = stored(own.where("n > 1 OR component IS NOT NULL").select("h1", "h2", "first", F.coalesce("component", "id").alias("component")), "line-components")
    stays = own.groupBy("component").agg(F.min("first").alias("stays"))
    judged = sent_if_small(stored(own.join(stays, "component").select("h1", "h2", "component", "stays"), "lines-judged"), SENT // 5)
    met = places.select("doc_id", "line_no", *_twice_hashed(F.col("line"))).join(judged, ["h1", "h2"])
    here = F.sort_array(F.collect_set(F.struct("component", "line_no", (F.col("doc_id") == F.col("stays")).alias("stays"))))
    # A line goes if its component stays in another document, or earlier in this one.
    gone = F.filter("here", lambda x, i: ~x.stays | F.coalesce(F.get("here", i - 1).component == x.component, F.lit(False)))
    out = met.groupBy("doc_id").agg(here.alias("here")).select("doc_id", F.array_sort(F.transform(gone, lambda x: x.line_no)).alias("removed"))
    return out.where(F.size("removed") > 0)


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_lines, n_removed, removed), a row for each row.

    n_lines counts lines with a word. Rows with a null doc_id or text take no part and lose nothing; rows that repeat a
    doc_id are one document. Other columns are not read. No row: no row.
    """
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")).cast("long")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return (
        docs.select(F.col("doc_id").cast("long"), count.alias("n_lines"))
        .join(removed_lines(docs), "doc_id", "left")
        .select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the removed lines cut out of `text` and `n_chars` (if there is one) counted anew; same columns, every row stays."""
    gone = removed_lines(docs).withColumnRenamed("doc_id", "_of")

    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        def rest(text, lines):
            drop = set(lines)
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

        return pd.Series([t if t is None or r is None else rest(t, r) for t, r in zip(texts, removed, strict=True)], dtype=object)

    rows = whole(docs, F.col("doc_id").cast("long").alias("_id")).join(gone, F.col("_id") == F.col("_of"), "left")
    rows = rows.withColumn("_kept", F.when(F.col("removed").isNull(), F.col("_row.text")).otherwise(F.pandas_udf(cut, "string")("_row.text", "removed")))
    old = lambda c: F.col(f"_row.`{c}`")
    new = {"text": F.col("_kept"), "n_chars": F.when(F.col("removed").isNull(), old("n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("_kept"))}
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else old(c)).alias(c) for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_line_dedup": op2}
