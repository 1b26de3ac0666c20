"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import jaccard_reaches, similar_stars, sized, stars, tiles
from .common import sent_if_small, stored, table, whole
from .components import components

#: Shingle length in words, hash seed and distance of the contract.
SHINGLE, SEED, DISTANCE = 3, 42, 3
ROWS = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is in over half the hashes of the shingles, repeats included; no word: zero."""
    found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    if len(found) < shingle:
        parts = [b" ".join(found)]
    else:
        parts = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    n = max(1, len(found) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, ROWS):
        votes += np.unpackbits(h[i : i + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp: long, the 64 bits as a signed number); one row per row, in its task."""

    def batches(it):
        for b in it:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, fp long")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks for which the blocks of a key hold as many bits as n has, so that a key has few members by chance."""
    want = max(16, min(48, n.bit_length() + 2))
    b = distance + 1
    while 64 * (b - distance) // b < want:
        b += 1
    return b


def block_keys(nodes: DataFrame, n_blocks: int, distance: int = DISTANCE) -> DataFrame:
    """Rows of nodes (fp, ...) once for each choice of n_blocks - distance blocks: fingerprints within the distance agree in one choice at least."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    masks = []
    for chosen in combinations(range(n_blocks), n_blocks - distance):
        m = sum(((1 << edges[c + 1]) - 1) ^ ((1 << edges[c]) - 1) for c in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    return nodes.withColumn("_k", F.explode(keys)).select("_k.choice", "_k.bits", *nodes.columns)


def _links(group: pd.DataFrame, distance: int) -> pd.DataFrame:
    """A tile's links as stars."""
    fp = group["fp"].to_numpy().view(np.uint64)
    return stars(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance, group["rep"].to_numpy())


def fingerprint_links(nodes: DataFrame, n_blocks: int, distance: int = DISTANCE) -> DataFrame:
    """nodes (fp, rep), fp unique -> (src, dst) of reps: every pair in small buckets, stars in each tile of large ones."""
    key = ["choice", "bits"]
    small, large = sized(block_keys(nodes, n_blocks, distance), key, "fp")
    a, b = small.select(*key, F.col("fp").alias("fa"), F.col("rep").alias("src")), small.select(*key, F.col("fp").alias("fb"), F.col("rep").alias("dst"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    pairs = a.join(b, (a.choice == b.choice) & (a.bits == b.bits) & (F.col("fa") < F.col("fb")) & near).select("src", "dst")
    forest = tiles(large, key, "fp").groupBy(*key, "_i", "_j").applyInPandas(lambda g: _links(g, distance), "src long, dst long")
    return pairs.unionByName(forest)


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint: 16 hex digits, component_id: least doc_id reachable).

    Equal fingerprints are one node before anything is compared, so exact copies cost nothing beyond a count. Null and
    blank texts have the fingerprint zero and are linked like any other. Rows with a null doc_id keep their fingerprint
    and get a null component. Repeated rows give repeated rows; other columns of docs are not read. No row: no row.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    found = components(fingerprint_links(nodes, blocks_for(nodes.count(), distance), distance))
    node = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(node, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


#: The pipeline's stage: shingles of so many words with this Jaccard similarity decide. Rows up to which ids are sent to every task.
STAGE_SHINGLE, STAGE_SIMILAR, SENT = 5, 0.8, 500_000
#: A pair at that similarity shares a band with probability 1 - (1 - 0.8 ** STAGE_ROWS) ** STAGE_BANDS = 0.9998, a more similar
#: one with more, whether words were changed, appended or cut off.
STAGE_BANDS, STAGE_ROWS = 16, 4
_SEEDS = np.random.default_rng(9).integers(1, 1 << 32, (2, STAGE_BANDS * STAGE_ROWS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_shingles(text: str | None) -> set[bytes]:
    """Shingles of five lower-case words; fewer words: the whole sequence."""
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + STAGE_SHINGLE]) for i in range(max(1, len(found) - STAGE_SHINGLE + 1))}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def stage_numbers(found: list[bytes]) -> tuple[int, np.ndarray]:
    """(fingerprint, STAGE_BANDS band values) of a text's lower-case words, from 64-bit hashes of its shingles.

    The fingerprint is made as op9's is; band values are MinHash, the band's number in the lowest bits.
    """
    h = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
    k = min(STAGE_SHINGLE, len(h))
    n = max(1, len(h) - k + 1)
    shingle = np.zeros(n, np.uint64)
    for i in range(k):
        shingle = _mixed(shingle + h[i : i + n])
    votes, least = np.zeros(64, np.int64), np.full(STAGE_BANDS * STAGE_ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, n, ROWS):
        part = shingle[i : i + ROWS]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part >> np.uint64(32)).astype(np.uint32)[:, None] * _SEEDS[0] + _SEEDS[1]).min(axis=0))
    out = np.zeros(STAGE_BANDS, np.uint64)
    for row in least.reshape(STAGE_BANDS, STAGE_ROWS).T:
        out = _mixed(out ^ row.astype(np.uint64)) + np.uint64(1)
    fp = np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0] if len(found) else 0
    return int(fp), (out & ~np.uint64(15) | np.arange(STAGE_BANDS, dtype=np.uint64)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, fp, bands): two hashes of a text's words, its fingerprint and its band values."""

    def batches(it):
        for b in it:
            keys, fps, bands = [], [], []
            for t in b.column(1):
                found = (t.as_py() or "").encode().lower().split()
                keys.append(np.frombuffer(xxhash.xxh128_digest(b" ".join(found)), np.int64))
                fp, band = stage_numbers(found)
                fps.append(fp)
                bands.append(band)
            t1, t2 = (pa.array([k[i] for k in keys], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), t1, t2, pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, t1 long, t2 long, fp long, bands array<long>")


def _tile(group: pd.DataFrame) -> pd.DataFrame:
    number: dict[bytes, int] = {}
    sets = [np.array([number.setdefault(x, len(number)) for x in word_shingles(t)], np.uint64) for t in group["text"]]
    return similar_stars(sets, group["rep"].to_numpy(), STAGE_SIMILAR)


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, component_id) of rows with a doc_id, by texts rather than fingerprints alone.

    Equal texts (up to case and white space; all without a word are equal) are one node. Nodes meet if their fingerprints
    over five-word shingles lie within DISTANCE, by pigeonhole blocks as in simhash_groups, or if they share a MinHash band
    over those shingles, which finds the pairs of lower similarity that fingerprints miss. Those that meet are linked if
    the shingles have a Jaccard similarity of 0.8 or more.
    """
    texts = stored(_texts(docs.where("doc_id IS NOT NULL")), "near-texts")
    nodes = stored(texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    key = ["band"]
    small, large = sized(nodes.select(F.explode("bands").alias("band"), "rep"), key, "rep")
    large = stored(large, "near-large")
    a, b = small.select("band", F.col("rep").alias("src")), small.select("band", F.col("rep").alias("dst"))
    shared = a.join(b, (a.band == b.band) & (F.col("src") < F.col("dst"))).select("src", "dst")
    prints = stored(nodes.groupBy("fp").agg(F.min("rep").alias("rep")), "near-prints")
    equal = nodes.select("fp", F.col("rep").alias("src")).join(prints.withColumnRenamed("rep", "dst"), "fp").where("src <> dst").select("src", "dst")
    close = fingerprint_links(prints, blocks_for(prints.count())).unionByName(equal).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = stored(shared.unionByName(close).distinct(), "near-pairs")
    needed = stored(pairs.select(F.col("src").alias("doc_id")).union(pairs.select("dst")).union(large.select("rep")).distinct(), "near-needed")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sent_if_small(needed, SENT), "doc_id", "left_semi")
    rows = stored(rows.groupBy("doc_id").agg(F.min("text").alias("text")), "near-compared", "zstd")

    def verify(batches):
        for b in batches:
            keep = [jaccard_reaches(word_shingles(x.as_py()), word_shingles(y.as_py()), STAGE_SIMILAR) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(rows.select(F.col("doc_id").alias("src"), F.col("text").alias("a")), "src").join(rows.select(F.col("doc_id").alias("dst"), F.col("text").alias("b")), "dst")
    links = both.select("src", "dst", "a", "b").mapInArrow(verify, "src long, dst long")
    crowd = tiles(large, key, "rep").join(rows.withColumnRenamed("doc_id", "rep"), "rep").groupBy(*key, "_i", "_j").applyInPandas(_tile, "src long, dst long")
    found = components(links.unionByName(crowd))
    node = nodes.join(found, nodes.rep == found.node, "left").select("t1", "t2", F.coalesce("component", "rep").alias("component_id"))
    return texts.join(node, ["t1", "t2"]).select("doc_id", "component_id")


def keep_first_of_group(docs: DataFrame) -> DataFrame:
    """docs without those whose group has a document with a smaller doc_id; same columns. Rows with a null doc_id stay.

    Rows that repeat a doc_id stay or go together.
    """
    groups = near_duplicate_groups(docs)
    gone = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    rows = whole(docs, F.col("doc_id").cast("long").alias("_id"))
    return rows.join(sent_if_small(gone, SENT), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash_near_dedup": op9}
