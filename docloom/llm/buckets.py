"""Compares the members of buckets without emitting all pairs of a large bucket."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets are looked at through one member in SAMPLE; those with MANY of them are compared tile by tile, the others joined
#: with themselves. It only decides which way a bucket goes: both ways find the same links.
SAMPLE, MANY = 8, 4
#: Members of a tile's side; a task holds two sides at most.
SIDE = 512


def sized(members: DataFrame, key: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """members by the size of their bucket: (those of small ones, those of large ones with the exact size `_n`)."""
    seen = members.where(F.pmod(F.xxhash64(by), F.lit(SAMPLE)) == 0).groupBy(*key).agg(F.count("*").alias("_n"))
    hot = seen.where(F.col("_n") >= MANY).select(*key)
    large = members.join(hot, key, "left_semi")
    return members.join(hot, key, "left_anti"), large.join(large.groupBy(*key).agg(F.count("*").alias("_n")), key)


def tiles(large: DataFrame, key: list[str], by: str) -> DataFrame:
    """Rows of `large`, each repeated for the tiles it takes part in: `_i <= _j` name the tile, `_side` the row's side.

    Any two members of a bucket meet in exactly one tile of at most about 2 * SIDE rows, so no bucket is gathered whole.
    """
    n = F.ceil(F.col("_n") / SIDE).cast("int")
    own = F.pmod(F.xxhash64(by, F.lit(7)), n).cast("int")
    return (
        large.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
        .select(
            *key,
            *[c for c in large.columns if c not in key],
            F.least("_own", "_other").alias("_i"),
            F.greatest("_own", "_other").alias("_j"),
            "_own",
        )
        .drop("_n")
    )


def stars(linked: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """(src, dst): from each member of a tile to one it is connected with, by the symmetric matrix `linked`; at most one row a member."""
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(linked, label, len(ids)).min(axis=1, initial=len(ids)))
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return pd.DataFrame({"src": ids[own], "dst": ids[label[own]]}, dtype="int64")


#: Bits of a set's bitmap, by which all sets of a tile are told apart at once, and of the longer one that is looked at before a pair's elements.
BITS, FINE = 512, 4096


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the sorted elements of each set without repeats, one set after the other; their numbers; where each set begins); no set is empty."""
    sets = [np.sort(x) for x in sets]
    sets = [x[np.concatenate([[True], x[1:] != x[:-1]])] for x in sets]
    size = np.array([len(x) for x in sets])
    return np.concatenate(sets).astype(np.uint64), size, np.cumsum(size) - size


def _fine(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(sets x FINE / 64): a set's longer bitmap."""
    bits = np.zeros((len(size), FINE), bool)
    bits[np.repeat(np.arange(len(size)), size), (flat & np.uint64(FINE - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits in which bitmaps differ: at most the number of elements in which the sets do."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


#: Elements of which two may have the same hash before a pair is left out wrongly.
SPARE = 4


def may_reach(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets a[i] and b[i] may reach the Jaccard similarity `least`, by hashes of their elements: bitmaps first, then counts.

    sets: as in similar_stars. Equal elements have equal hashes, so a pair that is left out is not similar, even if SPARE pairs of
    different elements share a hash; of those that stay a few aren't.
    """
    flat, size, starts = _distinct(sets)
    bits, n = _fine(flat, size), size[a] + size[b]
    may = _differ(bits[a], bits[b]) <= (n + SPARE) * ((1 - least) / (1 + least))
    may &= np.minimum(size[a], size[b]) + SPARE >= least * np.maximum(size[a], size[b])
    for k in np.flatnonzero(may).tolist():
        x, y = (flat[starts[i] : starts[i] + size[i]] for i in (a[k], b[k]))
        x, y = (x, y) if len(x) < len(y) else (y, x)
        common = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) + SPARE
        may[k] = common >= least * (n[k] + SPARE - common)
    return may


def similar_stars(sets: list[np.ndarray], ids: np.ndarray, least: float) -> pd.DataFrame:
    """(src, dst): from each member of a tile to the first one of its component, by Jaccard similarities of `least` or more.

    sets: numbers that stand for elements, repeats allowed, none empty. Two sets differ in at least as many elements as
    their bitmaps differ in bits, which tells most unrelated ones apart without a look at their elements; large sets fill a
    short bitmap, so a longer one is looked at next. The others are compared exactly, breadth first: those that a set reaches are expanded in turn, and a tile is done as soon as no set
    is left unreached, so copies of one text take a few comparisons each.
    """
    flat, size, starts = _distinct(sets)
    bits = _fine(flat, size)
    signs = np.full((len(sets), BITS), -1, np.float32)
    signs[np.repeat(np.arange(len(sets)), size), (flat & np.uint64(BITS - 1)).astype(np.int64)] = 1
    differ = (BITS - signs @ signs.T) / 2
    may = differ <= (size[:, None] + size) * ((1 - least) / (1 + least)) + 1e-6
    root = np.full(len(sets), -1)
    alone = may.sum(axis=1) == 1  # with itself only
    root[alone] = np.flatnonzero(alone)
    for first in np.flatnonzero(~alone).tolist():
        if root[first] >= 0:
            continue
        root[first], todo = first, [first]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(may[i] & (root < 0))
            near = near[_differ(bits[near], bits[i]) <= (size[near] + size[i]) * ((1 - least) / (1 + least)) + 1e-6]
            if not len(near):
                continue
            n = size[near]
            of = flat[np.arange(n.sum()) + np.repeat(starts[near] - np.cumsum(n) + n, n)]
            own = flat[starts[i] : starts[i] + size[i]]
            hit = own[np.minimum(np.searchsorted(own, of), len(own) - 1)] == of
            common = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            near = near[common >= least * (n + size[i] - common)]
            root[near] = first
            todo += near.tolist()
    moved = root != np.arange(len(sets))
    return pd.DataFrame({"src": ids[moved], "dst": ids[root[moved]]}, dtype="int64")


def jaccard_reaches(a: set, b: set, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)
