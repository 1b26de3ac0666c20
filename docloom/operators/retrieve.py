"""Exact cosine top-k for one query vector, and for a table of them."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_doubles, cosine
from . import rewrite

#: Queries that are sent to every task at once; rows that a task holds and groups around pivots; rows that one bound covers.
QUERIES_AT_ONCE, HELD, GROUP = 8192, 16_384, 128
#: Pivots, at most one for each QUERIES_A_PIVOT queries; rows that give pivots and first thresholds; the share of rows that a
#: deeper level looks at first.
PIVOTS, QUERIES_A_PIVOT, SEEDS, LEVEL = 256, 4, 1024, 64
#: Queries that are scored against a group in one product.
STEP = 256
#: Queries up to which rows are read once only, without a look at some of them for thresholds.
FEW = 64
#: Hits up to which they are sent to every task of a join, so that what they are joined with isn't shuffled.
SENT = 100_000
#: What rounding may take from a bound or a threshold.
SLACK = 1e-9


def searchable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a vector that isn't null or empty."""
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def top_k(rows: DataFrame, query: Sequence[float], k: int, order: str, vector: str = "embedding") -> DataFrame:
    """rows with `similarity`, the k best: similarity descending, then `order`. Zero vectors and other widths aren't hits."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = searchable(rows, vector).withColumn("similarity", cosine(as_doubles(F.col(vector)), q)).where("similarity IS NOT NULL")
    return scored.orderBy(F.desc("similarity"), order).limit(k)


def _matrix(vectors: pa.Array, ids: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors as a matrix, norms) of the vectors of a width with a norm that isn't zero or NaN; a null within a vector is NaN."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == width)
    m = flat[(np.cumsum(size) - size)[at][:, None] + np.arange(width)].astype(np.float64)
    norms = np.sqrt((m * m).sum(axis=1))
    good = np.isfinite(norms) & (norms > 0)
    return ids.to_numpy()[at][good], m[good], norms[good]


class _Asked:
    """Queries of one width: matrix, norms, ids, thresholds, and the pivots with their angles to each query."""

    def __init__(self, width: int, ids, m, norms, seeds: np.ndarray, least: np.ndarray):
        self.width, self.ids, self.m, self.norms, self.least = width, ids, m, norms, least
        self.pivots = seeds[: min(PIVOTS, len(ids) // QUERIES_A_PIVOT)]
        unit = self.m / self.norms[:, None]
        self.angles = np.arccos(np.clip(unit @ self.pivots.T, -1, 1)) if len(self.pivots) else None


def _scores(asked: _Asked, which: np.ndarray, m: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (asked.m[which] @ m.T) / (asked.norms[which][:, None] * norms)


def _kth(sim: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row, -inf where there are fewer."""
    if k < 1 or sim.shape[1] < k:
        return np.full(len(sim), -np.inf)
    return np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]


def _bounds(asked: _Asked, pivot: int, low: float, high: float) -> np.ndarray:
    """For each query the most that its cosine with a row can be whose angle to the pivot lies between low and high.

    Angles on the sphere keep the triangle inequality, so such a row is at least as far from the query as the query's own angle
    to the pivot lies outside of that range.
    """
    own = asked.angles[:, pivot]
    return np.cos(np.maximum(0, np.maximum(low - own, own - high)))


class _Best:
    """The best rows of each query that a task has seen, and the thresholds that they give."""

    def __init__(self, asked: _Asked, k: int):
        self.asked, self.k, self.least = asked, k, asked.least.copy()
        self.found = [[] for _ in asked.ids]  # (similarity, id), at most a few times k
        self.scored = self.rows = 0

    def add(self, ids: np.ndarray, m: np.ndarray, norms: np.ndarray) -> None:
        """Groups rows around their nearest pivots, and scores a group for the queries that may have a hit in it."""
        self.rows += len(ids) * len(self.asked.ids)
        if self.asked.angles is None:
            self._score(np.arange(len(self.asked.ids)), ids, m, norms)
            return
        near = (m / norms[:, None]) @ self.asked.pivots.T
        pivot = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(ids)), pivot], -1, 1))
        order = np.lexsort((angle, pivot))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(pivot[order]) != 0, [True]]))
        groups = [order[a : min(a + GROUP, end)] for start, end in zip(cuts[:-1], cuts[1:], strict=True) for a in range(start, end, GROUP)]
        bounds = np.array([_bounds(self.asked, pivot[g[0]], angle[g[0]], angle[g[-1]]) for g in groups])
        for k in np.argsort(-bounds.mean(axis=1)):  # near groups first: they raise the thresholds
            which = np.flatnonzero(bounds[k] >= self.least - SLACK)
            if len(which):
                self._score(which, ids[groups[k]], m[groups[k]], norms[groups[k]])

    def _score(self, which: np.ndarray, ids: np.ndarray, m: np.ndarray, norms: np.ndarray) -> None:
        for s in range(0, len(which), STEP):
            some = which[s : s + STEP]
            sim = _scores(self.asked, some, m, norms)
            self.scored += sim.size
            new = np.isneginf(self.least[some])
            if new.any():
                self.least[some[new]] = _kth(sim[new], self.k) - SLACK
            hit = sim >= self.least[some][:, None] - SLACK
            for q, row in zip(some[hit.any(axis=1)].tolist(), np.flatnonzero(hit.any(axis=1)), strict=True):
                good = np.flatnonzero(hit[row])
                best = sorted([*self.found[q], *zip((-sim[row, good]).tolist(), ids[good].tolist(), strict=True)])[: self.k]
                self.found[q] = best
                if len(best) == self.k:
                    self.least[q] = max(self.least[q], -best[-1][0])

    def table(self) -> pa.RecordBatch:
        flat = [(int(self.asked.ids[q]), i, -s) for q, best in enumerate(self.found) for s, i in best if -s >= self.least[q] - SLACK]
        kinds = {"query_id": pa.int64(), "id": pa.int64(), "similarity": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], kind) for j, kind in enumerate(kinds.values())], list(kinds))


def _scan(rows: DataFrame, asked: list[_Asked], k: int, counting: bool = False) -> DataFrame:
    """(query_id, id, similarity): each task's best rows; with `counting` (scored, pairs) of each task instead."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        best = {a.width: _Best(a, k) for a in sent.value}
        held, n = [], 0

        def add():
            table = pa.Table.from_batches(held).combine_chunks()
            for width, b in best.items():
                ids, m, norms = _matrix(table.column("vector").chunk(0), table.column("id").chunk(0), width)
                if len(ids):
                    b.add(ids, m, norms)

        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                held.append(batch.slice(at, HELD))
                n += held[-1].num_rows
                if n >= HELD:
                    add()
                    held, n = [], 0
        if n:
            add()
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array([b.scored]), pa.array([b.rows])], ["scored", "pairs"]) if counting else b.table()

    return rows.mapInArrow(run, "scored long, pairs long" if counting else "query_id long, id long, similarity double")


def _asked_of(queries: pa.Table, rows: DataFrame | None, k: int) -> list[_Asked]:
    """The queries by width, with pivots and first thresholds from SEEDS rows of each width, whichever have the least hash; without rows neither."""
    column = queries.column("vector").combine_chunks() if queries.num_rows else None
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    out = []
    for width in sorted(set(column.value_lengths().to_pylist())) if queries.num_rows else []:
        ids, m, norms = _matrix(column, queries.column("query_id").combine_chunks(), width)
        if not len(ids):
            continue
        if rows is None:
            out.append(_Asked(width, ids, m, norms, np.empty((0, width)), np.full(len(ids), -np.inf)))
            continue
        seeds = rows.where(F.size("vector") == width).orderBy(F.xxhash64("id"), "id").limit(SEEDS).toArrow().combine_chunks()
        if not seeds.num_rows:
            continue
        _, s, lengths = _matrix(seeds.column("vector").chunk(0), seeds.column("id").chunk(0), width)
        own = _Asked(width, ids, m, norms, s / lengths[:, None], np.full(len(ids), -np.inf))
        for at in range(0, len(ids), STEP):
            which = np.arange(at, min(at + STEP, len(ids)))
            own.least[which] = _kth(_scores(own, which, s, lengths), k) - SLACK
        out.append(own)
    return out


def _raised(asked: list[_Asked], found: DataFrame, k: int) -> None:
    """Thresholds from what a look at some of the rows has found: a number for each query of this block."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    last = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("query_id", "similarity").toArrow()
    least = dict(zip(last.column(0).to_pylist(), last.column(1).to_pylist(), strict=True))
    for a in asked:
        a.least = np.array([max(x, least.get(q, -np.inf) - SLACK) for x, q in zip(a.least.tolist(), a.ids.tolist(), strict=True)])


def _vectors(df: DataFrame, key: str) -> DataFrame:
    return searchable(df, "vector").select(F.col(key).cast("long").alias(key), as_doubles(F.col("vector")).alias("vector"))


def _blocks(queries: DataFrame):
    """The queries as tables of QUERIES_AT_ONCE rows or so, each with whether it is all of them and they are FEW at most."""
    some = queries.limit(QUERIES_AT_ONCE + 1).toArrow()
    if some.num_rows <= QUERIES_AT_ONCE:
        yield some, some.num_rows <= FEW
        return
    blocks = queries.count() // QUERIES_AT_ONCE + 1
    for b in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow(), False


def _levels(rows: DataFrame):
    """Growing shares of the rows to look at before all of them, so that each finds thresholds for the next."""
    n, level = rows.count(), 1
    while n // level > SEEDS * LEVEL:
        level *= LEVEL
    while level > 1:
        yield rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(level)) == 0)
        level //= LEVEL


def _ready(rows: DataFrame, queries: DataFrame, k: int):
    """(queries of a block, how many); with pivots and thresholds, unless the queries are few."""
    for block, few in _blocks(queries):
        asked = _asked_of(block, None if few else rows, k)
        for some in _levels(rows) if asked and not few else ():
            _raised(asked, _scan(some, asked, k), k)
        yield asked, block.num_rows


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows (id, vector), queries (query_id, vector) -> (query_id, id, similarity, rank), the k best rows of each query.

    Rows stay where they are read; queries go out, QUERIES_AT_ONCE at a time. A task groups the rows it holds around
    pivots and leaves out the groups whose angles can't reach a query's threshold; thresholds start from a few rows, are raised by
    a look at a share of the rows where there are many, and rise while a task goes on. What a task hands over lies above them,
    so the rows to merge grow with the queries, not with the rows. For up to FEW queries rows are read once and scored
    without such looks; a task then hands over k rows a query, ties aside. For more queries rows are read several times: those that are
    costly to make, as by an embedder, belong in a store first. Up to SENT hits carry the hint to be broadcast. Exact; ties are in order of id. Rows of the
    query's own id count like any other. Null, empty and zero vectors and other widths give no hit; k below 1 none.
    """
    rows, queries, n = _vectors(rows, "id"), _vectors(queries, "query_id"), 0
    found = rows.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
    for asked, block in _ready(rows, queries, k) if k > 0 else []:
        n += block
        if asked:
            found = found.unionByName(_scan(rows, asked, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    best = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return F.broadcast(best) if n * k <= SENT else best


def scored_share(rows: DataFrame, queries: DataFrame, k: int) -> float:
    """The share of all pairs of a row and a query that top_k_batch scores."""
    rows, scored, pairs = _vectors(rows, "id"), 0, 0
    for asked, _ in _ready(rows, _vectors(queries, "query_id"), k):
        for r in _scan(rows, asked, k, counting=True).collect() if asked else []:
            scored, pairs = scored + r.scored, pairs + r.pairs
    return scored / pairs if pairs else 0.0


def search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """chunks (id, content, metadata, vector), queries (query_id, vector) -> (query_id, rank, content, score, metadata).

    Vectors are precomputed columns (operators.embed makes them from texts). A query without a vector has no hits.
    """
    found = top_k_batch(chunks, queries, k).join(chunks.select("id", "content", "metadata"), "id")
    return found.select("query_id", "rank", "content", F.col("similarity").alias("score"), "metadata")


def with_query_for_search(requests: DataFrame, synonyms: DataFrame, message: str = "message") -> DataFrame:
    """requests with `query_for_search`: the rewritten message, which retrieval uses; the message itself goes on to the model as it is."""
    return rewrite.expand_synonyms(requests, synonyms, message).withColumnRenamed("expanded", "query_for_search")
