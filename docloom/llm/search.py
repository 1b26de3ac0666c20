"""Exact top-k search: an inverted index per shard with block-max WAND pruning for BM25, merged under global statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K1, B, TOP = 1.2, 0.75, 10
#: Words of the texts in a shard, about, and documents at most; documents of a block; texts or hits that are taken at once, and bytes of texts.
SHARD, SHARD_DOCS, BLOCK, STEP, STEP_BYTES = 1 << 22, 1 << 16, 64, 4096, 1 << 23
#: A term's list is long in a tile of TILE blocks if every LONG-th document there has it. Long lists are columns of the tile's matrix, up to
#: CELLS cells in all, the longest ones first. It only decides how a list is read.
TILE, LONG, CELLS = 8, 12, 1 << 23
#: Distinct words of the queries that are sent to every task at once (16 bytes each); further queries wait for the next pass.
QUERY_TERMS = 1 << 22
#: Terms with their counts that a task adds up before it hands them over.
HELD_TERMS = 1 << 22
#: Queries that are scored together.
TOGETHER = 256
#: What impacts, which lie below 4, are multiplied by, so that with its document a posting is one number; 14 digits stay.
FIXED = float(1 << 45)
#: Scores are compared after rounding to this many digits, ties by id.
DIGITS = 6
SLACK = 10.0**-DIGITS
#: Twice what a step of a sum in single precision may lose, as a share of it.
EPSILON = 2.0**-23


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number of each distinct word of a text, the word's hash, its count) over lower-case words of whole texts."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    own, flat = pc.list_parent_indices(lists), lists.flatten()
    real = pc.not_equal(flat, "")
    code = flat.filter(real).dictionary_encode()
    own = own.filter(real).to_numpy()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, code.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(code.dictionary))
    hashes = (hashes ^ np.uint64(1 << 63)).view(np.int64)
    n = max(1, len(hashes))
    pair, count = np.unique(own.astype(np.int64) * n + code.indices.to_numpy(), return_counts=True)
    return pair // n, hashes[pair % n] if len(hashes) else pair, count


def _steps(b: pa.RecordBatch):
    """A batch of (id, text) in slices of STEP texts or some STEP_BYTES at most, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right"))
        to = max(at + 1, min(to, at + STEP))
        yield b.slice(at, to - at)
        at = to


def _id_text(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def term_rows(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs -> (id, terms, counts); rows with a null id are left out, null texts have no terms."""

    def run(batches):
        for b in batches:
            for p in _steps(b):
                own, term, count = _words(p.column(1))
                cuts = pa.array(np.searchsorted(own, np.arange(p.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (term, count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([p.column(0), *lists], ["id", "terms", "counts"])

    return _id_text(docs, id_column).mapInArrow(run, "id long, terms array<long>, counts array<int>")


def shards(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs -> one row per shard: its postings, by term and then document, ready to be stored.

    A shard holds neighbouring rows of one task, so nothing is shuffled. Its documents are put in order of their most
    frequent and their least term, so that a block holds documents of one language, copies lie together, and block
    maxima stay low for most queries. Counts and lengths are kept rather than impacts, which need the whole table's mean.
    """

    def run(batches):
        parts, docs, words = [], 0, 0
        for b in batches:
            for p in _steps(b):
                own, term, count = _words(p.column(1))
                parts.append((p.column(0).to_numpy(), (own + docs).astype(np.int32), term, count.astype(np.int32)))
                docs, words = docs + p.num_rows, words + int(count.sum())
                if words >= SHARD or docs > SHARD_DOCS - STEP:
                    yield _shard(parts)
                    parts, docs, words = [], 0, 0
        if docs:
            yield _shard(parts)

    schema = "ids array<long>, lengths array<int>, words long, vocabulary array<long>, df array<int>, doc binary, count binary"
    return _id_text(docs, id_column).mapInArrow(run, schema)


def _shard(parts: list[tuple]) -> pa.RecordBatch:
    ids, own, term, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()  # their memory is needed below
    vocabulary, term = np.unique(term, return_inverse=True)
    size = np.bincount(own, minlength=len(ids))
    full = size > 0
    starts = (np.cumsum(size) - size)[full]
    top, low = np.full(len(ids), -1), np.full(len(ids), -1)
    if len(starts):
        top[full] = np.maximum.reduceat(np.minimum(count * np.bincount(term)[term], 0x7FFFFFFF) << 32 | term, starts) & 0xFFFFFFFF
        low[full] = np.minimum.reduceat(term, starts)
    order = np.lexsort((ids, low, top))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    lengths = np.bincount(own, count, len(ids)).astype(np.int32)[order]
    df = np.bincount(term, minlength=len(vocabulary)).astype(np.int32)
    term <<= 20
    term |= place[own]
    by = np.argsort(term)
    columns = [
        pa.array([ids[order]], pa.list_(pa.int64())),
        pa.array([lengths], pa.list_(pa.int32())),
        pa.array([int(count.sum())], pa.int64()),
        pa.array([vocabulary], pa.list_(pa.int64())),
        pa.array([df], pa.list_(pa.int32())),
        pa.array([place[own][by].astype("<u2").tobytes()], pa.binary()),
        pa.array([count[by].astype("<u4").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "words", "vocabulary", "df", "doc", "count"])


def _lower(bound: np.ndarray, more: float) -> np.ndarray:
    """What scores are at least that were bounded by `bound`, less than what rounding may tell apart."""
    return bound / more**2 - 2 * SLACK


class Index:
    """A shard, ready for search: TILE blocks at a time the lists that are long there as columns of a matrix, all else as postings.

    Neighbouring documents are of one language, so a tile has few long lists and they hold most of a score; they are multiplied in
    single precision, which only bounds a score, and what may be a hit is added up again in double precision.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray, df: np.ndarray, doc: np.ndarray, count: np.ndarray, mean: float):
        self.ids, self.vocabulary, self.df = ids, vocabulary, df
        self.width = max(1, -(-len(ids) // BLOCK)) * BLOCK
        each, doc = TILE * BLOCK, doc.astype(np.int64)
        impact = count * (K1 + 1) / (count + (K1 * (1 - B + B * lengths / mean))[doc])
        term, tile = np.repeat(np.arange(len(df)), df), doc // each
        cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tile[1:] != tile[:-1])]))  # a list's part in a tile
        size = np.diff(np.append(cut, len(term)))
        long = np.flatnonzero(size * LONG >= np.minimum(each, len(ids) - tile[cut] * each))
        long = long[np.argsort(-size[long], kind="stable")][: CELLS // each]
        dense = np.zeros(len(size), bool)
        dense[long] = True
        dense = np.repeat(dense, size)
        self.size = np.bincount(term[~dense], minlength=len(df))
        self.at, self.postings = np.cumsum(self.size) - self.size, np.rint(impact[~dense] * FIXED).astype(np.int64) << 16 | doc[~dense]
        #: A term's row in the queries' matrix, and (first document, rows of its terms, matrix, the same in single precision, maxima of blocks) of each tile.
        self.row, self.tiles = np.full(len(df), -1), []
        longs = np.unique(term[dense])
        self.row[longs] = np.arange(len(longs))
        row, doc, impact = self.row[term[dense]], doc[dense], impact[dense]
        order = np.argsort(doc // each, kind="stable")
        row, doc, impact = row[order], doc[order], impact[order]
        for first in range(0, self.width, each):
            own = slice(*np.searchsorted(doc // each, [first // each, first // each + 1]))
            rows, column = np.unique(row[own], return_inverse=True)
            matrix = np.zeros((min(each, self.width - first), len(rows)))
            matrix[doc[own] - first, column] = impact[own]
            single = matrix.astype(np.float32)
            self.tiles.append((first, rows, matrix, single, single.reshape(len(single) // BLOCK, BLOCK, len(rows)).max(axis=1)))
        self.asked, self.single, self.score = np.zeros((TOGETHER, len(longs))), np.zeros((len(longs), TOGETHER), np.float32), np.zeros((TOGETHER, self.width))
        #: Blocks whose long lists were read, and all, over the queries so far.
        self.read, self.all = 0, 0

    def search(self, query: np.ndarray, at: np.ndarray, weights: np.ndarray, least: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score), by query: documents that can be among a query's best `top`, given that a score below `least` (one per query) can't be.

        query, at, weights: the queries' terms as places in the vocabulary. The short lists are read; with the block maxima
        of a tile's long ones they bound what a document of a block can score. The pivot lies behind the last list that can be
        left out: a tile in which no block's bound reaches the threshold is skipped before its long lists are opened, the
        others are scored in full. Where a tile gives `top` documents, they raise the threshold for the next ones.
        """
        found = [self._search(query[a:b], at[a:b], weights[a:b], first, least[first : first + TOGETHER], top) for first, a, b in self._parts(query, len(least))]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _parts(self, query: np.ndarray, n: int):
        cuts = np.searchsorted(query, np.arange(0, n + TOGETHER, TOGETHER))
        return zip(range(0, n, TOGETHER), cuts[:-1].tolist(), cuts[1:].tolist())

    def _search(self, query: np.ndarray, at: np.ndarray, weights: np.ndarray, base: int, least: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, query, row = len(least), query - base, self.row[at]
        long = row >= 0
        own, score = (query[long], row[long]), self._short(query, at, weights, n)
        self.asked[own] = self.single[own[::-1]] = weights[long]
        single = self.single[:, :n]
        peak = np.maximum.reduceat(score.ravel(), np.arange(0, score.size, BLOCK)).reshape(n, -1)
        reach, found = np.maximum(least - SLACK, 1e-300), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for first, rows, _, matrix, most in self.tiles:
            w, more = single[rows], 1 + EPSILON * (len(rows) + 8)
            opened = peak[:, first // BLOCK : first // BLOCK + len(most)] + (w.T @ most.T) * more >= reach[:, None]
            which = np.flatnonzero(opened.any(axis=1))
            self.read, self.all = self.read + len(which) * len(most), self.all + opened.size
            if not len(which):
                continue
            part = score[which, first : first + len(matrix)]
            part += ((w[:, which] if len(which) < n else w).T @ matrix.T) * np.float32(more)
            some = part.max(axis=1) >= reach[which]
            which, part = which[some], part[some]
            place = np.flatnonzero(part >= reach[which][:, None])
            q, doc = np.divmod(place, part.shape[1])
            found.append((which[q], first + doc, part.ravel()[place]))
            if len(q) > top * len(which) and part.shape[1] >= top:
                reach[which] = np.maximum(reach[which], _lower(np.partition(part, part.shape[1] - top, axis=1)[:, part.shape[1] - top], more))
        q, doc, scores = self._exact(*(np.concatenate(x) for x in zip(*found, strict=True)), reach, top)
        self.asked[own] = self.single[own[::-1]] = 0
        keep = (scores > 0) & (scores >= least[q])
        return q[keep] + base, self.ids[doc[keep]], scores[keep]

    def _exact(self, q: np.ndarray, doc: np.ndarray, most: np.ndarray, reach: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score), by query, of those whose bound `most` reaches what the best `top` of them are sure to have."""
        keep = most >= reach[q]
        q, doc, most = q[keep], doc[keep], most[keep]
        order = np.lexsort((-most, q))
        q, doc, most = q[order], doc[order], most[order]
        last = np.searchsorted(q, np.arange(len(reach))) + top - 1
        full = np.flatnonzero(last < np.searchsorted(q, np.arange(len(reach)), "right"))
        reach[full] = np.maximum(reach[full], _lower(most[last[full]], 1 + EPSILON * (max(len(t[1]) for t in self.tiles) + 8)))
        keep = most >= reach[q]
        q, doc = q[keep], doc[keep]
        scores = self.score[q, doc]
        for first, rows, matrix, *_ in self.tiles:
            own = np.flatnonzero((doc >= first) & (doc < first + len(matrix)))
            for k in range(0, len(own), STEP):
                some = own[k : k + STEP]
                scores[some] += np.einsum("ij,ij->i", matrix[doc[some] - first], self.asked[q[some][:, None], rows])
        return q, doc, np.round(scores, DIGITS)

    def _short(self, query: np.ndarray, at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """What each document scores for each query by postings."""
        size = self.size[at]
        some = np.flatnonzero(size)
        query, at, weights, size = query[some], self.at[at[some]], weights[some] / FIXED, size[some]
        cuts, ends, score = np.searchsorted(query, np.arange(n + 1)).tolist(), np.cumsum(size), self.score[:n]
        score[:] = 0
        at = at - ends + size
        for q, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                place = np.repeat(at[a:b], size[a:b])
                place += np.arange(ends[a] - size[a], ends[b - 1])
                packed, value = self.postings.take(place), np.repeat(weights[a:b], size[a:b])
                value *= np.right_shift(packed, 16, out=place)
                packed &= 0xFFFF
                score[q] = np.bincount(packed, value, self.width)
        return score


class Best:
    """The best `top` of each of n queries so far: score descending, then id ascending."""

    def __init__(self, n: int, top: int):
        self.top, self.ids, self.scores = top, np.zeros((n, top), np.int64), np.zeros((n, top))

    def least(self, part: slice) -> np.ndarray:
        return self.scores[part, -1]

    def add(self, first: int, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            q, s, i = first + row[a], scores[a:b], ids[a:b]
            if b - a > 4 * self.top:
                keep = s >= -np.partition(-s, self.top - 1)[self.top - 1]
                s, i = s[keep], i[keep]
            s, i = np.concatenate([s, self.scores[q]]), np.concatenate([i, self.ids[q]])
            best = np.lexsort((i, -s))[: self.top]
            self.scores[q], self.ids[q] = s[best], i[best]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        q, k = np.nonzero(self.scores > 0)
        return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(self.ids[q, k]), pa.array(self.scores[q, k])], ["query_id", "doc_id", "score"])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _frequencies(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents of some of a task's shards a term occurs."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        term, place = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        return term, np.bincount(place, np.concatenate([n for _, n in held]), len(term)).astype(np.int64)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for k in range(b.num_rows):
                held.append(tuple(b.column(i)[k].values.to_numpy() for i in (0, 1)))
                n += len(held[-1][0])
                if n > HELD_TERMS:
                    held = [added(held)]
                    n = len(held[0][0])
                    if 2 * n > HELD_TERMS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["term", "df"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(held)], ["term", "df"])

    return index.select("vocabulary", "df").coalesce(index.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "term long, df long")


def _asked(docs: DataFrame, queries: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(id, common, terms, weights) of each query with a word that occurs: its most common word; a word's count times its idf over the whole table."""
    own = term_rows(queries).select("id", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    own = own.groupBy("id", F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("count"))
    df = _frequencies(index).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.col("count") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = own.join(df, "term").groupBy("id").agg(F.max_by("term", F.struct(F.col("count") * F.col("df"), "term")).alias("common"), F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("t"))
    return found.select("id", "common", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


def _search(index: DataFrame, asked: pa.Table, mean: float, top: int) -> tuple[DataFrame, object]:
    """(query_id, doc_id, score): the best `top` of each task's shards, and the broadcast to be dropped when they are written."""
    starts = np.concatenate([[0], np.cumsum(asked.column("terms").combine_chunks().value_lengths().to_numpy())]).astype(np.int64)
    terms, code = np.unique(_flat(asked.column("terms")), return_inverse=True)
    sent = index.sparkSession.sparkContext.broadcast((asked.column("id").to_numpy(), starts, terms, code.astype(np.int32), _flat(asked.column("weights"))))

    def run(batches):
        names, starts, terms, code, weights = sent.value
        best = Best(len(names), top)
        for b in batches:
            for k in range(b.num_rows if len(names) else 0):
                ids, lengths, vocabulary, df = (b.column(i)[k].values.to_numpy() for i in range(4))
                doc, count = (np.frombuffer(b.column(i)[k].as_py(), t) for i, t in ((4, "<u2"), (5, "<u4")))
                shard = Index(ids, lengths, vocabulary, df.astype(np.int64), doc, count, mean)
                place = np.full(len(terms) + 1, -1)
                at = np.searchsorted(terms, vocabulary)
                at[terms[np.minimum(at, len(terms) - 1)] != vocabulary] = len(terms)
                place[at] = np.arange(len(vocabulary))
                place[len(terms)] = -1
                for q in range(0, len(names), TOGETHER):
                    to = min(q + TOGETHER, len(names))
                    part = slice(starts[q], starts[to])
                    here = place[code[part]]
                    known = here >= 0
                    query = np.repeat(np.arange(to - q), np.diff(starts[q : to + 1]))[known]
                    best.add(q, *shard.search(query, here[known], weights[part][known], best.least(slice(q, to)), top))
        yield best.rows(names)

    rows = index.select("ids", "lengths", "vocabulary", "df", "doc", "count").where(F.size("vocabulary") > 0)
    return rows.mapInArrow(run, "query_id long, doc_id long, score double"), sent


def bm25_top(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """docs, queries (doc_id, text, ...) -> (query_id, rank, doc_id, score): the best `top` documents of each query, exactly.

    A query is all words of its text, each counted as often as it occurs; query rows of one id are one query. Document
    counts, frequencies and the mean length are those of the whole table, so shards can be merged. The index is built
    once, where the documents are read, and written to the shared folder. Queries go to every task in blocks of bounded
    size; a task goes through its shards with the thresholds it has reached so far, and hands over `top` rows a query.
    Tasks are twice the cluster's cores at most, so that what they hand over grows with the queries alone. Documents
    without a common word aren't results. Null and empty texts have no words; rows with null ids take no part; document
    rows that repeat an id are results of their own. Other columns aren't read. An empty table gives no rows.
    """
    index = stored(shards(docs), "shards", "zstd")
    n, words = index.agg(F.sum(F.size("ids")), F.sum("words")).first()
    n, mean = n or 0, max(1.0, (words or 0) / max(1, n or 0))
    asked = stored(_asked(docs, queries, index, n), "queries")
    passes = (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUERY_TERMS + 1
    index = index.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    found = []
    for k in range(passes):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k).toArrow().sort_by("common")  # bounded by QUERY_TERMS; queries of one language side by side
        if block.num_rows or not (found or k < passes - 1):
            part, sent = _search(index, block, mean, top)
            found.append(stored(part, "found"))
            sent.destroy()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "doc_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25_top(docs, docs.where("doc_id % 50 = 0"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\x20\x09-\x0D]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY ALL),
s AS (SELECT (SELECT count(*) FROM documents) AS n, greatest(1.0, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents)) AS mean),
df AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN s GROUP BY term),
sc AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * ({K1} + 1) / (d.tf + {K1} * (1 - {B} + {B} * dl / mean))), {DIGITS}) AS score
       FROM tf q JOIN tf d ON q.term = d.term JOIN df ON df.term = q.term JOIN dl ON dl.doc_id = d.doc_id CROSS JOIN s
       WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, d.doc_id)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {TOP}"""

QUERIES = {"op1_bm25_search": op1}
ORACLES = {"op1_bm25_search": ORACLE}
