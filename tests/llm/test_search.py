import collections
import math
import random

import numpy as np
import pyarrow.parquet as pq

from docloom.llm import search


def brute(rows, asked, top):
    docs = {i: collections.Counter((t or "").lower().encode().split()) for i, t in rows if i is not None}
    n, mean = len(docs), max(1.0, sum(sum(c.values()) for c in docs.values()) / max(1, len(docs)))
    df = collections.Counter(w for c in docs.values() for w in c)
    out = {}
    for q, t in asked:
        scores = []
        for i, c in docs.items():
            dl, s = sum(c.values()), 0.0
            for w, k in collections.Counter((t or "").lower().encode().split()).items():
                if c[w]:
                    s += k * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + search.K1 * (1 - search.B + search.B * dl / mean))
            if s > 0:
                scores.append((-round(s, search.DIGITS), i))
        out.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(scores)[:top])})
    return out


def test_equals_brute_force_over_several_shards(make, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 800)
    monkeypatch.setattr(search, "QUERY_TERMS", 60)
    monkeypatch.setattr(search, "TOGETHER", 3)
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 120])))) for i in range(200)]
    rows += [(300 + i, rows[3][1]) for i in range(9)] + [(400, None), (401, ""), (402, "UPPER W1"), (None, "w1")]
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.bm25_top(make(rows), make(asked), 5).collect()}
    want = brute(rows, asked, 5)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=2e-6) for k in want)


def folder_index(folder):
    """One Index over all documents of a folder, in shards of the registered size."""
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).combine_chunks()
    own, term, count = search._words(rows.column(1).chunk(0))
    shard = search._shard([(rows.column(0).to_numpy(), own, term, count)])
    flat = [shard.column(i).values.to_numpy() for i in (0, 1, 3, 4)]
    doc, n = (np.frombuffer(shard.column(i)[0].as_py(), t) for i, t in ((5, "<u2"), (6, "<u4")))
    index = search.Index(flat[0], flat[1], flat[2], flat[3].astype(np.int64), doc, n, count.sum() / len(rows))
    return index, own, np.searchsorted(flat[2], term), count


def test_pruning_skips_blocks_and_keeps_results(monkeypatch):
    """With the threshold that a first look gives, 20 of the documents as queries: the same results from under nine tenths of the blocks."""
    index, own, at, count = folder_index("/root/testdata/sf0.01")
    weight = count * np.log(1 + (len(index.ids) - index.df[at] + 0.5) / (index.df[at] + 0.5))
    asked = np.flatnonzero(own % 50 == 0)
    n = int(own[asked].max() // 50) + 1
    first, second = search.Best(n, 10), search.Best(n, 10)
    first.add(0, *index.search(own[asked] // 50, at[asked], weight[asked], np.zeros(n)))
    index.read = index.all = 0
    second.add(0, *index.search(own[asked] // 50, at[asked], weight[asked], first.scores[:, -1]))
    assert (first.ids == second.ids).all() and (first.scores == second.scores).all()
    share = index.read / index.all
    print(f"blocks whose long lists were read: {share:.2f}")
    assert share < 0.9


def test_long_lists_are_kept_by_tile():
    """a tile's matrix has only the lists that are long there, much less than one matrix over the whole shard."""
    index = folder_index("/root/testdata/sf0.01")[0]
    cells, terms = sum(t[2].size for t in index.tiles), len(np.unique(np.concatenate([t[1] for t in index.tiles])))
    print(f"cells of the tiles, and of one matrix: {cells}, {terms * index.width}")
    assert len(index.tiles) > 1 and cells < 0.7 * terms * index.width


def test_tasks_add_up_document_frequencies(make, monkeypatch):
    """a task hands over each term once, not once a shard."""
    monkeypatch.setattr(search, "SHARD", 3)
    docs = make([(i, f"a b w{i}") for i in range(40)]).coalesce(1)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    index = search.shards(docs)
    n, rows = len(index.collect()), [(r.term, r.df) for r in search._frequencies(index).collect()]
    docs.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert n > 1 and len(rows) == len({t for t, _ in rows}) == 42 and sorted(n for _, n in rows)[-2:] == [40, 40]


def test_single_precision_only_bounds(make):
    """Scores that single precision can't tell apart keep their order."""
    words = " ".join(f"w{k}" for k in range(20))
    rows = [(i, " ".join([words] * 1000 + ["x"] * (11 - i))) for i in range(12)]
    asked = [(100, " ".join([words] * 1000))]
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.bm25_top(make(rows), make(asked)).collect()}
    want = brute(rows, asked, 10)
    assert [got[k][0] for k in sorted(got)] == [want[k][0] for k in sorted(want)]
    assert len({np.float32(s) for _, s in want.values()}) < len({s for _, s in want.values()})
    assert all(math.isclose(got[k][1], want[k][1], abs_tol=2e-6) for k in want)


def test_empty_tables(make):
    docs = make([(1, "a b"), (2, None)])
    assert search.bm25_top(docs.limit(0), docs).count() == 0
    assert search.bm25_top(docs, docs.limit(0)).count() == 0
    assert [(r.query_id, r.doc_id) for r in search.bm25_top(docs, docs).collect()] == [(1, 1)]


def test_sql(same_as_sql):
    for name, sql in search.ORACLES.items():
        same_as_sql(search.QUERIES[name], sql)
