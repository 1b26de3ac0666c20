import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import lines
from docloom.llm.lines import shingles, similar


def brute(rows):
    first, places = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, x in enumerate(t.split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                first[x] = min(first.get(x, (i, k)), (i, k))
                places.append((i, k, x))
    texts = list(first)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(x) for x in texts]
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    stays = {}
    for i, x in enumerate(texts):
        stays[find(i)] = min(stays.get(find(i), first[x]), first[x])
    of = {x: stays[find(i)] for i, x in enumerate(texts)}
    gone = collections.defaultdict(set)
    for i, k, x in places:
        if of[x] != (i, k):
            gone[i].add(k)
    return {i: sorted(v) for i, v in gone.items()}


def near_copies(rng, n, length=120, edits=1):
    base = [rng.choice("abcdefghijklmnop ") for _ in range(length)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(edits):
            x[rng.randrange(length)] = rng.choice("xyz")
        out.append("".join(x))
    return out


def test_equals_brute_force(make):
    rng = random.Random(3)
    pool = near_copies(rng, 12) + near_copies(rng, 12, 60) + near_copies(rng, 10, 200, 3) + ["short", "tiny", "a", " ", "", "x" * 5000, "x" * 4990]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7)))) for i in range(60)] + [(70, None), (71, ""), (None, pool[0])]
    docs = make(rows)
    got = {r.doc_id: r for r in lines.line_dedup(docs).collect() if r.doc_id is not None}
    want = brute(rows)
    assert {i: list(r.removed) for i, r in got.items()} == {i: want.get(i, []) for i in got}
    assert got[70].n_lines == 0 and got[71].n_lines == 0 and len(got) == 62


def test_large_bands_are_compared_in_tiles(make, monkeypatch):
    from docloom.llm import buckets

    monkeypatch.setattr(buckets, "SIDE", 16)
    rng = random.Random(4)
    rows = [(i, x) for i, x in enumerate(near_copies(rng, 150, 150))]
    got = {r.doc_id: list(r.removed) for r in lines.line_dedup(make(rows)).collect()}
    assert {i: v for i, v in got.items() if v} == brute(rows)


def test_stage_cuts_lines_and_keeps_rows(make):
    docs = make([(2, "one line here\nsecond line"), (1, "one line here"), (3, "one line here"), (4, None)])
    out = lines.without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("one line here", 13), 2: ("second line", 11), 3: ("", 0), 4: (None, None)}


def test_repeated_rows_and_an_empty_table(make):
    docs = make([(1, "same line"), (1, "same line")])
    assert [(r.n_lines, r.n_removed) for r in lines.line_dedup(docs).collect()] == [(1, 0), (1, 0)]
    assert lines.line_dedup(docs.limit(0)).count() == 0


def shared(a, b):
    """Whether the lines share a band."""
    band, ids = lines.line_bands(np.arange(2), [a, b])
    return bool(np.isin(band[ids == 0], band[ids == 1]).any())


@pytest.mark.parametrize("length, edits", [(100, 1), (200, 1), (350, 2), (420, 2), (1500, 8), (6000, 33)])
def test_bands_find_pairs_at_the_threshold(length, edits):
    """Recall of each kind of numbers, and of lines that take both, for pairs of similarity 0.8 to 0.9."""
    rng = random.Random(5)
    found = total = 0
    for _ in range(250):
        a, b = near_copies(rng, 2, length, edits)
        x, y = shingles(a)[0], shingles(b)[0]
        if similar(shingles(a), shingles(b)) and len(x & y) <= 0.9 * len(x | y):
            total += 1
            found += shared(a, b)
    assert total > 20 and found >= 0.98 * total


def test_a_pair_at_the_threshold_shares_a_band_in_998_of_1000():
    assert 1 - (1 - lines.SIMILAR**lines.ROWS) ** lines.BANDS > 0.998
    assert 1 - (1 - lines.SIMILAR**lines.SHORT_ROWS) ** lines.SHORT_BANDS > 0.998


def test_hot_bands_and_crowded_bands_change_no_link(make, monkeypatch):
    rng = random.Random(9)
    rows = [(i, x) for i, x in enumerate(near_copies(rng, 90, 400, 2))]
    want = brute(rows)
    for crowd, sent, many in ((2, 1000, 1), (64, 1000, 1), (8, 1, 2), (500, 1000, 10**6)):
        monkeypatch.setattr(lines, "CROWD", crowd)
        monkeypatch.setattr(lines, "SENT", sent)
        monkeypatch.setattr(lines, "MANY", many)
        got = {r.doc_id: list(r.removed) for r in lines.line_dedup(make(rows)).collect()}
        assert {i: v for i, v in got.items() if v} == want


def test_names_of_its_own_do_no_harm(make):
    docs = make([(1, "one line here"), (2, "one line here")]).withColumnsRenamed({"b": "_removed", "kept": "_doc_id", "line": "_text", "fp": "_of", "h": "removed"})
    out = lines.without_repeated_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "one line here", 2: ""}


def test_one_edit_links_lines_of_40_to_100_characters(make):
    rng, rows = random.Random(8), []
    for k in range(120):
        x = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(39)] + ["."] * (k % 2) + [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1 + k // 2)]
        y = list(x)
        y[rng.randrange(len(y))] = "Q"
        rows += [(2 * k, "".join(x)), (2 * k + 1, "".join(y))]
    got = {r.doc_id: r.n_removed for r in lines.line_dedup(make(rows)).collect()}
    assert got == {i: i % 2 for i in range(240)}


def _pairs_of(texts, pairs):
    columns = [[i for i, _ in pairs], [j for _, j in pairs], [texts[i] for i, _ in pairs], [texts[j] for _, j in pairs]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *map(pa.array, columns[2:])], ["src", "dst", "a", "b"])


def test_pairs_are_judged_as_by_their_shingles(monkeypatch):
    """Lines of all lengths around the threshold; a line is cut up for few of its pairs, as hashes tell unrelated ones."""
    rng = random.Random(12)
    texts = [x for n in (1, 3, 20, 60, 100, 127, 128, 200, 700, 3000) for x in near_copies(rng, 5, n, 1 + n // 250)] + ["", " ", "a" * 5000, "a" * 40, "ab" * 20, "\U0001f600" * 30, "\ud7ff" * 12]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    rng.shuffle(pairs)
    want = {(i, j) for i, j in pairs if similar(shingles(texts[i]), shingles(texts[j]))}
    cut, n = lines._cut, []
    monkeypatch.setattr(lines, "_cut", lambda *a: n.append(1) or cut(*a))
    got = lines._similar_pairs(_pairs_of(texts, pairs))
    assert set(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == want
    assert 20 < len(want) < len(pairs) / 5 and len(n) < len(pairs) / 2
    assert lines._similar_pairs(_pairs_of(texts, [])).num_rows == 0


def test_a_tile_of_long_unrelated_lines_counts_few_elements(monkeypatch):
    """Long lines fill a short bitmap, by which they all look alike."""
    from docloom.llm import buckets

    own = np.random.default_rng(7)
    sets = [own.integers(0, 1 << 62, 700, dtype=np.int64).view(np.uint64) for _ in range(200)]
    sets += [np.concatenate([x[: 700 - k], own.integers(0, 1 << 62, k, dtype=np.int64).view(np.uint64)]) for x in sets[:20] for k in (60, 100)]
    counted, plain = [], np.searchsorted
    monkeypatch.setattr(buckets.np, "searchsorted", lambda a, v, *r, **s: counted.append(len(v)) or plain(a, v, *r, **s))
    got = buckets.similar_stars(sets, np.arange(240), 0.8)
    monkeypatch.undo()
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert {tuple(r) for r in got[["src", "dst"]].to_numpy().tolist()} == {(200 + i, i // 2) for i in range(40) if jaccard(200 + i, i // 2) >= 0.8}
    assert sum(counted) < 200 * 700
