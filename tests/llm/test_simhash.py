import random
import re

import numpy as np
import xxhash

from docloom.llm import buckets, simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    ids = [i for i, _ in rows]
    fp = np.array([f for _, f in rows], np.uint64)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 3):
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: least[find(i)] for i in range(len(rows))}


def test_fingerprints():
    rng = random.Random(1)
    cases = ["", None, " \n", "One", "ONE two", "one\x0btwo x three", "É é A a", "a a a a"] + [" ".join(rng.choice(["a", "b", "C", "dd"]) for _ in range(n)) for n in (3, 9, 50, 20000)]
    assert [simhash.fingerprint(c) for c in cases] == [slow_fingerprint(c) for c in cases]


def test_groups_equal_brute_force(make):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [None, "", " ", "two words", "two words"]
    for _ in range(80):
        x = list(base)
        x[rng.randrange(300)] = "new"
        texts.append(" ".join(x))
    texts += [" ".join(f"v{rng.randrange(5000)}" for _ in range(50)) for _ in range(40)]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts, strict=True))
    got = simhash.simhash_groups(make(rows)).collect()
    want = brute_components([(i, slow_fingerprint(t)) for i, t in rows])
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{slow_fingerprint(t):016x}" for i, t in rows}


def test_links_of_crowded_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(buckets, "SIDE", 32)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(120):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    rows = list(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in rows], "fp long, rep long")
    from docloom.llm.components import components

    found = {r.node: r.component for r in components(simhash.fingerprint_links(nodes, simhash.blocks_for(len(rows)))).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == brute_components(rows)


def test_every_close_pair_shares_a_choice_of_blocks(spark):
    rng = random.Random(4)
    for blocks in (4, 5, 7):
        rows = []
        for k in range(40):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            rows += [(x - (1 << 64) if x >> 63 else x, k) for x in (a, b)]
        keys = simhash.block_keys(spark.createDataFrame(rows, "fp long, pair int"), blocks)
        met = keys.groupBy("pair", "choice", "bits").count().where("count = 2").select("pair").distinct().count()
        assert met == 40


def test_stage_keeps_one_of_each_group(make):
    long = " ".join(f"w{i}" for i in range(100))
    docs = make([(5, long), (3, long), (9, "other text entirely here now"), (None, long), (3, long)])
    out = simhash.keep_first_of_group(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 3, 9, None]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_components_of_long_paths_and_stars(spark):
    from docloom.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (None, 4), (8, 7), (7, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [8, *range(200, 260)]} == {7} and 3 not in got


def test_stage_links_texts_by_their_shingles(make, monkeypatch):
    monkeypatch.setattr(buckets, "SIDE", 16)
    rng = random.Random(6)
    rows, truth = [], {}
    for g in range(6):
        base = [f"g{g}w{rng.randrange(9999)}" for _ in range(400)]
        for _ in range(30):
            x = list(base)
            x[rng.randrange(400)] = f"e{rng.randrange(999)}"
            truth[len(rows)] = g
            rows.append((len(rows), " ".join(x)))
    rows += [(1000, "a b c d e f"), (1001, "f e d c b a"), (1002, "A  b c\nd e f"), (1003, None), (1004, " ")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(make(rows)).collect()}
    for i in truth:
        assert truth[got[i]] == truth[i]
    assert len({got[i] for i in truth}) <= 12
    assert (got[1000], got[1001], got[1002], got[1003], got[1004]) == (1000, 1001, 1000, 1003, 1003)


def stage_brute(rows):
    sets, up = [simhash.word_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_stage_equals_brute_force_for_changed_appended_and_truncated_copies(make):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(80, 400))]
        n = len(base)
        changed = [word() if rng.random() < 1 / 60 else x for x in base]
        texts += [base, changed, base + [word() for _ in range(n * 15 // 100)], base[: n - n * 15 // 100], base[: n * 7 // 10]]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(make(rows)).collect()}
    want = stage_brute(rows)
    assert got == want and sum(want[i] != i for i in want) > 150
