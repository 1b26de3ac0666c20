import hashlib
import random
import zlib

import pytest

from docloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner long"


def ordered(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(role, text) for _, role, text in sorted(t)] for c, t in talks.items()}


def brute(talks):
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(talks[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), parent, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuild(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def some(seed, convs=40, longest=12, words=2):
    own = random.Random(seed)
    rows = []
    for c in own.sample(range(100), convs):
        for t in range(own.randrange(longest)):
            rows.append((c, own.choice([t, t, t, None]), own.choice(["user", None]), own.choice(["a", "é", None][:words])))
    return rows + rows[:20] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize(("seed", "bits"), [(1, 12), (2, 1), (3, 0)])
def test_trie_is_the_brute_force_one(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(trie, "BITS", bits)
    monkeypatch.setattr(trie, "IDS", 2 * bits)
    rows = some(seed)
    got = [tuple(r) for r in trie.conversation_trie(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ordered(rows))


def test_rebuilt_conversations(spark):
    rows = some(7, convs=60)
    got = [tuple(r) for r in trie.prefix_trie(*trie.rebuilt(frame(spark, rows))).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rebuild(ordered(rows)))


def test_a_path_of_many_chains(spark):
    """Conversation i shares i turns with the one before: each chain hangs on the last one, as deep as there are conversations."""
    rows = [(c, t, "user", f"{min(t, c)}-{t}") for c in range(18) for t in range(20)]
    assert {tuple(r) for r in trie.conversation_trie(frame(spark, rows)).collect()} == brute(ordered(rows))


def test_copies_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "BITS", 4)
    rows = [(c, t, "user", str(t)) for c in range(30) for t in range(3)] + [(50, t, "user", str(t % 7)) for t in range(150)]
    got = {tuple(r) for r in trie.conversation_trie(frame(spark, rows)).collect()}
    assert got == brute(ordered(rows)) and len(got) == 151


def test_turnless_conversations_belong_to_the_root(spark):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9)]
    talks = rebuild(ordered(rows))
    assert not all(talks.values())
    assert {tuple(r) for r in trie.prefix_trie(*trie.rebuilt(frame(spark, rows))).collect()} == brute(talks)


def test_no_conversation(spark):
    assert trie.conversation_trie(frame(spark, [])).count() == 0
    assert trie.conversation_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_sql_at_the_smallest_tables(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    want = duckdb.sql(f"WITH conversations AS (SELECT * FROM '{folder}/conversations.parquet') SELECT * FROM ({trie.ORACLE})")
    assert set(map(tuple, trie.op12(spark, folder).select(*want.columns).collect())) == set(want.fetchall())
