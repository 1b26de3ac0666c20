import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing
from docloom.llm.vocab import encoder, vocabulary_file

FILE = vocabulary_file(packing.FILE)


def check(rows, ids, limit=1024):
    """Every id lies in one piece; sequences are gapless, within the limit, and powers of two unless full."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        a = ids[r.doc_id]
        assert r.doc_tokens == len(a) and r.ids_crc32 == zlib.crc32(a[r.start : r.start + r.length].astype("<u4").tobytes())
    for key, a in ids.items():
        at = 0
        for p in sorted(pieces[key], key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(a)
    lengths = []
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
        lengths.append(at)
    return lengths


def test_documents(make):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary_file("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>", "it's  9 <b>\n\n x"] + [" ".join(rng.choice(["the", "xyzzy", "é", "12"]) for _ in range(rng.choice([3, 40, 900, 4000]))) for _ in range(40)]
    rows = list(enumerate(texts))
    got = packing.pack_documents(make(rows), FILE).collect()
    ids = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t in rows}
    lengths = check(got, ids)
    assert all(n & (n - 1) == 0 for n in lengths)


def test_many_tiny_documents_need_no_padding(make):
    rows = [(i, None) for i in range(700)] + [(700 + i, "word " * 20) for i in range(50)]
    got = packing.pack_documents(make(rows), FILE).collect()
    e = encoder(FILE)
    lengths = check(got, {i: np.array([*(e.encode_ordinary(t) if t else []), 0], np.uint32) for i, t in rows})
    assert all(n & (n - 1) == 0 for n in lengths)
    per = {}
    for r in got:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + 1
    assert max(per.values()) <= packing.SEGMENTS


def test_null_ids_repeats_and_an_empty_table(make):
    docs = make([(None, "one"), (1, "two"), (1, "two")])
    assert packing.pack_documents(docs, FILE).count() >= 3
    assert packing.pack_documents(docs.limit(0), FILE).count() == 0


def test_conversations_respect_the_loss_limit(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", "some words here " * (c + 1)) for c in range(30) for t in range(4)] + [(99, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = packing.pack_conversations(df, FILE, with_ids=True, loss=256, segments=6).collect()
    e = encoder(FILE)
    ids, loss = {}, {}
    for c, _, role, text in turns:
        part = [*(e.encode_ordinary(text) if text else []), 0]
        ids[c] = np.append(ids.get(c, np.zeros(0, np.uint32)), np.array(part, np.uint32))
        loss[c] = np.append(loss.get(c, np.zeros(0, bool)), np.full(len(part), role == "assistant"))
    check(got, ids)
    borne, segments = {}, {}
    for r in got:
        borne[r.sequence_id] = borne.get(r.sequence_id, 0) + int(loss[r.doc_id][r.start : r.start + r.length].sum())
        segments[r.sequence_id] = segments.get(r.sequence_id, 0) + 1
        assert list(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tolist()
    assert max(borne.values()) <= 256 and max(segments.values()) <= 6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=60), st.integers(1, 4), st.integers(4, 40))
def test_packer_places_every_id_once_within_all_limits(sizes, segments, loss_limit):
    p = packing.Packer(0, tokens=32, segments=segments, loss=loss_limit)
    marks = {}
    for k, n in enumerate(sizes):
        marks[k] = np.arange(n) % 3 > 0
        p.add(k, np.arange(n, dtype=np.uint32), marks[k])
        if len(p.pool) > 10:
            p.drain(5)
    p.drain(0)
    seen, bins = {}, {}
    for key, start, ids, _, bin_, at in p.take():
        seen.setdefault(key, []).extend(ids.tolist())
        b = bins.setdefault(bin_, [0, 0, 0])
        assert at == b[0]
        b[0] += len(ids)
        b[1] += 1
        b[2] += int(marks[key][start : start + len(ids)].sum())
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(sizes)}
    assert all(b[0] <= 32 and b[1] <= segments and b[2] <= loss_limit for b in bins.values())


def test_ids_equal_those_of_the_named_library_and_file(make):
    from tokenizers import Tokenizer

    named = vocabulary_file(packing.NAMED)
    t = Tokenizer.from_file(named)
    rows = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|>"), (3, "it's we'll 日本 <|endoftext|"), (4, "a" * 3000)]
    pieces = packing.pack_documents(make(rows), FILE, named, with_ids=True).orderBy("doc_id", "start").collect()
    for i, text in rows:
        assert [x for p in pieces if p.doc_id == i for x in p.ids] == [*t.encode(text, add_special_tokens=False).ids, packing.END]


def test_each_limit_closes_sequences_of_conversations(spark):
    got = packing.talks(spark, "/root/testdata/sf0.01").toPandas()
    bins = got.groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"))
    assert bins.tokens.max() <= packing.TOKENS and bins.segments.max() == packing.TALK_SEGMENTS
    assert (bins.tokens & (bins.tokens - 1) == 0).mean() > 0.9


def test_turns_without_a_conversation_are_examples_of_their_own(spark):
    rows = [(None, 0, "assistant", "the same words")] * 2000 + [(1, t, "assistant", "a turn") for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = packing.pack_conversations(turns, FILE).collect()
    n = len(encoder(FILE).encode_ordinary("the same words")) + 1
    lost = [r for r in got if r.doc_id is None]
    assert sum(r.length for r in lost) == 2000 * n and {r.doc_tokens for r in lost} == {n}
    assert {r.doc_tokens for r in got if r.doc_id == 1} == {3 * (len(encoder(FILE).encode_ordinary("a turn")) + 1)}
