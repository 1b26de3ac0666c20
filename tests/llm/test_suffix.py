import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import suffix


def brute(rows, window=50):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - window + 1):
                w = b[k : k + window]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1 if i is not None else 0):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = True
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def some_rows(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdeé\0 "
    fresh = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [fresh(k) for k in (49, 50, 51, 80, 200, 700)]
    rows = [(i, "".join(rng.choice([fresh(rng.randrange(60)), rng.choice(shared), "a" * rng.randrange(120)]) for _ in range(rng.randrange(6)))) for i in rng.sample(range(-50, 5000), n)]
    return [*rows, (9000, None), (None, shared[4]), (9001, ""), (9002, "x" * 3000), (9003, "x" * 49), (9004, "x" * 50), (9005, fresh(30_000) + shared[5])]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(make):
    rows = some_rows(1)
    assert as_rows(suffix.passages(make(rows))) == brute(rows)


def test_hot_anchors_are_split_and_merged(make, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 5)
    monkeypatch.setattr(suffix, "SHARD", 2000)
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh") for _ in range(90))
    rows = [(i, "".join(rng.choice("ijkl") for _ in range(rng.randrange(40))) + shared + "".join(rng.choice("mnop") for _ in range(rng.randrange(40)))) for i in range(60)]
    assert as_rows(suffix.passages(make(rows))) == brute(rows)


def test_repeated_rows_are_one_document_and_empty_tables_give_nothing(make):
    docs = make([(1, "q" * 60), (1, "q" * 60), (2, "q" * 60)])
    assert [r.n_removed for r in suffix.passages(docs).orderBy("doc_id").collect()] == [0, 0, 60]
    assert suffix.passages(docs.limit(0)).count() == 0


def test_stage_cuts_text_and_drops_broken_characters(make):
    passage = "é" * 30
    docs = make([(1, passage), (2, "start " + passage + " end"), (3, None), (4, "clean �")])
    out = suffix.without_repeated_passages(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (passage, 30), 2: ("start  end", 10), 3: (None, 0), 4: ("clean �", 7)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6), st.integers(2, 12))
def test_window_minima(texts, window):
    texts = [t for t in texts if len(t) >= window] or [b"z" * window]
    docs = np.arange(len(texts))[::-1].copy()
    got = suffix.window_minima(texts, docs, window)
    for t, m in zip(texts, got, strict=True):
        for k, least in enumerate(m):
            assert least == min(d for x, d in zip(texts, docs, strict=True) if t[k : k + window] in x)


@pytest.mark.parametrize("part", [64, 1 << 20])
def test_anchors_depend_on_the_window_alone(part, monkeypatch):
    monkeypatch.setattr(suffix, "PART", part)
    rng = random.Random(3)
    text = bytes(rng.choice(b"abc") for _ in range(500))
    h = suffix.anchors(text)
    assert len(h) == 451
    assert all(suffix.anchors(text[k : k + 50])[0] == h[k] for k in range(0, 451, 37))
    hash_, first, n = suffix.runs(h)
    assert n.sum() == 451 and first[0] == 0 and (hash_[1:] != hash_[:-1]).all()
