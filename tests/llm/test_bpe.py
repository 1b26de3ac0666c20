import hashlib
import random

import numpy as np

from docloom.llm import bpe
from docloom.llm.vocab import encoder, vocabulary_file

FILE = vocabulary_file(bpe.FILE)
CASES = ["", None, "a  b\n\n  c ", " x", "x ", "  y z", "it's we'll  DON'T", "\x1c a\x1fb", "日本 語テスト", "ab" * 300, "\n", "   ", "😀😀 é", "<|endoftext|>", "a\u00a0 b\u2003 c", "tab\t x", "0\x00 1"]


def rows_of(n=40):
    rng = random.Random(1)
    made = [" ".join("".join(rng.choice("aeiounstr-é1.,\n") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    return list(enumerate(CASES + made))


def test_ids_and_bytes_equal_the_library(make):
    rows, e = rows_of(), encoder(FILE)
    got = {r.doc_id: r for r in bpe.round_trip(make(rows), FILE).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = e.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest(), t


def test_encode_then_decode_as_operators(make):
    rows = rows_of(5)
    encoded = bpe.encode_documents(make([*rows, (None, "x"), (0, "")]), FILE)
    back = bpe.decode_documents(encoded, FILE)
    texts = dict(rows)
    assert all(bytes(r.bytes).decode() == (texts[r.doc_id] or "") for r in back.collect() if r.doc_id is not None)
    assert back.where("doc_id IS NULL").first().bytes == b"x"
    assert bpe.encode_documents(make(rows).limit(0), FILE).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    monkeypatch.setattr(bpe, "PIECES", 2)
    monkeypatch.setattr(bpe, "TOKENS", 5)
    m, e = bpe._Memory(FILE), encoder(FILE)
    texts = [t or "" for _, t in rows_of(10)]
    for t in texts:
        assert m.encode([t])[0].tolist() == e.encode_ordinary(t)
    assert bpe.decode_ids(m.encode(texts), FILE) == [t.encode() for t in texts]


def test_long_pieces_equal_the_library(monkeypatch):
    rng = random.Random(3)
    parts = ["a", "b", "ab", "bab", "aa" * 30, "nn" * 21, "an" * 17]
    texts = ["-" * 20_001, "ab" * 9000 + "b", " " * 9000 + "x", *("".join(rng.choice(parts) for _ in range(rng.randrange(20, 150))) for _ in range(12))]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(7000))]
    m, e = bpe._memory(FILE), encoder(FILE)
    for t in texts:
        assert m.encode([t])[0].tolist() == e.encode_ordinary(t)
    monkeypatch.setattr(bpe, "KEPT", 12000)  # queries take few pieces, and start again and again
    monkeypatch.setattr(bpe, "TILES", 7)
    got = bpe.encode_pieces([t.encode() for t in texts[3:14]], FILE)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [e.encode_ordinary(t) for t in texts[3:14]]
    con, ranks = bpe._database(FILE)
    assert bpe._fixpoint(texts[3].encode(), con, ranks).tolist() == e.encode_ordinary(texts[3])


def test_tiles_that_share_no_token_are_bridged():
    """Periodic text has other borders in each tile; changes of phase, and stretches of any text between."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    texts = [word(k) * (3000 // k) for k in (1, 2, 3, 5, 7, 11, 40, 63, 65, 130)]
    texts += ["".join(word(rng.randrange(1, 9)) * rng.randrange(1, 60) + word(rng.randrange(200)) for _ in range(8)) for _ in range(6)]
    texts += ["".join(chr(rng.choice([0x4E00, 0x4E01, 0x4E8C])) for _ in range(2000)), "a" * 5000 + "b" + "a" * 5000]
    m, e = bpe._memory(FILE), encoder(FILE)
    for t in texts:
        assert m.encode([t])[0].tolist() == e.encode_ordinary(t)


def test_a_piece_of_megabytes_is_encoded_and_decoded():
    rng = random.Random(8)
    e = encoder(FILE)
    for t in ["".join(rng.choices("etaoinshrdlu", k=1_000_000)) * 3, "-" * 5_000_000]:
        ids = bpe._memory(FILE).encode([t])[0]
        assert ids.tolist() == e.encode_ordinary(t) and bpe.decode_ids([ids], FILE) == [t.encode()]


def test_many_pieces_just_under_the_long_ones():
    rng = random.Random(9)
    texts = ["".join(rng.choices("etaoinshrdlu", k=250)) for _ in range(1000)]
    got = bpe.encode_pieces([t.encode() for t in texts], FILE)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [encoder(FILE).encode_ordinary(t) for t in texts]
