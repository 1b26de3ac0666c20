import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docloom.llm import tokencounts as tc

TEXTS = ["", None, "Hello  world", "a <|endoftext|> b<|endoftext|>", "ünïcode 漢字\n\n  x\t y 's don't", " lead", "x" * 3000, "word " * 3000, "Hello  world", "Á B", "Á b", "<|STARTOFTEXT|> a", "<|startoftext|> a"]


def expected(file, text):
    if file.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=file).encode(text or ""))
    return len(Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, make, tmp_path, name):
    file, cache = P.path(name), tc.CountCache(spark, str(tmp_path / "cache"))
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (None, "no id"), (3, "a second row of one id")]
    got = tc.token_counts(make(rows), cache, file).collect()
    want = [(i, len((t or "").encode()), expected(file, t), expected(file, t) > 1024) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_only_misses_are_encoded_and_appended(spark, make, tmp_path):
    file, cache = P.path("byte_bpe_50k.json"), tc.CountCache(spark, str(tmp_path / "cache"))
    of = tc.version(file)
    first = make([(1, "one two"), (2, "one two"), (3, "three")])
    keys = tc._keyed(first, file, False)
    assert tc.counted(first, keys, cache, file)[1] == 2 and len(cache.parts(of)) == 1
    assert tc.counted(first, keys, cache, file)[1] == 0 and len(cache.parts(of)) == 1
    more = make([(9, "three"), (8, "four"), (7, "four")])
    got = {r.doc_id: r.n_tokens for r in tc.token_counts(more, cache, file).collect()}
    assert got == {9: expected(file, "three"), 8: expected(file, "four"), 7: expected(file, "four")}
    assert len(cache.parts(of)) == 2 and cache.read(of).count() == 3
    assert cache.read("another version").count() == 0


def test_stored_counts_are_what_is_returned(spark, make, tmp_path):
    """A count found in the cache is believed: nothing is encoded beside it."""
    file, cache = P.path("byte_bpe_50k.json"), tc.CountCache(spark, str(tmp_path / "cache"))
    docs = make([(1, "one")])
    cache.append(tc.version(file), tc._keyed(docs, file, False).selectExpr("digest", "77L AS n_tokens"))
    assert tc.token_counts(docs, cache, file).first().n_tokens == 77


def test_an_append_that_did_not_end_is_not_read(spark, make, tmp_path):
    file, cache = P.path("byte_bpe_50k.json"), tc.CountCache(spark, str(tmp_path / "cache"))
    docs = make([(1, "one")])
    tc.token_counts(docs, cache, file)
    part = cache.parts(tc.version(file))[0].removeprefix("file:")
    (tmp_path / part / "_SUCCESS").unlink()
    assert cache.read(tc.version(file)).count() == 0
    assert tc.token_counts(docs, cache, file).first().n_tokens == 1


def test_texts_of_one_normal_form_share_a_count(spark, make, tmp_path):
    file, cache = P.path("word_bpe_49k.json"), tc.CountCache(spark, str(tmp_path / "cache"))
    got = tc.token_counts(make([(1, "A  b"), (2, "a b"), (3, "a\tB")]), cache, file).collect()
    assert len({r.n_tokens for r in got}) == 1 and cache.read(tc.version(file)).count() == 1


def test_long_texts_are_cut_where_no_token_crosses():
    file = P.path("byte_bpe_50k.json")
    text = "it's  a \n\n test of 12 things, don't <|endoftext|> stop at été x " * 400
    parts = tc.cut(text, 50)
    assert "".join(parts) == text and len(parts) > 100
    assert sum(expected(file, p) for p in parts) == expected(file, text)
    assert tc.cut("x" * 500, 50) == ["x" * 500]
    assert tc.can_cut(tc._declared(file)) and not tc.can_cut(tc._declared(P.path("word_bpe_49k.json")))


def test_an_empty_table(spark, make, tmp_path):
    cache = tc.CountCache(spark, str(tmp_path / "cache"))
    assert tc.token_counts(make([(1, "x")]).where("false"), cache, P.path("byte_bpe_50k.json")).count() == 0
