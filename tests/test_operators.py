import math
import os
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions.text import cosine, preview, strip
from docloom.operators import chat, chunk, compose, embed, retrieve, rewrite, route, sessions
from docloom.sources import models


def windows(text, size, overlap):
    """The rule as a plain walk."""
    at, found = 0, []
    while at < len(text):
        space = text.rfind(" ", at, at + size) if at + size < len(text) else -1
        end = space if space > at else at + size
        found.append((at, end))
        at = end - overlap if end - overlap > at else end
    return found


def chunked(text, size, overlap):
    return [text] if len(text) <= size else [c for c in (text[a:b].strip() for a, b in windows(text, size, overlap)) if c]


FIXED = ["", "  x  ", "b" * 1800, "b" * 2599, " " * 1500, "a" * 100 + " " + "b" * 5000, "a" * 200 + " " + "b" * 5000, "a" * 201 + " " + "b" * 5000, None]


def test_chunks_of_the_fixed_cases(spark):
    rows = spark.createDataFrame(list(enumerate(FIXED)), "i int, t string").select("i", chunk.chunks_of(F.col("t")).alias("c"))
    got = {r.i: r.c for r in rows.collect()}
    assert [len(got[i]) for i in range(len(FIXED))] == [1, 1, 3, 4, 0, 8, 8, 9, 0]
    assert [len(c) for c in got[2]] == [1000, 1000, 200] and got[0] == [""] and got[1] == ["  x  "]


@pytest.mark.parametrize(("size", "overlap"), [(1000, 200), (50, 20), (10, 5), (7, 6), (9, 4), (3, 0)])
def test_windows_are_those_of_a_plain_walk(spark, size, overlap):
    own = random.Random(size)
    letters = ["ab 𝒳é\n\u3000", "a" * 70 + " ", " b", "x"]
    texts = [t for t in FIXED if t is not None] + ["".join(own.choice(letters[k % 4]) for _ in range(own.randrange(5 * size))) for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk.spans_of(F.col("t"), size, overlap).alias("s"), chunk.chunks_of(F.col("t"), size, overlap).alias("c"))
    for r in rows.collect():
        assert [tuple(x) for x in r.s] == windows(texts[r.i], size, overlap)
        assert r.c == chunked(texts[r.i], size, overlap)
        assert all(len(c) <= size for c in r.c)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_three_windows_advance(text, size, overlap):
    """What the fold's number of steps rests on: three windows advance by size - 2 * overlap."""
    found = windows(text, size, min(overlap, size - 1))
    least = size - 2 * min(overlap, size - 1)
    assert least <= 0 or len(found) <= 3 * (len(text) // least + 1)


def test_a_long_text_is_chunked_without_python(spark):
    rows = spark.createDataFrame([("word and more " * 70_000,)], "t string")
    found = rows.select(chunk.chunks_of(F.col("t")).alias("c"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.select(F.size("c").alias("n"), F.array_max(F.transform("c", F.length)).alias("m")).first() == (len(chunked("word and more " * 70_000, 1000, 200)), 998)


def test_top_k_skips_bad_vectors_and_breaks_ties_by_order(spark):
    rows = spark.createDataFrame(
        [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [-1.0, 0.0])], "id long, embedding array<double>"
    )
    assert [r["id"] for r in retrieve.top_k(rows, [2.0, 0.0], 9, "id").collect()] == [1, 3, 7]
    assert retrieve.top_k(rows, [2.0, 0.0], 0, "id").count() == 0
    vectors = rows.withColumnRenamed("embedding", "vector")
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, [5.0]), (2, None)], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieve.top_k_batch(vectors, asked, 2).collect()}
    assert got == {(0, 1): 1, (0, 2): 3, (1, 1): 6}


def test_cosine_of_a_vector_with_itself_is_one(spark):
    row = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0])], "a array<double>, z array<double>").select(cosine(F.col("a"), F.col("a")), cosine(F.col("a"), F.col("z"))).first()
    assert math.isclose(row[0], 1.0) and row[1] is None


def test_rewriting(spark):
    table = spark.createDataFrame([(0, "abc?", "LONG"), (1, "abc", "SHORT"), (2, "what is abc", "ALL")], "ord int, phrase string, expansion string")
    asked = ["ABC", " abc? ", "What is ABC?", "Find abc and abc", "in Abc? now", "none", None]
    got = rewrite.expand_synonyms(spark.createDataFrame([(q,) for q in asked], "query string"), table).collect()
    want = {"ABC": "SHORT", " abc? ": "LONG", "What is ABC?": "ALL?", "Find abc and abc": "Find SHORT and abc", "in Abc? now": "in LONG now", "none": "none", None: None}
    assert {r["query"]: r["expanded"] for r in got} == want and len(got) == len(asked)
    got = rewrite.abbreviation(spark.createDataFrame([("ABC",), (" abc",), (None,)], "query string"), table).collect()
    assert {r["query"]: r["expanded"] for r in got} == {"ABC": "SHORT", " abc": " abc", None: None}


def test_confidence_and_answers(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, "x" * 201, 0.9), (1, 2, "y" * 200, 0.9), (2, 1, "z" * 21 + "\n" + "w" * 20, 0.4)], "query_id long, rank int, content string, score double")
    got = {r["query_id"]: r for r in compose.answers(asked, hits, "H\n", "\nF", "none").collect()}
    assert got[1]["confidence"] == 1.0 and math.isclose(got[2]["confidence"], 0.48) and got[3]["confidence"] == 0.0
    assert got[3]["answer"] == "none" and got[3]["sources"] == []
    assert [s["content"] for s in got[1]["sources"]] == ["x" * 200 + "...", "y" * 200]
    assert "z" * 21 in got[2]["answer"] and "w" * 20 not in got[2]["answer"]


def test_history_windows(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)], "conv_id long, turn int")
    past = rows.select("turn", chat.earlier("conv_id", ["turn"], F.col("turn")).alias("p")).where("turn = 11").first()["p"]
    assert past == list(range(1, 11))
    assert sorted(r["turn"] for r in chat.newest(rows, "conv_id", ["turn"], 20).collect()) == list(range(30, 50))


def test_model_errors_are_kept_apart(spark):
    def client(body):
        if body == "bad":
            raise TimeoutError("late")
        return body.upper()

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "conv_id long, body string")
    got = {r["conv_id"]: (r["answer"], r["error"]) for r in chat.generate(rows, "body", client).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "TimeoutError: late"), 3: (None, None)}


def test_turn_pairs_only_for_answers(spark):
    rows = spark.createDataFrame([(1, "q", "a"), (2, "q", None)], "conv_id long, message string, answer string")
    assert [(r["conv_id"], r["role"], r["text"]) for r in chat.turn_pair(rows).orderBy("conv_id", "part").collect()] == [(1, "user", "q"), (1, "assistant", "a")]


def test_routing(spark):
    lines = ["/TOPK 5", "/topk x", "/nope", "hello", "/help me now", "", None]
    command, argument = route.command_parts(F.col("t"))
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select("t", command.alias("c"), argument.alias("a"), route.route(command).alias("r"), route.count_argument(argument).alias("k"))
    got = {r["t"]: (r["c"], r["a"], r["r"], r["k"]) for r in rows.collect()}
    assert got["/TOPK 5"] == ("/topk", "5", "/topk", 5) and got["/topk x"] == ("/topk", "x", "/topk", None)
    assert got["/nope"] == ("/nope", None, "unknown", None) and got["hello"] == (None, None, "message", None)
    assert got["/help me now"][1] == "me now" and got[None][2] == "message"


def test_strip_and_preview(spark):
    row = spark.createDataFrame([(" \n x y ", "a" * 201)], "a string, b string").select(strip(F.col("a")), preview(F.col("b"))).first()
    assert row[0] == "x y" and row[1] == "a" * 200 + "..."


def test_fake_vectors_are_stable_unit_vectors_and_failures_null(spark):
    class Half:
        def get_embedding(self, text):
            return [1.0] if text == "a" else 1 / 0

    rows = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    got = {r["t"]: r["embedding"] for r in embed.with_embeddings(rows, "t", Half()).collect()}
    assert got == {"a": [1.0], "b": None, None: None}
    a, b = embed.FakeEmbedder(8).get_embedding("x"), embed.FakeEmbedder(8).get_embedding("x")
    assert a == b and math.isclose(sum(v * v for v in a), 1.0)


def test_sessions(spark):
    replies = spark.createDataFrame([("s", 1, "q", "a", None), ("s", 2, "q", None, "down"), (None, 3, "q", "a", None)], "session_id string, ts int, message string, answer string, error string")
    rows = sessions.log_rows(sessions.with_session(replies)).collect()
    assert len(rows) == 5 and all(r["session_id"] for r in rows)
    assert [(r["role"], r["content"]) for r in rows if r["session_id"] == "s"] == [("user", "q"), ("assistant", "a"), ("assistant", "down")]


@pytest.mark.parametrize("rows", [10, 2])
def test_phrases_sent_or_dealt_out_give_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(rewrite, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(rewrite, "SHARD", 2)
    monkeypatch.setattr(rewrite, "TEXTS", 3)
    known = [(0, "abc", "X"), (1, "b", "Y"), (2, "", "Z"), (3, "long phrase", "W"), (4, None, "V"), (9, "twice", "no"), (5, "twice", "first"), (6, "none", None)]
    phrases = spark.createDataFrame(known, "ord int, phrase string, expansion string")
    asked = ["a LONG phrase", "xABCb", "bb", "q", " Abc ", None, "", "TWICE and twice", "İ abc", "so none", "q"]
    got = rewrite.expand_synonyms(spark.createDataFrame([(q,) for q in asked], "query string"), phrases).collect()
    want = {"a LONG phrase": "a W", "xABCb": "xXb", "bb": "Yb", "q": "Zq", " Abc ": "X", None: None, "": "Z", "TWICE and twice": "first and twice", "İ abc": "İ abc", "so none": "so none"}
    assert {r.query: r.expanded for r in got} == want and len(got) == len(asked)


def test_a_hundred_thousand_phrases(spark):
    import duckdb

    own = random.Random(3)
    word = lambda n: "".join(own.choice("abcde ") for _ in range(n))
    phrases = [(i, word(own.randrange(2, 12)), f"<{i}>") for i in range(100_000)]
    asked = [(word(own.randrange(1, 90)).upper() if k % 3 == 0 else word(own.randrange(1, 90)),) for k in range(120)] + [(phrases[7][1],)]
    queries = spark.createDataFrame(asked, "query string")
    found = rewrite.expand_synonyms(queries, spark.createDataFrame(phrases, "ord int, phrase string, expansion string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan
    s, q = pa.table(dict(zip(("ord", "phrase", "expansion"), map(list, zip(*phrases)), strict=True))), pa.table({"q": [a for (a,) in asked]})  # noqa: F841
    want = duckdb.sql("""SELECT q, CASE WHEN x THEN expansion ELSE substr(q, 1, position(phrase IN lower(q)) - 1) || expansion || substr(q, position(phrase IN lower(q)) + length(phrase)) END AS e
      FROM (SELECT *, trim(lower(q)) = phrase AS x FROM (SELECT DISTINCT q FROM q) JOIN s ON contains(lower(q), phrase))
      QUALIFY row_number() OVER (PARTITION BY q ORDER BY x DESC, length(phrase) DESC, ord) = 1""").fetchall()
    want = {a: a for (a,) in asked} | dict(want)
    assert {r.query: r.expanded for r in found.collect()} == want


def _best(rows, asked, k):
    out = {}
    for q, v in asked:
        sims = [(-(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), i) for i, x in rows]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in sims)[:k]]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_batch_top_k_is_exact_and_leaves_groups_out(spark, monkeypatch, small):
    """Clustered vectors, copies among them; `small` takes many query blocks and levels of rows."""
    if small:
        for name, value in (("QUERIES_AT_ONCE", 40), ("SEEDS", 16), ("LEVEL", 4)):
            monkeypatch.setattr(retrieve, name, value)
    own = np.random.default_rng(4)
    middles = own.normal(size=(30, 16)) * 3
    vectors = middles[own.integers(0, 30, 3000)] + own.normal(size=(3000, 16)) * 0.2
    vectors[1000:1500] = vectors[1000]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    asked = [(i, (vectors[i * 20] * 2).tolist()) for i in range(150)]
    table = lambda x, key: spark.createDataFrame(x, f"{key} long, vector array<double>").repartition(3)
    found = retrieve.top_k_batch(table(rows, "id"), table(asked, "query_id"), 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.similarity)
    want = _best(rows, asked, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [round(got[q][k][1], 9) for k in range(1, 6)] == [round(s, 9) for _, s in best]
    share = retrieve.scored_share(table(rows, "id"), table(asked, "query_id"), 5)
    print(f"share of pairs scored: {share:.3f}")
    assert 0 < share < 0.5


@pytest.mark.parametrize("n", [1, 30, 64, 65])
def test_few_queries_read_the_rows_once(spark, tmp_path, n):
    """Each vector is made once; the hits are those of a plain loop, as they are with a look at some rows first."""
    own, folder = np.random.default_rng(6), str(tmp_path)
    rows = [(i, v.tolist()) for i, v in enumerate(own.normal(size=(400, 8)))]
    asked = [(i, v.tolist()) for i, v in enumerate(own.normal(size=(n, 8)))]

    def made(batches):
        for b in batches:
            with open(f"{folder}/{uuid.uuid4().hex}-{b.num_rows}", "w"):
                yield b

    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3).mapInArrow(made, "id long, vector array<double>")
    found = retrieve.top_k_batch(table, spark.createDataFrame(asked, "query_id long, vector array<double>"), 4).collect()
    got = {(r.query_id, r["rank"]): r.id for r in found}
    assert got == {(q, k): i for q, best in _best(rows, asked, 4).items() for k, (i, _) in enumerate(best, 1)}
    read = sum(int(p.name.split("-")[1]) for p in tmp_path.iterdir())
    assert read == 400 if n <= 64 else read > 400


def test_contexts_embed_each_chunk_once(spark, tmp_path, monkeypatch):
    from docloom.plans import reference

    folder = str(tmp_path)

    class Counting(embed.FakeEmbedder):
        def get_embedding(self, text):
            with open(f"{folder}/{os.getpid()}", "ab") as f:
                f.write(b".")
            return embed.FakeEmbedder.get_embedding(self, text)

    monkeypatch.setattr(reference.embed, "FakeEmbedder", Counting)
    data = "/root/testdata/sf0.001"
    found = reference.QUERIES["fake_embedding_topk"](spark, data).collect()
    chunks = reference._chunks(spark, data).select("content").collect()
    asked = spark.read.parquet(f"{data}/benchmark.parquet").where("item_id % 50 = 0").count()
    calls = sum(p.stat().st_size for p in tmp_path.iterdir())
    assert len(found) == 3 * asked and len(chunks) <= calls <= len(chunks) + 2 * asked


def test_hits_are_sent_to_what_they_are_joined_with(spark):
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"), F.lit("c").alias("content"))
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vector array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieve.search(rows.withColumn("metadata", F.lit("m")), asked, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_batch_top_k_ties_widths_and_no_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50, 0, -1)] + [(99, [float("nan"), 1.0]), (98, [None, 1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, [3.0, 0.0]) for i in range(20)] + [(20, [1.0])], "query_id long, vector array<double>")
    got = retrieve.top_k_batch(rows, asked, 3).collect()
    assert {(r.query_id, r["rank"], r.id) for r in got} == {(q, k, k) for q in range(20) for k in (1, 2, 3)}
    assert retrieve.top_k_batch(rows.where("false"), asked, 3).count() == retrieve.top_k_batch(rows, asked.where("false"), 3).count() == retrieve.top_k_batch(rows, asked, 0).count() == 0


@pytest.mark.parametrize("cut", ["t DIV 7", "t", "t DIV 1000", "0", "CASE WHEN t > 20 THEN t DIV 30 END"])
def test_history_by_ranges_is_that_of_a_window(spark, cut):
    """A key with a third of all rows, a null key, empty ranges between."""
    own = random.Random(5)
    rows = [("hot", t, f"m{t}") for t in range(120)] + [(own.choice(["a", "b", None]), own.randrange(300), None if k % 9 == 0 else f"n{k}") for k in range(240)]
    rows = [(k, t, i, m) for i, (k, t, m) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, t long, i long, m string").repartition(4)
    ranges = F.expr(cut) if "CASE" not in cut else F.when(F.col("t") > 20, F.expr("t DIV 30"))
    got = {r.i: r.earlier for r in chat.with_earlier(df, "k", ["t", "i"], F.col("m"), ranges).collect()}
    want = {r.i: r.p for r in df.select("i", chat.earlier("k", ["t", "i"], F.col("m")).alias("p")).collect()}
    assert got == want and len(got) == len(rows)


def test_backends_and_their_answers(spark):
    class Away:
        def get_embedding(self, text):
            raise OSError

    own = embed.FakeEmbedder(4)
    assert embed.first_working([Away(), own]) is own and embed.first_working([Away()]) is None
    rows = spark.createDataFrame([('{"data": [{"id": "m"}]}',), ('{"data": []}',), ("broken",), (None,)], "a string")
    assert [r.c for r in rows.select(models.connected("a").alias("c")).collect()] == [True, False, False, False]


class Flaky:
    """Fails twice, then answers; one instance counts within a worker."""

    def __init__(self):
        self.left = 2

    def get_embedding(self, text):
        if self.left:
            self.left -= 1
            raise TimeoutError
        return [1.0]


def test_embeddings_say_why_they_are_missing(spark):
    class Server:
        """Refuses requests of more than four texts, fails for texts with `bad`, has nothing for `none`."""

        def get_embeddings(self, texts):
            if len(texts) > 4 or any("bad" in t for t in texts):
                raise ConnectionError("refused")
            return [None if t == "none" else [float(len(t))] for t in texts]

    texts = ["a", "bb", "bad one", "none", None, "bb", "ccc", "dddd", "eeeee"]
    got = embed.embedded(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", Server(), retries=0).collect()
    want = {0: ([1.0], None), 1: ([2.0], None), 2: (None, "ConnectionError: refused"), 3: (None, "no vector"), 4: (None, "no text"), 5: ([2.0], None), 6: ([3.0], None), 7: ([4.0], None), 8: ([5.0], None)}
    assert {r.i: (r.embedding, r.embedding_error) for r in got} == want and len(got) == len(texts)


def test_requests_are_sent_again_and_equal_texts_asked_once(spark):
    assert embed._request(Flaky(), ["x"], 2) == [([1.0], None)]
    assert embed._request(Flaky(), ["x"], 1) == [(None, "TimeoutError: ")]
    asked = []

    class Counting:
        def get_embeddings(self, texts):
            asked.extend(texts)
            return [[float(len(asked))]] * len(texts)

    rows = spark.createDataFrame([("same",)] * 50, "t string").repartition(5)
    assert {tuple(r.embedding) for r in embed.embedded(rows, "t", Counting()).collect()} == {(1.0,)}


def test_a_wrong_number_of_vectors_is_an_error():
    class Short:
        def get_embeddings(self, texts):
            return []

    assert embed._request(Short(), ["x", "y"], 0) == [(None, "ValueError: 0 vectors for 1 texts")] * 2
