import json

import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.sources import conversations, files, models
from docloom.operators import chunk, sessions
from docloom.streaming.conversations import conversation_stream, request
from docloom.streaming.ingest import ingest_stream
from docloom.streaming.sessions import session_stream, visit_stream


def chunk_row(name, i, text):
    return (text, name, i, (name, len(text), 1, len(text)), None)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nb\rc".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "d.TXT").write_text("no")
    got = files.read_texts(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["text"]) for r in got] == [("a.txt", "é\nb\nc")]
    assert files.read_texts(spark, str(tmp_path / "missing")).count() == 0


def test_store_upserts_appends_and_clears(spark, tmp_path):
    store = files.ChunkStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    rows = lambda *r: spark.createDataFrame([chunk_row(*x) for x in r], schemas.CHUNK)
    store.upsert(rows(("a", 0, "one"), ("a", 1, "two")))
    store.upsert(rows(("a", 1, "new"), ("b", 0, "three")))
    assert {(r["filename"], r["chunk_id"]): r["content"] for r in store.read().collect()} == {("a", 0): "one", ("a", 1): "new", ("b", 0): "three"}
    store.append(rows(("a", 0, "one")))
    assert store.read().count() == 4
    store.clear()
    assert store.read().count() == 0 and store.read().schema == schemas.CHUNK


def test_a_file_added_again_leaves_no_old_chunk(spark, tmp_path):
    store = files.ChunkStore(spark, str(tmp_path / "store"))
    rows = lambda *r: spark.createDataFrame([chunk_row(*x) for x in r], schemas.CHUNK)
    content = lambda v=None: sorted((r.filename, r.chunk_id, r.content) for r in store.read(v).collect())
    store.append(rows(*[("a", i, f"old{i}") for i in range(6)], ("b", 0, "b")))
    before = store.replace_files(rows(("a", 0, "new")))
    assert content() == [("a", 0, "new"), ("b", 0, "b")]
    store.append(rows(("a", 1, "more")))
    store.upsert(rows(("b", 0, "B")))
    assert content() == [("a", 0, "new"), ("a", 1, "more"), ("b", 0, "B")] and content(before) == [("a", 0, "new"), ("b", 0, "b")]
    store.remove_files(spark.createDataFrame([("a",)], "filename string"))
    assert content() == [("b", 0, "B")]
    store.compact()
    store.append(rows(("a", 0, "again")))
    assert content() == [("a", 0, "again"), ("b", 0, "B")]


def test_a_write_costs_what_it_brings(spark, tmp_path):
    store = files.ChunkStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([chunk_row("a", i, "x" * 500) for i in range(2000)], schemas.CHUNK))
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet"))
    first, old = size(), set((tmp_path / "store").rglob("*.parquet"))
    store.append(spark.createDataFrame([chunk_row("b", 0, "y")], schemas.CHUNK))
    assert old < set((tmp_path / "store").rglob("*.parquet")) and size() - first < 20_000 and store.read().count() == 2001


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(k):
        own = files.ChunkStore(spark, str(tmp_path / "store"))
        return own.append(spark.createDataFrame([chunk_row(f"f{k}", 0, "x")], schemas.CHUNK))

    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(write, range(18)))
    assert sorted(versions) == list(range(1, 19))
    assert {r.filename for r in files.ChunkStore(spark, str(tmp_path / "store")).read().collect()} == {f"f{k}" for k in range(18)}


def test_a_rewrite_does_not_lose_a_commit_that_came_between(spark, tmp_path, monkeypatch):
    store, other = files.ChunkStore(spark, str(tmp_path / "store")), files.ChunkStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame([chunk_row("a", 0, "x")], schemas.CHUNK))
    write = store._written

    def late(rows, replaces):
        data = write(rows, replaces)
        other.append(spark.createDataFrame([chunk_row("b", 0, "y")], schemas.CHUNK))
        return data

    monkeypatch.setattr(store, "_written", late)
    with pytest.raises(files.CommitConflict):
        store.compact()
    assert {r.filename for r in other.read().collect()} == {"a", "b"}


def test_store_file(spark, tmp_path):
    row = {"content": "x", "filename": "f", "chunk_id": 0, "metadata": {"file_path": "f", "chunk_size": 1, "total_chunks": 1, "file_size": 1}, "embedding": [0.5]}
    (tmp_path / "s.json").write_text(json.dumps({"documents": [row], "metadata": {}}, indent=1))
    got = files.read_store_file(spark, str(tmp_path / "s.json")).first()
    assert got["content"] == "x" and got["embedding"] == [0.5]
    (tmp_path / "bad.json").write_text("{")
    assert files.read_store_file(spark, str(tmp_path / "bad.json")).count() == 0


def test_saved_conversations_are_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"timestamp": "t", "system_prompt": {"key": "k", "name": "N", "content": "c"}, "history": [{"role": "user", "content": "q"}]}))
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "c.json").write_text("{broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in conversations.list_saved(spark, str(tmp_path)).collect()}
    assert (got["a.json"]["prompt_name"], got["a.json"]["messages"], got["a.json"]["error"]) == ("N", 1, False)
    assert (got["b.json"]["timestamp"], got["b.json"]["messages"], got["b.json"]["error"]) == ("unknown", 0, False)
    assert got["c.json"]["error"]


def test_model_responses(spark):
    rows = spark.createDataFrame([('{"data":[{"id":"m1","embedding":[1,2]}]}', '{"choices":[{"message":{"content":"hi"}}]}')], "a string, b string")
    content, tokens = models.completion(F.col("b"))
    assert tuple(rows.select(models.first_model(F.col("a")), models.embedding_of(F.col("a")), content, tokens).first()) == ("m1", [1.0, 2.0], "hi", 0)


def test_session_stream_matches_the_batch(spark, tmp_path):
    schema = "session_id string, ts long, seq long, message string, answer string, error string"
    for part in range(2):
        rows = [(f"s{i % 3}", part, i, f"q{i}", f"a{i}", "down" if i == 4 else None) for i in range(part * 6, part * 6 + 6)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = session_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("sessions_seen").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = {r["session_id"]: r["n"] for r in spark.table("sessions_seen").groupBy("session_id").agg(F.max("message_count").alias("n")).collect()}
    assert got == {"s0": 8, "s1": 7, "s2": 8}


def test_missing_paths_leave_the_others(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    got = files.read_texts(spark, [str(tmp_path), str(tmp_path / "missing"), "/nowhere/*.txt"])
    assert [r.filename for r in got.collect()] == ["a.txt"]
    assert files.read_texts(spark, str(tmp_path / "missing")).count() == 0


def test_conversation_stream_is_a_plain_loop(spark, tmp_path):
    def client(body):
        """Says how many messages it was sent, and the last; refuses some."""
        said = json.loads(body)["messages"]
        if said[-1]["content"].endswith("3"):
            raise TimeoutError("late")
        return None if said[-1]["content"].endswith("5") else f"{len(said)} {said[-1]['content']}"

    schema, rows = "conv_id string, ts long, seq long, message string", []
    for part in range(3):
        new = [(f"c{i % 2}", part, i, f"m{i % 10}") for i in range(part * 14, part * 14 + 14)] + [(None, part, 99, "lost"), ("c0", part, 98, "  ")]
        rows += [r for r in new if r[0] and r[3].strip()]
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = conversation_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), client, "local", "be brief", sent=4, keep=6)
    stream.writeStream.format("memory").queryName("talks_seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    history, want = {}, set()
    for c, _, i, message in sorted(rows, key=lambda r: r[1:3]):
        own, answer, error = history.setdefault(c, []), None, None
        try:
            answer = client(request(own[-4:], message, "local", "be brief"))
            error = None if answer else "no answer"
        except TimeoutError as e:
            error = f"TimeoutError: {e}"
        if answer:
            own += [("user", message), ("assistant", answer)]
            del own[:-6]
        want.add((c, i, answer, error, len(own)))
    assert set(map(tuple, spark.table("talks_seen").collect())) == want
    assert {w[3] for w in want} == {None, "no answer", "TimeoutError: late"} and max(w[4] for w in want) == 6


def test_new_sessions_keep_their_ids_when_a_task_runs_again(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "seq long, session_id string")
    found = sessions.with_session(rows, ["seq"])
    first, again = ({r.seq: r.session_id for r in found.collect()} for _ in range(2))
    assert first == again and first[1] == "a" and len(set(first.values())) == 3


def test_messages_without_a_session_are_numbered_too(spark):
    log = spark.createDataFrame([(None, 1, 2, "user", "b"), (None, 1, 1, "user", "a"), ("s", 1, 1, "user", "c")], "session_id string, ts long, seq long, role string, content string")
    got = {(r.session_id, r.position, r.content) for r in sessions.messages(log.withColumn("ts", F.timestamp_seconds("ts"))).collect()}
    assert got == {(None, 1, "a"), (None, 2, "b"), ("s", 1, "c")}


def chunks_of(texts):
    return chunk.chunk_rows(texts, F.col("filename"), F.col("text"))


def test_ingest_brings_what_is_new_and_nothing_twice(spark, tmp_path):
    folder, store = tmp_path / "in", files.ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    written = lambda: set((tmp_path / "store").rglob("*"))
    content = lambda: sorted((r.filename, r.chunk_id) for r in store.read().collect())
    bring = lambda batch=None: store.ingest(files.read_texts(spark, str(folder)), chunks_of, batch)
    assert bring() is None and store.version() == 0
    (folder / "a.txt").write_text("word " * 400)
    (folder / "b.txt").write_text("b")
    assert bring("x") == 1 and {f for f, _ in content()} == {"a.txt", "b.txt"} and len(content()) > 3
    before = written()
    assert bring("y") is None and written() == before
    (folder / "a.txt").write_text("short")
    assert bring("x") is None and written() == before
    assert bring("z") == 2 and content() == [("a.txt", 0), ("b.txt", 0)]
    assert {r.filename: r.version for r in store.ledger().collect()} == {r.filename: r.version for r in store.read(commits=True).collect()} == {"a.txt": 2, "b.txt": 1}
    gone = spark.createDataFrame([("p/a.txt", "a.txt", None)], "path string, filename string, text string")
    assert store.ingest(gone, chunks_of) == 3 and content() == [("b.txt", 0)]
    (folder / "a.txt").unlink()
    store.compact()
    assert bring() is None and content() == [("b.txt", 0)]
    store.remove_files(spark.createDataFrame([("b.txt",)], "filename string"))
    assert bring() == 6 and content() == [("b.txt", 0)]
    store.clear()
    assert bring() == 8


@pytest.mark.parametrize("sent", [0, 10])
def test_ingest_of_nulls_and_equal_names(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(files.ChunkStore, "SENT", sent)
    store = files.ChunkStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("p/1/a", "a", "one"), ("p/2/a", "a", "two"), ("p/n", "n", None), (None, "x", "x"), ("p/y", None, "y")], "path string, filename string, text string")
    assert store.ingest(rows, chunks_of) == 1 and [(r.filename, r.content) for r in store.read().collect()] == [("a", "two")]
    assert sorted(r.filename for r in store.ledger().collect()) == ["a", "n"] and store.ingest(rows, chunks_of) is None


def test_a_stream_of_files_and_a_batch_that_comes_again(spark, tmp_path):
    import shutil

    folder, store = tmp_path / "in", files.ChunkStore(spark, str(tmp_path / "store"))
    folder.mkdir()
    run = lambda cp: ingest_stream(files.text_stream(spark, str(folder), files_at_once=2), store, chunks_of, str(tmp_path / cp), "docs").trigger(availableNow=True).start().awaitTermination()
    for i in range(5):
        (folder / f"{i}.txt").write_text(f"text {i}")
    run("cp")
    assert sorted(r.content for r in store.read().collect()) == [f"text {i}" for i in range(5)] and store.batches() == {"docs:0", "docs:1", "docs:2"}
    (folder / "5.txt").write_text("text 5")
    shutil.copytree(tmp_path / "cp", tmp_path / "cp_before")
    run("cp")
    version = store.version()
    run("cp_before")  # as after a failure between the commit and the checkpoint
    assert store.version() == version == 4 and store.read().count() == 6


def test_visits_split_and_join(spark):
    rows = [("a", 0), ("a", 1800), ("a", 3601), ("a", 5402), ("b", 7199), ("b", 7201), (None, 5), (None, 6), ("c", None)]
    log = spark.createDataFrame([(s, t, "user" if t != 6 else None) for s, t in rows], "session_id string, t long, role string").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.session_id, int(r.opened.timestamp()), int(r.last.timestamp()), r.message_count, r.user_messages) for r in sessions.visits(log).collect()}
    assert got == {("a", 0, 1800, 2, 2), ("a", 3601, 3601, 1, 1), ("a", 5402, 5402, 1, 1), ("b", 7199, 7201, 2, 2), (None, 5, 6, 2, 1)}
    assert sessions.visits(log.limit(0)).count() == 0


def test_visits_of_a_stream_close_by_the_clock(spark, tmp_path):
    """Steps of the clock: stretches close once, late messages join two, those behind the watermark reopen nothing."""
    schema, seen = "session_id string, ts timestamp, role string", []

    def step(*rows):
        at = lambda t: f"timestamp_seconds({t})"
        new = spark.createDataFrame([(s, t) for s, t in rows], "session_id string, t long").selectExpr("session_id", f"{at('t')} AS ts", "'user' AS role")
        new.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = visit_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100, "50 seconds")
        out = lambda b, n: seen.extend((r.session_id, r.o, r.l, r.message_count) for r in b.selectExpr("*", "unix_seconds(opened) o", "unix_seconds(last) l").collect())
        stream.writeStream.foreachBatch(out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    assert step(("a", 1000), ("a", 1050), ("a", 1190), ("b", 1000)) == [("b", 1000, 1000, 1)]  # the watermark is 1140
    assert step(("a", 1145), (None, 1145), ("b", 1000)) == [("b", 1000, 1000, 1)]  # joins a's stretches; b's is over
    done = [("a", 1000, 1190, 4), ("b", 1000, 1000, 1)]
    assert step(("c", 1400)) == done
    assert step(("a", 1190), ("b", 1300)) == done  # behind 1350
    assert step(("a", 1400), ("c", 1600)) == sorted([*done, ("a", 1400, 1400, 1), ("c", 1400, 1400, 1)])
