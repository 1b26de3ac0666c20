import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import pages, sessions
from docloom.sources.conversations import PagedConversations

SCHEMA = "k string, t long, i long, m string"


def talk(seed=3):
    """A key with a third of all rows, a null key, null messages and null times."""
    own = random.Random(seed)
    rows = [("hot", t, f"m{t}") for t in range(200)]
    rows += [(own.choice(["a", "b", None]), own.choice([None, *range(90)]), None if k % 9 == 0 else f"n{k}") for k in range(400)]
    return [(k, t, i, m) for i, (k, t, m) in enumerate(rows)]


def in_order(rows):
    by_key = {}
    for k, t, i, m in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        by_key.setdefault(k, []).append(m)
    return by_key


def as_lists(rows):
    found = {}
    for r in rows:
        found.setdefault(r.k, {})[r.page] = list(r.messages)
    assert all(sorted(p) == list(range(len(p))) for p in found.values())
    return {k: [p[n] for n in sorted(p)] for k, p in found.items()}


def cut_up(messages, size):
    return [messages[a : a + size] for a in range(0, len(messages), size)]


@pytest.mark.parametrize("cut", ["t DIV 7", "t", "t DIV 1000", "CAST(0 AS BIGINT)"])
def test_pages_are_those_of_a_plain_loop(spark, cut):
    rows = talk()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = pages.paged(df.withColumn("page", F.lit("clash")).withColumn("messages", F.lit(1)), "k", ["t", "i"], F.col("m"), F.expr(cut), 16)
    want = in_order(rows)
    assert as_lists(got.collect()) == {k: cut_up(m, 16) for k, m in want.items()}
    back = {}
    for r in pages.messages_of(got, "k", 16).orderBy("position").collect():
        back.setdefault(r.k, []).append((r.position, r.message))
    assert back == {k: list(enumerate(m, 1)) for k, m in want.items()}


def test_no_rows_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pages.paged(none, "k", ["t"], F.col("m"), F.col("t")).count() == 0
    some = pages.paged(spark.createDataFrame(talk(), SCHEMA), "k", ["t", "i"], F.col("m"), F.col("t"), 16)
    assert pages.appended(some, none, "k", ["t"], F.col("m"), F.col("t"), 16).count() == 0


@pytest.mark.parametrize("size", [1, 8, 50, 1000])
def test_appending_changes_the_last_pages_alone(spark, size):
    rows = talk(4)
    rows = [r for r in rows if r[1] is not None]
    first, then = ([r for r in rows if (r[1] < 50) == early and (early or r[0] != "b")] for early in (True, False))
    message, cut = F.col("m"), F.expr("t DIV 10")
    old = pages.paged(spark.createDataFrame(first, SCHEMA), "k", ["t", "i"], message, cut, size)
    new = pages.appended(old, spark.createDataFrame(then, SCHEMA), "k", ["t", "i"], message, cut, size).collect()
    before, after = in_order(first), in_order(first + then)
    merged = {(r.k, r.page): list(r.messages) for r in old.collect()} | {(r.k, r.page): list(r.messages) for r in new}
    assert merged == {(k, n): p for k, m in after.items() for n, p in enumerate(cut_up(m, size))}
    assert {(r.k, r.page) for r in new} == {(k, n) for k, m in after.items() if k != "b" for n in range(len(before.get(k, [])) // size, -(-len(m) // size))}


def test_rows_are_shuffled_once_and_never_gathered_by_key(spark):
    df = spark.createDataFrame(talk(), SCHEMA)
    plan = pages.numbered(df, "k", ["t", "i"], F.expr("t DIV 7"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # One exchange of rows and one of their counts by range, one of the ranges' counts by key; whatever joins them is no second one of the rows.
    assert plan.count("hashpartitioning(_range") <= 3


def test_session_pages(spark):
    log = spark.createDataFrame([("s", h * 3600 + k, k, "user", f"{h}-{k}") for h in range(5) for k in range(4)] + [(None, 1, 1, "user", None)], "session_id string, ts long, seq long, role string, content string")
    got = sessions.history_pages(log.withColumn("ts", F.timestamp_seconds("ts")), 6).collect()
    said = [m.content for r in sorted((r for r in got if r.session_id), key=lambda r: r.page) for m in r.messages]
    assert said == [f"{h}-{k}" for h in range(5) for k in range(4)]
    assert sorted(len(r.messages) for r in got) == [1, 2, 6, 6, 6]


def test_a_save_that_runs_again_gives_the_same(spark, tmp_path):
    rows = [(c, t, "user", None if t == 5 else f"{c}.{t}") for c in range(3) for t in range(11)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = PagedConversations(spark, str(tmp_path / "talks"), 4)
    assert kept.pages().count() == 0
    for version, some in [(0, "turn < 3"), (1, "turn >= 3 AND turn < 9 AND conv_id > 0"), (1, "turn >= 3 AND turn < 9 AND conv_id > 0"), (2, "turn >= 9 AND conv_id > 0")]:
        kept.save(df.where(some), version)
    got = {(r.conv_id, r.page): [m.content for m in r.messages] for r in kept.pages().collect()}
    want = {c: [r[3] for r in rows if r[0] == c and (c or r[1] < 3)] for c in range(3)}
    assert got == {(c, n): p for c, m in want.items() for n, p in enumerate(cut_up(m, 4))}
    written = spark.read.parquet(str(tmp_path / "talks")).where("version = 2")
    assert {(r.conv_id, r.page) for r in written.collect()} == {(1, 2), (2, 2)}
    for version in (1, 2):
        kept.save(df.where("turn < 0"), version)
    assert kept.pages().count() == 3
