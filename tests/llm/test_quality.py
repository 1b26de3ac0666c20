import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered))


CASES = ["", None, " \n\t", "a b c d e f g h i j", "a b c d e x a b c d e", "x " * 40, "l one\nl one\n\n \nl two", "#*$%&|<> " * 5, "é ü 日本 " * 9, "a b c\x0bd\x0ce\rf"]


def test_base_counts_equal_brute_force(make):
    rng = random.Random(1)
    cases = CASES + [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    got = quality.quality_rules(make(list(enumerate(cases))), ["doc_id", "kept", "b"]).collect()
    assert len(got) == len(cases)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(cases[r.doc_id]), cases[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_thresholds_adapt_to_the_group(make):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    plain = [" ".join(word() for _ in range(60)) for _ in range(80)]
    marked = [" ".join(word() + ("$$" if rng.random() < 0.3 else "") for _ in range(60)) for _ in range(80)]
    odd = " ".join(word() + "$$" for _ in range(60))
    a = make([(i, t) for i, t in enumerate([*plain, odd])], source="plain")
    b = make([(1000 + i, t) for i, t in enumerate(marked)], source="marked")
    got = {r.doc_id: r for r in quality.quality_rules(a.union(b), ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(80)) and not got[80].kept and got[80].reason == "symbols"
    assert all(got[1000 + i].kept for i in range(80))


def test_null_groups_repeated_rows_and_an_empty_table(make):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make([(1, text), (1, text), (None, text)], lang=None, source=None)
    assert [r.kept for r in quality.quality_rules(docs, ["doc_id"]).collect()] == [True] * 3
    assert quality.quality_rules(docs.limit(0), ["doc_id"]).count() == 0


def test_stage_keeps_columns_and_good_rows(make):
    docs = make([(1, " ".join(f"w{i}" for i in range(30))), (2, "too short"), (3, None)])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_sketches_merge_to_the_sketch_of_all_rows(make, spark):
    rows = spark.range(2000).select(F.lit("l").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), *[((F.col("id") * 37) % 1009).alias(m) for m in [*quality.METRICS, *quality.SIZES]])
    parts = quality.sketches(rows.where("source = '0'")).unionByName(quality.sketches(rows.where("source = '1'"))).groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    whole = quality.sketches(rows).groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def test_sketches_decide_on_the_given_tables():
    """Each group's thresholds are its own: several for each metric, and fixed ones at their median would change verdicts."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.1/documents.parquet')")
    steps = quality.oracle().rpartition("    j AS (SELECT m.*")[0].rstrip().rstrip(",")
    con.execute(f"CREATE TABLE w AS {steps} SELECT * FROM w")
    con.execute(f"CREATE TABLE m AS {steps} SELECT * FROM m WHERE n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words")
    names = [m[2:] for m in quality.METRICS]
    assert all(con.execute(f"SELECT count(DISTINCT t_{t}) FROM w").fetchone()[0] > 1 for t in names)
    own = " OR ".join(f"m_{t} > t_{t}" for t in names)
    fixed = " OR ".join(f"m_{t} > (SELECT median(t_{t}) FROM w)" for t in names)
    rejected, changed = con.execute(f"SELECT count(*) FILTER ({own}), count(*) FILTER (({own}) <> ({fixed})) FROM m JOIN w ON m.lang = w.lang AND m.source = w.source").fetchone()
    assert rejected > 500 and changed > 0


def test_every_rule_can_reject(make):
    """Each threshold lies below the largest value that passes the base rule, and a document planted for each rule is rejected by it."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.1/documents.parquet')")
    steps = quality.oracle().rpartition("    j AS (SELECT m.*")[0].rstrip().rstrip(",")
    con.execute(f"CREATE TABLE w AS {steps} SELECT * FROM w")
    for m, (_, _, most) in quality.METRICS.items():
        below, groups = con.execute(f"SELECT count(*) FILTER (t_{m[2:]} < {most or 100_000}), count(*) FROM w").fetchone()
        assert below > 0.9 * groups, m
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    plain = [" ".join(word() for _ in range(60)) + "\n" + word() for _ in range(300)]
    ten = " ".join(word() for _ in range(10))
    planted = {
        "symbols": " ".join(word() + "$$" for _ in range(60)),
        "marks": " ".join(word() + "!!" for _ in range(60)),
        "upper": " ".join(word().upper() for _ in range(60)),
        "dup_lines": "\n".join([" ".join(word() for _ in range(60)), *["aa bb"] * 7]),
        "repeat": f"{ten} " + " ".join(word() for _ in range(82)) + f" {ten}",
        "word_len": " ".join(word() * 4 for _ in range(60)),
    }
    docs = make(list(enumerate(plain))).union(make([(1000 + k, t) for k, t in enumerate(planted.values())]))
    got = {r.doc_id: r for r in quality.quality_rules(docs, ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(300))
    assert [got[1000 + k].reason for k in range(6)] == list(planted)


def test_a_group_without_a_good_document_and_extreme_texts(make):
    docs = make([(1, "too short"), (2, None)], source="bad").union(make([(3, "w " * 200_000), (4, " ".join(f"w{i}" for i in range(200_000)))], source="long"))
    assert {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in quality.quality_rules(docs, ["doc_id"]).collect()} == {1: (2, True, False), 2: (0, True, False), 3: (200_000, True, False), 4: (200_000, False, True)}


@pytest.mark.parametrize("name", list(quality.ORACLES))
def test_sql(name, same_as_sql):
    same_as_sql(quality.QUERIES[name], quality.ORACLES[name])
