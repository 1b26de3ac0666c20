import re
from collections import Counter

import numpy as np

from docloom.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows):
    groups, docs, out = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(terms_of(text))
        docs.setdefault(lang, Counter()).update(set(terms_of(text)))
    for lang, counts in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= dv.LEAST_DOCS]
        whole = Counter({t: sum(c[t] for c in counts.values()) for t in kept})
        share = lambda c: {t: 1 + dv.SCALE * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            apart = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(apart, 1)}
            best = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[: dv.TOLD]
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(best, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "text string, lang string, source string, n long, term string, tile int, i int").repartition(4)


def some():
    own = np.random.default_rng(5)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)] + ["Über", "ÜBER", "X", "é_é", "漢字"]
    rows = []
    for k in range(400):
        source = None if k % 3 == 0 else f"s{k % 7}"  # one source has a third
        favourite = own.permutation(len(words))[: 10 + k % 7]
        rows.append((" ".join(words[i] for i in own.choice(favourite, 25)), ["en", None, "de"][k % 2], source))
    return rows + [(None, "fr", "a"), ("", "fr", "b"), ("one\x00two", "fr", "b"), ("only", "it", "z")] + rows[:30]


def test_rows_are_the_brute_force_ones(spark):
    got = [tuple(r) for r in dv.divergence(frame(spark, some())).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(some())
    assert {r[4] for r in got if r[0] == "fr"} == {0}


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    """Many blocks of terms, tiles of two groups, counts handed on early."""
    for name, value in (("BLOCK", 7), ("SIDE", 2), ("HELD", 20)):
        monkeypatch.setattr(dv, name, value)
    assert {tuple(r) for r in dv.divergence(frame(spark, some())).collect()} == brute(some())


def test_ties_are_in_order_of_their_bytes(spark):
    names = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(60)] + ["ﬁ", "𝒳"]
    rows = [(" ".join(names), "en", "a")] * 30 + [("", "en", "b"), ("zz zz zz", "en", "b")] * 30
    assert {tuple(r) for r in dv.divergence(frame(spark, rows)).collect()} == brute(rows)


def test_a_long_text_is_split_like_a_short_one(monkeypatch):
    text = ("Abc déf,x " * 50 + "long" * 40 + " end").encode()
    whole = [t for part in dv.split_terms(text) for t in part]
    monkeypatch.setattr(dv, "PIECE", 7)
    assert [t for part in dv.split_terms(text) for t in part] == whole == [t.encode() for t in terms_of(text.decode())]


def test_shares_are_exact():
    big = 10**15
    counts, totals = np.array([[0, 1, big - 7], [3, 0, 0]]), np.array([big - 6, 3])
    want = [[1 + dv.SCALE * (int(c) + 5) // (int(t) + 15) for c in row] for row, t in zip(counts, totals, strict=True)]
    assert dv.shares(counts, totals, 3).tolist() == want
    assert dv.shares(np.array([[4]]), np.array([4]), 1).tolist() == [[1 + dv.SCALE]]


def test_no_row(spark):
    assert dv.divergence(frame(spark, [])).count() == 0


def test_sql_at_the_smallest_tables(same_as_sql):
    same_as_sql(dv.op13, dv.ORACLE)
