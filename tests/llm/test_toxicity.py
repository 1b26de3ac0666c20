import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import toxicity


def corpus(seed, n=600):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = [word() for _ in range(rng.randrange(5, 60))]
        if toxic:
            text += [rng.choice(["zonkhead", "zonkface", "vile", "qrudmouth"]) for _ in range(2)]
            rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_defined_cases(make, spark):
    rows, labels = corpus(1)
    extra = [(9001, None), (9002, ""), (9003, "word " * 30_000), (None, "vile"), (0, rows[0][1])]
    docs = make(rows + extra)
    lab = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, lab)).collect()
    assert len(got) == len(rows) + len(extra)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (9001, 9002, 9003))


def test_held_out_labels_change_nothing(make, spark):
    rows, labels = corpus(2, 200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    docs = make(rows)
    models = [toxicity.fit_toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("feature").collect() for x in (labels, flipped)]
    assert [r.feature for r in models[0]] == [r.feature for r in models[1]]
    assert np.allclose([r.weight for r in models[0]], [r.weight for r in models[1]])


def test_no_labels_and_no_documents(make, spark):
    docs = make([(1, "a"), (2, None)])
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, lab)).collect()
    assert len(got) == 2
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit_toxicity(docs, lab)).count() == 0


def test_label_model_recovers_accuracies_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.15
    votes = np.column_stack([rng.random(6000) < np.where(y, a, b) for a, b in ((0.6, 0.01), (0.5, 0.02), (0.4, 0.01), (0.5, 0.03))])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])
    q, p = toxicity.label_model(votes)
    assert ((q > 0.5) == y).mean() > 0.93
    assert abs(p["a"][1] - 0.5) < 0.12 and p["b"][1] < 0.1 and p["weight"][0] < 0.6 < p["weight"][1]


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
