"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Labelled rows that the models are fitted on at most: those with the least hash of their id.
FIT_ROWS = 40_000
#: Features: a word and its beginnings of these lengths, hashed to SPACE numbers.
BEGINNINGS = (4, 5, 6)
SPACE = 1 << 20
OFTEN = (2, 4, 8)
#: A feature may vote if it has LEAST toxic rows and at least PRECISION of its rows are toxic; voters at most.
LEAST, PRECISION, VOTERS = 5, 0.8, 96
#: Features of the classifier: rows they occur in at least, and standard errors by which their share of posterior differs.
ROWS, APART = 3, 3.0
STRIP = "\"'.,;:!?()[]{}<>|*%&$#-_=+/\\~`«»¿¡…“”‘’"
#: Pattern voters: (name, share of a text's characters from which it fires).
PATTERNS = [("shouting", 0.5), ("marks", 0.03)]


def word_features(token: str) -> list[int]:
    """Numbers of a lower-case token's word and beginnings; none for a token of marks alone."""
    w = token.strip(STRIP)
    if not w:
        return []
    parts = [f"w:{w}", *(f"b{n}:{w[:n]}" for n in BEGINNINGS if len(w) >= n)]
    return [zlib.crc32(p.encode()) % SPACE for p in parts]


def text_features(text: str, known: dict[str, list[int]]) -> np.ndarray:
    """Distinct feature numbers of a whole text, those that OFTEN distinct tokens share also as features of their own; known remembers tokens."""
    found: list[int] = []
    for token in set(text.lower().split()):
        f = known.get(token)
        if f is None:
            if len(known) > 200_000:
                known.clear()
            f = known[token] = word_features(token)
        found += f
    one, n = np.unique(np.array(found, np.int64), return_counts=True)
    shared = [(one[n >= k] * 40503 + k) % SPACE for k in OFTEN]
    return np.unique(np.concatenate([one, *shared])).astype(np.int32)


def text_patterns(text: str) -> list[bool]:
    n = max(1, len(text))
    upper = sum(map(str.isupper, text))
    return [upper / n >= PATTERNS[0][1], text.count("!") / n >= PATTERNS[1][1]]


def label_model(votes: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """votes (rows x voters, bool) -> (posterior of class 1 per row, parameters), without labels.

    Two latent classes; a voter fires with rate a in class 1 and b in class 0, found by expectation maximisation from
    the start that a row with a vote is of class 1. A silent voter abstains; that all abstain is a vote of its own.
    Voters that still agree within a class (a word and its stem) are correlated, and a voter's evidence is divided by
    one plus its correlations, so copies of a voter count about once.
    """
    v = np.column_stack([votes, ~votes.any(axis=1)]).astype(float)
    q = np.clip(votes.any(axis=1).astype(float), 0.02, 0.98)
    weight = np.ones(v.shape[1])
    a = b = np.zeros(v.shape[1])
    for k in range(rounds):
        a = (q @ v + 0.5) / (q.sum() + 1)
        b = ((1 - q) @ v + 0.05) / ((1 - q).sum() + 1)
        if k % 5 == 0:
            left = v - np.outer(q, a) - np.outer(1 - q, b)
            cov = left.T @ left / len(v)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = cov / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.clip(corr - 0.2, 0, None).sum(axis=1))
        prior = np.clip(q.mean(), 1e-4, 0.5)
        q = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + v @ (weight * np.log(a / b)), -30, 30)))
    return q, {"a": a, "b": b, "weight": weight}


def fit_linear(rows: list[np.ndarray], q: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) of a logistic regression on posterior labels, over features that tell the classes apart."""
    n = np.bincount(np.concatenate(rows), minlength=SPACE).astype(float)
    s = np.bincount(np.concatenate(rows), np.repeat(q, [len(r) for r in rows]), minlength=SPACE)
    base = q.mean()
    z = (s - n * base) / np.sqrt(np.maximum(n * base * (1 - base), 1e-9))
    chosen = np.flatnonzero((n >= ROWS) & (np.abs(z) >= APART))
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    local = [p[p >= 0] for p in (place[r] for r in rows)]
    at, of = np.concatenate(local), np.repeat(np.arange(len(rows)), [len(x) for x in local])
    w, bias, seen, seen_b = np.zeros(len(chosen)), float(np.log(base / (1 - base))), np.full(len(chosen), 1e-6), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], minlength=len(rows)) + bias, -30, 30)))
        g = np.bincount(at, (p - q)[of], minlength=len(chosen)) / len(rows) + ridge * w
        gb = float((p - q).mean())
        seen += g * g
        seen_b += gb * gb
        w -= 0.5 * g / np.sqrt(seen)
        bias -= 0.5 * gb / np.sqrt(seen_b)
    return chosen, w, bias


def _fit(batches):
    """One task over the bounded sample: voters, label model, classifier."""
    rows, patterns, toxic = [], [], []
    for b in batches:
        rows += [np.array(x, np.int32) for x in b.column(0).to_pylist()]
        patterns += b.column(1).to_pylist()
        toxic += b.column(2).to_pylist()
    y = np.array(toxic, float)
    if y.sum() < LEAST or y.sum() == len(y):
        rate = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
        yield _model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
        return
    n = np.bincount(np.concatenate(rows), minlength=SPACE)
    s = np.bincount(np.concatenate(rows), np.repeat(y, [len(r) for r in rows]), minlength=SPACE)
    may = np.flatnonzero((s >= LEAST) & (s >= PRECISION * n))
    voters = may[np.lexsort((may, -s[may]))][:VOTERS]
    place = np.full(SPACE, -1, np.int32)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(rows), len(voters) + len(PATTERNS)), bool)
    for i, r in enumerate(rows):
        p = place[r]
        votes[i, p[p >= 0]] = True
    votes[:, len(voters) :] = patterns
    # A pattern that doesn't go with the lexicon tells nothing of its class and is left out before the model.
    said = votes[:, : len(voters)].any(axis=1)
    keep = [j for j in range(votes.shape[1]) if j < len(voters) or votes[said, j].mean() > 3 * max(votes[~said, j].mean(), 1e-3)]
    if not len(voters):
        yield _model(np.zeros(0, np.int64), np.zeros(0), float(np.log(y.mean() / (1 - y.mean()))))
        return
    q, _ = label_model(votes[:, keep])
    yield _model(*fit_linear(rows, q))


def _model(features: np.ndarray, weights: np.ndarray, bias: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*features.tolist(), -1], pa.int64()), pa.array([*weights.tolist(), bias], pa.float64())], ["feature", "weight"])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(feature, weight), with the bias at feature -1: at most SPACE + 1 rows. Held-out rows take no part.

    A doc_id with several labels is toxic if one says so. The sample is bounded by fit_rows, and is gone through in one
    task as lists of numbers.
    """
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def features(batches):
        known: dict[str, list[int]] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([text_features(t, known) for t in texts], pa.list_(pa.int32())), pa.array([text_patterns(t) for t in texts], pa.list_(pa.bool_())), part.column(1)],
                    ["features", "patterns", "toxic"],
                )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    sample = rows.mapInArrow(features, "features array<int>, patterns array<boolean>, toxic int")
    return stored(sample, "toxicity-sample").coalesce(1).mapInArrow(_fit, "feature long, weight double")


def score_toxicity(docs: DataFrame, model: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, held_out, score, predicted); model as of fit_toxicity (bounded, so it goes to every task).

    Whole texts are scored; null and empty texts get the bias. Repeated rows get equal scores, null doc_ids count as
    held out. No other column is read.
    """
    rows = model.collect()  # at most SPACE + 1 rows
    weights = np.zeros(SPACE + 1)
    for r in rows:
        weights[r["feature"]] = r["weight"]
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        weights, known = held.value, {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = []
                for t in part.column(1).to_pylist():
                    f = text_features(t or "", known)
                    out.append(1 / (1 + np.exp(-np.clip(weights[f].sum() + weights[-1], -30, 30))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_toxicity": op7}
