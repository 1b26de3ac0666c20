"""Embedding plug point: any object with get_embedding(text) -> list of floats or None."""

import hashlib
import random
from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def get_embedding(self, text: str) -> list[float] | None: ...


class FakeEmbedder:
    """Unit vectors of Gaussians seeded by the text's MD5: equal texts, equal vectors."""

    def __init__(self, width: int = 1536):
        self.width = width

    def get_embedding(self, text: str) -> list[float]:
        own = random.Random(int(hashlib.md5(text.encode()).hexdigest(), 16))
        v = [own.gauss(0, 1) for _ in range(self.width)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v


def embedding(text: Column, embedder: Embedder) -> Column:
    """The text's vector; null for a null text and wherever the embedder fails."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else embedder.get_embedding(t)
            except Exception:
                return None

        return texts.map(one)

    return run(text)


def with_embeddings(rows: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    return rows.withColumn(out, embedding(F.col(text), embedder))


#: Texts of one request, and how often a failed request is sent again.
AT_ONCE, RETRIES = 64, 2


def _request(embedder, texts: list[str], retries: int) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A request of several texts that keeps failing is split, so that a bad text fails alone."""
    many = getattr(embedder, "get_embeddings", None) or (lambda own: [embedder.get_embedding(t) for t in own])
    for left in range(retries, -1, -1):
        try:
            found = many(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return [(list(v), None) if v is not None else (None, "no vector") for v in found]
        except Exception as e:
            if not left and len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
    half = len(texts) // 2
    return _request(embedder, texts[:half], retries) + _request(embedder, texts[half:], retries)


def embedded(rows: DataFrame, text: str, embedder, out: str = "embedding", error: str = "embedding_error", at_once: int = AT_ONCE, retries: int = RETRIES) -> DataFrame:
    """rows with the text's vector and what kept it from having one; of the two one is null.

    embedder has get_embeddings(texts), or get_embedding(text), and may raise or give None for a text. Equal texts are asked for
    once, `at_once` of them in a request; a request that fails is sent again `retries` times, then in halves. A null text has
    the error `no text`.
    """

    @F.pandas_udf("vector array<double>, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        asked, found = texts.tolist(), []
        for at in range(0, len(asked), at_once):
            found += _request(embedder, asked[at : at + at_once], retries)
        return pd.DataFrame({"vector": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    found = rows.select(F.col(text).alias("_t")).where("_t IS NOT NULL").distinct().withColumn("_e", run(F.col("_t")))
    found = rows.join(found, F.col(text) == F.col("_t"), "left")
    missing = F.when(F.col(text).isNull(), F.lit("no text")).otherwise(F.col("_e.error"))
    return found.withColumns({out: F.col("_e.vector"), error: missing}).drop("_t", "_e")


def first_working(backends: Sequence[Embedder], probe: str = "probe") -> Embedder | None:
    """The first backend that gives a vector for `probe`, as the local one if the server is away; None if none does."""
    for backend in backends:
        try:
            if backend.get_embedding(probe):
                return backend
        except Exception:
            continue
    return None
