"""Language of pages by Bayesian fusion: text likelihoods, declared markup language, address suffix, smoothed host priors."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .urls import host_of

#: Trigrams of characters are hashed to BUCKETS numbers, so the text model has languages * BUCKETS numbers at most, however large
#: the corpus. Only those that occur are kept, so rare values of a dirty column cost what their few texts hold.
BUCKETS = 1 << 16
#: A text's trigrams depend on each other, so all together count as WEIGHT of them at most.
WEIGHT = 60.0
#: Pseudo-counts: of a trigram, of a declared language or suffix given the language, of the level above in the host priors.
ALPHA, BETA, STRENGTH = 0.5, 1.0, 5.0

#: Markup; what isn't closed reaches to the end, and no tag holds another `<`, so each character is looked at a bounded number of times.
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1[^<>]*>|\Z)|<[^<>]*>|&[#\w]{1,32};", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]+)", re.I)


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of a whole text in lower case, runs of white space as one space."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    h = (points[:-2] * np.uint64(961_748_941) + points[1:-1]) * np.uint64(982_451_653) + points[2:]
    return ((h ^ (h >> np.uint64(17))) % np.uint64(BUCKETS)).astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], tuple[np.ndarray, ...]]:
    """docs (text, lang, ...) -> (languages in order, model); counts cover all documents.

    model: for each bucket where its entries start, each entry's language and how much its log probability exceeds that
    of a bucket that the language hasn't, and that log probability by language. Each task adds up counts and hands over one row for each
    language and bucket that it met. Null languages and texts take no part. No document: no language.
    """

    def run(batches):
        n: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                at, c = np.unique(trigrams(text.as_py()), return_counts=True)
                n[lang.as_py()].update(dict(zip(at.tolist(), c.tolist(), strict=True)))
        for lang, c in n.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["lang", "bucket", "n"])

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = stored(known.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    got = counts.toArrow()  # at most languages * BUCKETS rows
    langs, own = np.unique(np.array(got.column("lang").to_pylist(), object), return_inverse=True)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy().astype(float)
    total = np.bincount(own, n, len(langs)) + ALPHA * BUCKETS
    by = np.lexsort((own, bucket))
    starts = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))
    return langs.tolist(), (starts, own[by].astype(np.int32), np.log((n[by] + ALPHA) / ALPHA), np.log(ALPHA / total))


def log_likelihoods(t: np.ndarray, model: tuple[np.ndarray, ...]) -> np.ndarray:
    """By language, of trigrams t, all together weighing as WEIGHT of them at most; none: zeros."""
    starts, own, more, least = model
    if not len(t):
        return np.zeros(len(least))
    n = starts[t + 1] - starts[t]
    entry = np.arange(n.sum()) + np.repeat(starts[t] - np.cumsum(n) + n, n)
    return (len(t) * least + np.bincount(own[entry], more[entry], len(least))) * min(1.0, WEIGHT / len(t))


def text_evidence(pages: DataFrame, model: tuple[np.ndarray, ...]) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, declared, ll: tempered log likelihoods by language); no text: zeros."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in batches:
            for at in range(0, b.num_rows, 128):
                p = b.slice(at, 128)
                declared, ll = [], []
                for html in p.column(2).to_pylist():
                    said = _DECLARED.search(html or "")
                    declared.append(said[1].lower() if said else "")
                    ll.append(log_likelihoods(trigrams(_DROP.sub(" ", html or "")), model))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(declared), pa.array(ll, pa.list_(pa.float64()))], ["page_id", "url", "declared", "ll"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, declared string, ll array<double>")


def _softmax(x: Column) -> Column:
    top = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(top, lambda v: v / F.aggregate(top, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, key: list[str], size: int, name: str) -> DataFrame:
    """Posterior mass of each language by key, as an array; combined before the shuffle."""
    return rows.groupBy(*key).agg(F.array(*[F.sum(F.get("post", F.lit(i))) for i in range(size)]).alias(name))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def language_id(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...), docs (text, lang, ...) -> (page_id, lang, probability, text_lang, declared).

    The text's likelihoods give first posteriors. Grouped sums of those give P(declared | language), P(suffix |
    language) and each host's prior: a host leans on its domain (its last two labels) and a domain on the whole table,
    each without the page itself, which would vouch for its own reading. All logs are added and normalised.
    A null html has no text and declares nothing; a null url has the host ''. A declared language that no document has
    is evidence like any other value. Ties go to the first language by name. Repeated rows give repeated rows. Without
    documents lang is null. Other columns are not read. Whole pages count, however long; time grows with a page's length.
    """
    langs, model = train(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"))])
    n = len(langs)
    host = host_of(F.col("url"))
    rows = text_evidence(pages, model).select("page_id", "declared", "ll", host.alias("host"))
    labels = F.split("host", r"\.")
    rows = rows.withColumns({"suffix": F.element_at(labels, -1), "domain": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."), "post": _softmax(F.col("ll"))})
    rows = stored(rows, "page-text")
    every = _sums(rows, [], n, "s").first()["s"]  # one row of n numbers
    every = [x or 0.0 for x in every]
    share = [(x + 1) / (sum(every) + n) for x in every]
    given = {k: _sums(rows, [k], n, f"n_{k}") for k in ("declared", "suffix", "domain", "host")}
    for k, sums in given.items():
        rows = rows.join(sums, k)
    mass, prior = F.array(*map(F.lit, every)), F.array(*map(F.lit, share))
    rest = lambda a: F.zip_with(a, "post", lambda x, p: F.greatest(x - p, F.lit(0.0)))
    likely = lambda a: F.zip_with(rest(a), rest(mass), lambda x, m: F.log((x + BETA / n) / (m + BETA)))
    leaning = lambda a, above: F.zip_with(rest(a), above, lambda x, p: (x + STRENGTH * p) / (_total(rest(a)) + STRENGTH))
    rows = rows.withColumn("p_domain", leaning("n_domain", prior)).withColumn("p_host", leaning("n_host", F.col("p_domain")))
    rows = rows.withColumns({"l_declared": likely("n_declared"), "l_suffix": likely("n_suffix")})
    score = F.transform(F.col("ll"), lambda x, i: x + F.log(F.get("p_host", i)) + F.get("l_declared", i) + F.get("l_suffix", i))
    rows = rows.select("page_id", "declared", "post", score.alias("score")).withColumn("p", _softmax(F.col("score")))
    named = lambda a: F.get(F.array(*map(F.lit, langs)), (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return rows.select("page_id", named(F.col("p")).alias("lang"), F.array_max("p").alias("probability"), named(F.col("post")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = {"op4_language_id": op4}
