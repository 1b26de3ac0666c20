"""Token counts behind a cache of digests: only texts that no stored count answers are encoded, each once."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table
from .vocab import vocabulary_file

FILE = "byte_bpe_50k.json"
#: Tokens of a sequence; documents of more are marked.
LIMIT = 1024
#: Bytes that are encoded at once, and characters from which a text is cut where no token can cross.
AT_ONCE, LONG = 1 << 20, 1 << 20
#: Misses up to which their keys are sent to every task; of more, the texts are dealt out by key.
SENT = 10_000

#: A single space between letters or digits: the byte-level pattern starts a new match there, whatever stands around.
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


@lru_cache(maxsize=2)
def counter(file: str):
    """(texts -> their numbers of tokens) by the library that reads the file; one for each worker process."""
    if file.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(file)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x.ids) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def _declared(file: str) -> dict:
    return json.loads(Path(file).read_text()) if file.endswith(".json") else {}


def version(file: str) -> str:
    """A digest of all that a count depends on: the file, the library and its version."""
    from importlib.metadata import version as installed

    library = "sentencepiece" if file.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {installed(library)} ".encode() + Path(file).read_bytes()).hexdigest()[:32]


def can_cut(declared: dict) -> bool:
    """Whether texts may be cut at _CUT: byte-level splitting of the text as it is, and no added token with a space."""
    splits = declared.get("pre_tokenizer") or {}
    plain = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space", True)
    tame = all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in declared.get("added_tokens", []))
    return plain and tame and not declared.get("normalizer")


def cut(text: str, size: int = LONG) -> list[str]:
    """The text in parts of about `size` characters whose tokens are together the text's."""
    parts, at = [], 0
    while len(text) - at > size and (found := _CUT.search(text, at + size)):
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def count_tokens(texts: list[str], file: str, cutting: bool) -> list[int]:
    """The number of tokens of each text, AT_ONCE bytes or so at a time."""
    count, out, held, size = counter(file), [0] * len(texts), [], 0

    def add():
        for (i, _), n in zip(held, count([t for _, t in held]), strict=True):
            out[i] += n

    for i, text in enumerate(texts):
        for part in cut(text) if cutting and len(text) > LONG else [text]:
            held.append((i, part))
            size += len(part)
            if size >= AT_ONCE:
                add()
                held, size = [], 0
    if held:
        add()
    return out


class CountCache:
    """Stored counts (digest, n_tokens) for each tokenizer version, as Parquet parts under one folder that all machines see.

    An append is a part of its own, read once it is complete, so writers don't disturb each other or a reader, and an append
    that fails leaves nothing that is read. Two writers may store the same count twice; it is the same number.
    """

    SCHEMA = "digest binary, n_tokens bigint"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self, of: str) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.folder}/tokenizer={of}/part-*/_SUCCESS")) or []
        return sorted(f.getPath().getParent().toString() for f in found)

    def read(self, of: str) -> DataFrame:
        """(digest, n_tokens), each digest once."""
        parts = self.parts(of)
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*parts)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, of: str, rows: DataFrame) -> DataFrame:
        """Stores rows and returns them as stored."""
        path = f"{self.folder}/tokenizer={of}/part-{uuid.uuid4().hex}"
        rows.select("digest", "n_tokens").write.parquet(path)
        return self.spark.read.schema(self.SCHEMA).parquet(path)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _normalised_digests(rows: DataFrame, file: str) -> DataFrame:
    """rows (doc_id, text) -> (doc_id, n_bytes, digest) with the digest of what the tokenizer's own normaliser makes of the text.

    A text that holds an added token's string is digested as it is, as such strings are found before the normaliser runs.
    """
    added = [t["content"] for t in _declared(file)["added_tokens"]]

    def run(batches):
        from tokenizers import Tokenizer

        normal = Tokenizer.from_file(file).normalizer.normalize_str
        for b in batches:
            texts = b.column(1).to_pylist()
            digests = [hashlib.sha256(f"as it is {t}".encode() if any(x in t for x in added) else normal(t).encode()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "n_bytes", "digest"])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, digest binary")


def _keyed(docs: DataFrame, file: str, with_text: bool) -> DataFrame:
    """(doc_id, n_bytes, digest, place[, text]); place tells a row from most others, and equal rows not apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if _declared(file).get("normalizer"):
        keyed = _normalised_digests(rows, file)
        place = F.xxhash64(F.coalesce("doc_id", F.lit(0)), "n_bytes")
        return rows.select("text", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.octet_length("text").cast("long")).alias("place")) if with_text else keyed.withColumn("place", place)
    keyed = rows.withColumns({"n_bytes": F.octet_length("text").cast("long"), "digest": _digest(F.col("text"))})
    keyed = keyed.withColumn("place", F.xxhash64(F.coalesce("doc_id", F.lit(0)), "digest"))
    return keyed.select("text", "place") if with_text else keyed.drop("text")


def counted(docs: DataFrame, keyed: DataFrame, cache: CountCache, file: str) -> tuple[DataFrame, int]:
    """((digest, n_tokens) of all digests of `keyed`, how many of them the cache did not have).

    Of each digest without a stored count one row is encoded, and its count appended. The row is the one of the least `place`;
    where places meet by chance or rows repeat, a text more is encoded and its count stored under its own digest, so a chance costs
    time and never a wrong count.
    """
    of = version(file)
    asked = keyed.groupBy("digest").agg(F.min("place").alias("place")).join(cache.read(of), "digest", "left")
    asked = stored(asked, "token-digests")
    known, missing = asked.where("n_tokens IS NOT NULL").select("digest", "n_tokens"), asked.where("n_tokens IS NULL")
    n = missing.count()
    if not n:
        return known, 0
    places = missing.select("place")
    texts = _keyed(docs, file, with_text=True).join(F.broadcast(places) if n <= SENT else places.hint("shuffle_hash"), "place", "left_semi").select("text")
    declared = _declared(file)
    cutting, added = can_cut(declared), [t["content"] for t in declared.get("added_tokens", [])]
    normalises = bool(declared.get("normalizer"))

    def run(batches):
        normal = None
        if normalises:
            from tokenizers import Tokenizer

            normal = Tokenizer.from_file(file).normalizer.normalize_str
        for b in batches:
            texts = list(dict.fromkeys(b.column(0).to_pylist()))
            kept = [f"as it is {t}" if any(x in t for x in added) else normal(t) for t in texts] if normal else texts
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, pa.array(count_tokens(texts, file, cutting), pa.int64())], ["digest", "n_tokens"])

    new = cache.append(of, texts.mapInArrow(run, CountCache.SCHEMA))
    # Stored without an aggregation on the way to the join that follows, whose other side holds all copies of a text.
    return stored(known.unionByName(new).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "token-counts"), n


def token_counts(docs: DataFrame, cache: CountCache, file: str, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit), a row for each row.

    Counts are the library's: no begin, end or added special tokens, strings of special tokens as it takes them by
    default, nothing cut or padded. A null text is an empty one and has none. Rows that repeat a doc_id are rows of their
    own, null ids too; other columns are not read. Texts of over LONG characters are encoded in parts whose tokens add up,
    where the tokenizer lets it (`can_cut`), and whole elsewhere. No row: no row. The cache holds every text's count afterwards.
    """
    keyed = stored(_keyed(docs, file, with_text=False), "token-keys")
    counts, _ = counted(docs, keyed, cache, file)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own that is empty at first, so that the figures of a run are those of a whole count."""
    cache = CountCache(spark, f"{shared_dir(spark)}/docloom/token-cache-{uuid.uuid4().hex}")
    return token_counts(table(spark, sf_dir, "documents"), cache, vocabulary_file(FILE))


QUERIES = {"op11_token_counts": op11}
