"""Text files and the chunk store."""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import basename
from ..operators.route import SUFFIXES, has_suffix


def _matches(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern of paths names anything, in whatever file system it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_texts(spark: SparkSession, paths: list[str] | str, suffixes=SUFFIXES) -> DataFrame:
    """(path, filename, text) of the text files under paths: whole files, line ends as \\n. Other suffixes, files that are empty or not valid UTF-8 and missing paths give no row."""
    found = [p for p in ([paths] if isinstance(paths, str) else paths) if _matches(spark, p)]
    if not found:
        return spark.createDataFrame([], "path string, filename string, text string")
    return _texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(found), suffixes)


def text_stream(spark: SparkSession, folder: str, suffixes=SUFFIXES, files_at_once: int = 1000) -> DataFrame:
    """The same rows as a stream of the files that come to a folder. A path is read once; files that change in place are found by reading the folder again (`ChunkStore.ingest`)."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return _texts(source.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(folder), suffixes)


def _texts(raw: DataFrame, suffixes) -> DataFrame:
    good = raw.where(has_suffix(F.col("path"), suffixes)).where("is_valid_utf8(CAST(content AS STRING))")
    return good.select("path", basename(F.col("path")).alias("filename"), F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n").alias("text"))


class CommitConflict(Exception):
    """Another writer took the version, or changed what a rewrite has read."""


class ChunkStore:
    """Chunk rows as data files under one folder, and a log that says which of them are the store.

    `_log/<version>.json` is one commit: the data folder it adds, what the new rows replace (nothing, rows of their
    (filename, chunk_id), or all rows of their filenames), whether all older rows go, the batch it came from, and whether
    digests of whole files lie beside its rows. A commit's
    data is written first and counts once its file is there, so a reader never sees half of one, and each write costs what it
    brings. Of two writers one gets a version and the other tries the next one: both commits stay. Replaced names are kept as
    tombstones beside the data; older rows of theirs are left out when reading and gone after `compact`.

    A version's file is put only if it is absent: by a hard link in a local or mounted folder, by a rename that doesn't
    overwrite elsewhere, as in HDFS. A store that overwrites on rename is good for one writer at a time.
    """

    LOG = "version long, data string, replaces string, clears boolean, batch string, ledger boolean"
    LEDGER = T.StructType([T.StructField("filename", T.StringType()), T.StructField("path", T.StringType()), T.StructField("digest", T.StringType())])
    #: Columns whose values new rows replace, by what a commit says.
    KEYS = {"nothing": [], "chunks": ["filename", "chunk_id"], "files": ["filename"]}
    TRIES = 100
    #: Names of new files up to which they are sent to where texts are read; beyond it texts are shuffled to meet them.
    SENT = 500_000

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list:
        """The commits that count, oldest first: those since the last one that clears."""
        if not self._fs.globStatus(self._path(f"{self.folder}/_log/*.json")):
            return []
        rows = sorted(self.spark.read.schema(self.LOG).json(f"{self.folder}/_log/*.json").collect(), key=lambda r: r.version)
        last = max([k for k, r in enumerate(rows) if r.clears], default=0)
        return rows[last:]

    def version(self) -> int:
        """The newest commit's number, 0 for none."""
        log = self._log()
        return log[-1].version if log else 0

    def _put(self, version: int, commit: dict) -> bool:
        """Writes a commit under its number unless there is one."""
        target = self._path(f"{self.folder}/_log/{version:012d}.json")
        draft = self._path(f"{self.folder}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, **commit}).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            return not self._fs.exists(target) and self._fs.rename(draft, target)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)

    def _commit(self, replaces: str = "nothing", data: str | None = None, clears: bool = False, batch: str | None = None, read: int | None = None, ledger: bool = False) -> int:
        """Adds a commit after the newest one; with `read` only if that is still the newest."""
        version = self.version() if read is None else read
        for _ in range(self.TRIES):
            if self._put(version + 1, {"data": data, "replaces": replaces, "clears": clears, "batch": batch, "ledger": ledger}):
                return version + 1
            if read is not None:
                break
            version += 1
        raise CommitConflict(f"version {version + 1} of {self.folder} is taken")

    def read(self, version: int | None = None, commits: bool = False) -> DataFrame:
        """The store's rows, or those of an older version that isn't compacted away; an empty table if nothing was written. With commits each row's `version` too."""
        log = [r for r in self._log() if version is None or r.version <= version]
        layers = [(r, f"{self.folder}/{r.data}") for r in log if r.data]
        if not layers:
            return self.spark.createDataFrame([], T.StructType([*schemas.CHUNK, *([T.StructField("version", T.LongType())] if commits else [])]))
        rows = self._live(layers, layers, "rows", schemas.CHUNK)
        return rows.select(*schemas.CHUNK.names, *([F.col("_version").cast("long").alias("version")] if commits else []))

    def _live(self, layers: list, of: list, what: str, schema: T.StructType) -> DataFrame:
        """Rows of the commits `of` without those that a later commit of layers has replaced; commits with none after them that replaces are read as they are."""
        last = max([r.version for r, _ in layers if self.KEYS[r.replaces]], default=0)
        parts = [self._read(new, what, schema)] if (new := [x for x in of if x[0].version >= last]) else []
        if old := [x for x in of if x[0].version < last]:
            rows = self._read(old, what, schema)
            for how, key in self.KEYS.items():
                gone = [x for x in layers if x[0].replaces == how and key and set(key) <= set(schema.names)]
                if gone:
                    kinds = T.StructType([schemas.CHUNK[c] for c in key])
                    cut = self._read(gone, "replaced", kinds).groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.max("_version").alias("_cut"))
                    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
                    rows = rows.join(cut, same, "left").where("_cut IS NULL OR _version >= _cut").drop("_cut", *[f"_{c}" for c in key])
            parts.append(rows)
        return functools.reduce(DataFrame.unionByName, parts)

    def ledger(self) -> DataFrame:
        """(filename, path, digest, version): the content of each file that `ingest` brought and nothing has replaced or removed since, and the commit it came with."""
        layers = [(r, f"{self.folder}/{r.data}") for r in self._log() if r.data]
        if not (kept := [x for x in layers if x[0].ledger]):
            return self.spark.createDataFrame([], "filename string, path string, digest string, version long")
        return self._live(layers, kept, "files", self.LEDGER).withColumn("version", F.col("_version").cast("long")).drop("_version")

    def ingest(self, texts: DataFrame, chunks: Callable[[DataFrame], DataFrame], batch: str | None = None) -> int | None:
        """Brings files (path, filename, text) whose content the ledger does not have; returns the commit's version, None if nothing is new.

        Only such files are chunked, by chunks(texts), and theirs replace all older rows of the filename, also if there are none, as
        for a null text. Rows and digests are one commit, so a run that breaks off has done nothing, and a batch that was committed, or
        comes again, writes nothing. Of files of one name the last by path counts, and rows without a name or path are left out. Names and digests are what is joined; texts are not shuffled for the comparison.
        """
        if batch is not None and batch in self.batches():
            return None
        texts = texts.where("filename IS NOT NULL AND path IS NOT NULL").select("path", "filename", "text")
        found = texts.groupBy("filename").agg(F.max(F.struct("path", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest"))).alias("_f")).select("filename", "_f.path", "_f.digest")
        data = f"data/{uuid.uuid4().hex}"
        found.join(self.ledger().select("filename", "digest"), ["filename", "digest"], "left_anti").select(*self.LEDGER.names).write.parquet(f"{self.folder}/{data}/files")
        new = self.spark.read.schema(self.LEDGER).parquet(f"{self.folder}/{data}/files")
        if not (n := new.count()):
            self._fs.delete(self._path(f"{self.folder}/{data}"), True)
            return None
        names = new.select("filename", "path")
        rows = chunks(texts.join(F.broadcast(names) if n <= self.SENT else names, ["filename", "path"], "left_semi"))
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.CHUNK]).write.parquet(f"{self.folder}/{data}/rows")
        new.select("filename").write.parquet(f"{self.folder}/{data}/replaced")
        return self._commit("files", data, batch=batch, ledger=True)

    def _read(self, layers: list, what: str, schema: T.StructType) -> DataFrame:
        """Rows of commits' folders with their `_version`."""
        rows = self.spark.read.schema(schema).parquet(*[f"{path}/{what}" for _, path in layers])
        versions = F.create_map(*[F.lit(x) for r, _ in layers for x in (r.data, r.version)])
        return rows.withColumn("_version", F.element_at(versions, F.regexp_extract("_metadata.file_path", r"/(data/[0-9a-f]+)/", 1)))

    def _written(self, rows: DataFrame, replaces: str) -> str:
        data, key = f"data/{uuid.uuid4().hex}", self.KEYS[replaces]
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.CHUNK])
        rows.write.parquet(f"{self.folder}/{data}/rows")
        if key:
            self.spark.read.schema(schemas.CHUNK).parquet(f"{self.folder}/{data}/rows").select(*key).distinct().write.parquet(f"{self.folder}/{data}/replaced")
        return data

    def append(self, rows: DataFrame, batch: str | None = None) -> int:
        """Adds rows beside what is there. Each of these returns the commit's version."""
        return self._commit(data=self._written(rows, "nothing"), batch=batch)

    def upsert(self, rows: DataFrame, batch: str | None = None) -> int:
        """Replaces rows of equal (filename, chunk_id); of new rows with one key the last by content stays."""
        return self._commit("chunks", self._written(_last_of(rows), "chunks"), batch=batch)

    def replace_files(self, rows: DataFrame, batch: str | None = None) -> int:
        """Replaces all rows of the filenames that rows have, so that a file that has become shorter leaves no old chunk."""
        return self._commit("files", self._written(rows, "files"), batch=batch)

    def remove_files(self, names: DataFrame) -> int:
        """Removes all rows of the filenames in names (filename)."""
        data = f"data/{uuid.uuid4().hex}"
        self.spark.createDataFrame([], schemas.CHUNK).write.parquet(f"{self.folder}/{data}/rows")
        names.select("filename").distinct().write.parquet(f"{self.folder}/{data}/replaced")
        return self._commit("files", data)

    def clear(self) -> int:
        return self._commit(clears=True)

    def compact(self) -> int:
        """Rewrites the store as one commit; CommitConflict if another came in between, and nothing has changed then."""
        read = self.version()
        data = self._written(self.read(read), "nothing")
        self.ledger().select(*self.LEDGER.names).write.parquet(f"{self.folder}/{data}/files")
        return self._commit(data=data, clears=True, read=read, ledger=True)

    def batches(self) -> set[str]:
        """The batches that commits since the last clearing name."""
        return {r.batch for r in self._log() if r.batch}


def _last_of(rows: DataFrame) -> DataFrame:
    last = Window.partitionBy("filename", "chunk_id").orderBy(F.desc("content"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the keys of new, and new; of rows of new with one key the last by content stays."""
    key, new = ["filename", "chunk_id"], _last_of(new)
    return old.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def read_store_file(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of a store kept as one JSON file; a broken file gives no row."""
    file = spark.read.schema(schemas.STORE_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return file.select(F.inline("documents"))
