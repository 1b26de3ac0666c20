"""Query rewriting by a table of phrases (ord, phrase, expansion); phrases are lower-case."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A dictionary up to this many rows and characters goes to every task; a larger one is dealt out.
BROADCAST_ROWS, BROADCAST_LETTERS = 200_000, 8_000_000
#: Phrases of one automaton and texts that a task reads with it, where a dictionary is dealt out.
SHARD, TEXTS = 100_000, 20_000


class Phrases:
    """An automaton over phrases that reads a text once and finds the longest phrase in it."""

    def __init__(self, rows):
        """rows: (ord, phrase, expansion). Of equal phrases the least ord counts (null before all); null phrases don't."""
        self.rows, self.automaton = {}, ahocorasick.Automaton()
        for ord_, phrase, expansion in rows:
            if phrase is not None:
                rank = (ord_ is not None, ord_ or 0)
                if phrase not in self.rows or rank < self.rows[phrase][0]:
                    self.rows[phrase] = (rank, expansion)
        for phrase, (rank, _) in self.rows.items():
            if phrase:
                self.automaton.add_word(phrase, (len(phrase), rank, phrase))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str, low: str) -> tuple[bool, str, int] | None:
        """(whether the whole stripped text is the phrase, the phrase, where it first is), or None; low: the text in lower case.

        In a text whose lower case has another length only the whole text can be a phrase, as places differ.
        """
        bare = low.strip()
        if bare in self.rows:
            return True, bare, 0
        if len(low) != len(text):
            return None
        best, end = None, 0
        if len(self.automaton):
            for at, (n, rank, phrase) in self.automaton.iter(low):
                if best is None or n > best[0] or (n == best[0] and rank < best[1]):
                    best, end = (n, rank, phrase), at
        if best:
            return False, best[2], end + 1 - best[0]
        return (False, "", 0) if "" in self.rows else None

    def rewritten(self, text: str, found: tuple[bool, str, int] | None) -> str:
        expansion = self.rows[found[1]][1] if found else None
        if expansion is None:
            return text
        whole, phrase, at = found
        return expansion if whole else text[:at] + expansion + text[at + len(phrase) :]


@lru_cache(maxsize=2)
def _built(sent) -> Phrases:
    """One automaton for each worker process and broadcast."""
    return Phrases(sent.value)


def expand_synonyms(queries: DataFrame, synonyms: DataFrame, query: str = "query") -> DataFrame:
    """queries with `expanded`.

    The stripped lower-case query equal to a phrase: its expansion. Else the longest phrase in the lower-case query (ties by ord) is
    replaced once, where it first occurs, in the query as written. Else, for a null query, or where the expansion is null:
    the query. An empty phrase lies at the start of every text. A text whose lower case has another length is left as it is.

    The phrases are one automaton, built once for each worker, and each text is read once where it lies: nothing is joined,
    repeated or shuffled. A dictionary beyond BROADCAST_ROWS or BROADCAST_LETTERS is dealt out in shards (`_dealt`).
    """
    known = synonyms.where("phrase IS NOT NULL").select("ord", "phrase", "expansion")
    n, letters = known.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") + F.coalesce(F.length("expansion"), F.lit(0))), F.lit(0))).first()
    if n > BROADCAST_ROWS or letters > BROADCAST_LETTERS:
        return _dealt(queries, known, query, n // SHARD + 1)
    sent = queries.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])

    @F.pandas_udf("string")
    def expanded(texts: pd.Series, lows: pd.Series) -> pd.Series:
        own = _built(sent)
        return pd.Series([t if t is None else own.rewritten(t, own.find(t, low)) for t, low in zip(texts, lows, strict=True)], dtype=object)

    return queries.withColumn("expanded", expanded(F.col(query), F.lower(query)))


def _dealt(queries: DataFrame, known: DataFrame, query: str, shards: int) -> DataFrame:
    """The same with the phrases in shards by their hash: distinct texts meet each shard in blocks, and the best phrase of all shards wins.

    A text is read once a shard, so the work is texts times shards, as any automaton that fits a task asks for.
    """
    texts = queries.select(F.col(query).alias("_q")).where("_q IS NOT NULL").distinct()
    blocks = texts.count() // TEXTS + 1
    shard = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = texts.select("_q", F.lower("_q").alias("_low"), shard("_q", blocks).alias("_block"), every.alias("_shard"))
    right = known.select("ord", "phrase", "expansion", shard("phrase", shards).alias("_shard")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(_, asked: pa.Table, words: pa.Table) -> pa.Table:
        own = Phrases(zip(*(words.column(c).to_pylist() for c in ("ord", "phrase", "expansion")), strict=True))
        out = []
        for text, low in zip(asked.column("_q").to_pylist(), asked.column("_low").to_pylist(), strict=True):
            if found := own.find(text, low):
                known_ord, ord_ = own.rows[found[1]][0]
                out.append((text, found[0], len(found[1]), ord_ if known_ord else None, own.rewritten(text, found)))
        names, kinds = ["_key", "_whole", "_n", "_ord", "_e"], [pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.string()]
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))})

    met = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(run, "_key string, _whole boolean, _n int, _ord long, _e string")
    first = Window.partitionBy("_key").orderBy(F.desc("_whole"), F.desc("_n"), F.asc_nulls_first("_ord"))
    best = met.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("_key", "_e")
    return queries.join(best, F.col(query) == F.col("_key"), "left").withColumn("expanded", F.coalesce("_e", F.col(query))).drop("_key", "_e")


def abbreviation(queries: DataFrame, synonyms: DataFrame, query: str = "query") -> DataFrame:
    """queries with `expanded`: the expansion of the lower-case query, or the query itself."""
    s = synonyms.select(F.col("phrase").alias("_p"), F.col("expansion").alias("_e"))
    s = F.broadcast(s) if synonyms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else s
    return queries.join(s, F.lower(query) == F.col("_p"), "left").withColumn("expanded", F.coalesce("_e", F.col(query))).drop("_p", "_e")
