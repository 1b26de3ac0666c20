"""How far sources of a language are apart in their words: dense group-by-term tiles, partial pair matrices, the most telling terms."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Bytes that are no part of a term. All of other characters' bytes are.
_BREAKS = frozenset([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(32 if b in _BREAKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Documents of its language that a term must occur in; what each count is raised by; the scale of shares; terms told of a group.
LEAST_DOCS, PRIOR, SCALE, TOLD = 30, 5, 1_000_000_000, 50
#: Terms of a block, about; groups of a tile's side, about; (group, term) counts that a task holds before it hands them on; bytes of a text split at once.
BLOCK, SIDE, HELD, PIECE = 2048, 256, 400_000, 1 << 22


def split_terms(text: bytes):
    """Lists of the terms of a text, PIECE bytes or so at a time; only A-Z are lower-cased."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            end = at + PIECE
            while end < len(text) and text[end] not in _BREAKS:
                end += 1
        yield text[at:end].translate(_TABLE).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source) -> (lang, source, term, n, docs): occurrences, and documents with the term.

    Tasks count what they read before anything is shuffled, and hand on at most HELD counts at once.
    """

    def run(batches):
        n, seen = {}, {}

        def rows():
            keys = [k for k, c in n.items() for _ in range(len(c))]
            terms = [t for c in n.values() for t in c]
            counts = [x for c in n.values() for x in c.values()]
            found = [seen[k][t] for k, c in n.items() for t in c]
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(terms, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, pa.int64())], ["lang", "source", "term", "n", "docs"])
            n.clear()
            seen.clear()
            return out

        for b in batches:
            held = sum(map(len, n.values()))
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                key = (lang, source)
                own, once, before = n.setdefault(key, Counter()), set(), len(n[key])
                for terms in split_terms(text.as_py()):
                    own.update(terms)
                    once.update(terms)
                seen.setdefault(key, Counter()).update(once)
                held += len(own) - before
                if held >= HELD:
                    yield rows()
                    held = 0
        if n:
            yield rows()

    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = plain.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return counted.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly: long division by three digits at a time.

    counts: int64, a row for each of `totals`. No step leaves int64 while a total is under 9 * 10 ** 15.
    """
    over = totals[:, None] + PRIOR * terms
    q, rest = np.divmod(counts + PRIOR, over)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, over)
        q = q * 1000 + digits
    return 1 + q


def _tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts (source, term, n, total) and groups (source, tile, size, terms, all) of one block of terms and two tiles of groups
    -> partial sums of pairs, and in tiles on the diagonal the block's best terms of each group. Groups are in order of their
    names, so that a pair is named alike in all blocks."""
    lang, _, i, j = (x.as_py() for x in key)
    right = right.sort_by("source")
    names, tile, sizes = right.column("source").to_pylist(), right.column("tile").to_numpy(), right.column("size").to_numpy()
    kept = right.column("terms")[0].as_py() if len(names) else 0
    row = {s: k for k, s in enumerate(names)}
    terms, column = np.unique(np.array(left.column("term").to_pylist(), object), return_inverse=True) if left.num_rows else (np.zeros(0, object), np.zeros(0, int))
    counts = np.zeros((len(names), len(terms)), np.int64)
    at = np.array([row[s] for s in left.column("source").to_pylist()], int)
    counts[at, column] = left.column("n").to_numpy()
    p = shares(counts, sizes, kept)
    part, source, item, value = [], [], [], []
    mine, other = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    for k, a in enumerate(mine.tolist()):
        against = other[k + 1 :] if i == j else other
        apart = np.abs(p[against] - p[a]).sum(axis=1)
        part += ["pair"] * len(against)
        source += [names[a]] * len(against)
        item += [names[b] for b in against.tolist()]
        value += apart.tolist()
    if i == j and len(terms):
        total = np.zeros((1, len(terms)), np.int64)
        total[0, column] = left.column("total").to_numpy()
        q = shares(total, right.column("all").to_numpy()[:1], kept)[0]
        for a in range(len(names)):
            f = p[a] - q
            good = np.flatnonzero((counts[a] > 0) & (f > 0))
            best = good[np.argsort(-f[good], kind="stable")]
            if len(best) > TOLD:  # all that tie with the last are kept, as their order is that of UTF-8
                best = best[f[best] >= f[best[TOLD - 1]]]
            best = sorted(best.tolist(), key=lambda t: (-f[t], terms[t].encode()))[:TOLD]
            part += ["term"] * len(best)
            source += [names[a]] * len(best)
            item += [terms[t] for t in best]
            value += f[best].tolist()
    return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "part": pa.array(part, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source, ...) -> (lang, source, part, item, value, rank).

    Null text, lang and source are ''. A language keeps the terms in LEAST_DOCS of its documents or more. `pair` rows hold the
    distance of a group's shares from those of each other source of its language, over all kept terms; `term` rows the TOLD
    terms that a group has most above its language. Repeated rows count each; a language without kept terms has distances of 0,
    one with one source no pairs. Texts of any length are split piece by piece. Other columns are not read. No row: no row.
    """
    counts = stored(term_counts(docs), "term-counts")
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("d")).where(F.col("d") >= LEAST_DOCS).drop("d")
    kept = stored(counts.drop("docs").join(kept, ["lang", "term"]), "terms-kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    groups = named.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").join(named.groupBy("lang").agg(F.count("*").alias("_s")), "lang")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    split = lambda n, of: F.greatest(F.lit(1), F.ceil(n / F.lit(of))).cast("int")
    tile = F.pmod(F.xxhash64("source"), F.col("_tiles")).cast("int")
    groups = groups.select("lang", "source", zero("size"), zero("terms"), zero("all"), split(F.coalesce("terms", F.lit(0)), BLOCK).alias("_blocks"), split(F.col("_s"), SIDE).alias("_tiles"))
    groups = stored(groups.withColumn("tile", tile), "term-groups")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = lambda df: df.withColumn("_other", every("_tiles")).withColumns({"i": F.least("tile", "_other"), "j": F.greatest("tile", "_other")})
    left = kept.join(groups.select("lang", "source", "_blocks", "_tiles", "tile"), ["lang", "source"])
    left = pairs(left.withColumn("block", F.pmod(F.xxhash64("term"), F.col("_blocks")).cast("int"))).select("lang", "block", "i", "j", "source", "term", "n", "total")
    right = pairs(groups.withColumn("block", every("_blocks"))).select("lang", "block", "i", "j", "source", "tile", "size", "terms", "all")
    key = ["lang", "block", "i", "j"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile, "lang string, part string, source string, item string, value bigint")
    found = stored(found, "term-tiles")
    apart = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    turned = apart.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best))
    out = ranked(apart.unionByName(turned)).unionByName(ranked(found.where("part = 'term'").select(*apart.columns)).where(F.col("rank") <= TOLD))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS a FROM k GROUP BY 1),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + ({SCALE} * (coalesce(n, 0) + {PRIOR})) // (size + {PRIOR} * v) AS p, 1 + ({SCALE} * (total + {PRIOR})) // (a + {PRIOR} * v) AS q
      FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(any_value(f), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT x.lang, x.source AS xs, y.source AS ys, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
            ON z.lang = a.lang AND xs = a.source AND ys = b.source GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= {TOLD}"""

QUERIES = {"op13_source_divergence": op13}
ORACLES = {"op13_source_divergence": ORACLE}
