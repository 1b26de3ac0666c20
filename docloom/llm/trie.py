"""The trie of conversations by their turns: who owns which prefix is found by binary search, chains are added up from below."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Turns that are numbered, hashed or added up together; longer conversations are dealt out by blocks of so many.
BITS = 12
#: Ids that are joined to one text before they are hashed: those that are equal but for so many low bits.
IDS = 12
#: Digest of members that don't exist.
NONE = hashlib.sha256(b"").hexdigest()


def _two_levels(rows: DataFrame, key: str, block: Column, order: list[Column], parts: dict[str, tuple[str, str]], forward: bool = True) -> DataFrame:
    """rows with running aggregates along `key`: parts is {name: (column, aggregate)}, up to and with a row.

    A key's rows are aggregated block by block, and the blocks' totals carried on, so that no task sorts all rows of a key.
    """
    how = {"sum": F.sum, "xor": F.bit_xor}
    plus = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    rows = rows.withColumn("_block", block)
    own = Window.partitionBy(key, "_block").orderBy(*order)
    before = Window.partitionBy(key).orderBy(F.col("_block") if forward else F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(key, "_block").agg(*[how[a](c).alias(f"_t_{k}") for k, (c, a) in parts.items()])
    total = total.select(key, "_block", *[F.coalesce(how[a](f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k, (_, a) in parts.items()])
    rows = rows.withColumns({f"_r_{k}": how[a](c).over(own.rowsBetween(Window.unboundedPreceding, 0)) for k, (c, a) in parts.items()}).join(total, [key, "_block"])
    return rows.withColumns({k: plus[a](F.col(f"_r_{k}"), F.col(f"_t_{k}")) for k, (_, a) in parts.items()}).drop("_block", *[f"_{x}_{k}" for k in parts for x in "rt"])


def numbered(talks: DataFrame) -> DataFrame:
    """talks (conv_id, turn, role, text, ...) -> (conv_id, pos from 1, h1, h2, bytes): hashes of role and text, UTF-8 bytes of the text.

    Turns are in order of `turn`, null first, those of one number by role and text. Equal rows are counted before they meet.
    """
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = talks.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("_c"))
    hashes = {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role"), "bytes": F.octet_length("text").cast("long")}
    block = F.coalesce(F.shiftright("turn", BITS), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = _two_levels(rows.withColumns(hashes), "conv_id", block, order, {"_upto": ("_c", "sum")})
    return rows.select("conv_id", F.explode(F.sequence(F.col("_upto") - F.col("_c") + 1, "_upto")).alias("pos"), "h1", "h2", "bytes")


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns (conv_id, pos, h1, h2, bytes), convs (conv_id, n) -> (conv_id, depth, a, b, bytes), the root's too.

    A prefix's digest is the exclusive or of the hashes of its numbered turns, 128 bits, so it adds up in blocks.
    """
    rows = turns.select("conv_id", F.col("pos").alias("depth"), F.xxhash64("pos", "h1").alias("_a"), F.xxhash64("h2", "pos").alias("_b"), "bytes")
    rows = _two_levels(rows, "conv_id", F.shiftright("depth", BITS), [F.col("depth")], {"a": ("_a", "xor"), "b": ("_b", "xor")})
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"))
    return rows.select("conv_id", "depth", "a", "b", "bytes").unionByName(roots)


def _digest(ids: DataFrame) -> DataFrame:
    """ids (owner, depth, conv_id) -> (owner, depth, ends_sha256) over the decimal ids in order.

    SHA-256 goes through its bytes one after another; ids are joined to texts of 2 ** IDS at most before, and a node's
    texts stream through one task, never held together.
    """
    texts = ids.groupBy("owner", "depth", F.shiftright("conv_id", IDS).alias("_part")).agg(F.array_join(F.array_sort(F.collect_set("conv_id")).cast("array<string>"), ",").alias("_ids"))

    def run(batches):
        now, state = None, None
        for b in batches:
            done = []
            for owner, depth, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (owner, depth) == now:
                    state.update(b"," + text.encode())
                    continue
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (owner, depth), hashlib.sha256(text.encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, state.hexdigest())])

    def _rows(done) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "ends_sha256"])

    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "_part").select("owner", "depth", "_ids")
    return rows.mapInArrow(run, "owner bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns (conv_id, pos, h1, h2, bytes), convs (conv_id, n turns) -> a row for each distinct prefix:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id is the least member. A conversation owns a prefix if it is the least that starts with it; it then owns all
    its longer ones, so the first owned depth is found by binary search: each round joins one depth a conversation with the
    prefixes' digests and their minima, all conversations at once. What a conversation owns is a chain, hung on another's node.
    Chains are added up from below in rounds that double the distance, so a path of any length takes logarithmically many.
    """
    prefixes = stored(_prefixes(turns, convs), "trie-prefixes")
    nodes = prefixes.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = stored(nodes, "trie-nodes")

    def owners(asked: DataFrame) -> DataFrame:
        """asked (conv_id, depth, ...) with the owner of that prefix."""
        digests = prefixes.select("conv_id", "depth", "a", "b").join(asked, ["conv_id", "depth"])
        return digests.join(nodes.select("depth", "a", "b", "owner"), ["depth", "a", "b"]).drop("a", "b")

    long = lambda x: F.lit(x).cast("long")
    found, search = [], stored(convs.select("conv_id", "n", long(0).alias("lo"), (F.col("n") + 1).alias("hi")), "trie-search")
    while not search.isEmpty():
        seen = owners(search.withColumn("depth", F.shiftright(F.col("lo") + F.col("hi"), 1)))
        mine = F.col("owner") == F.col("conv_id")
        bounds = seen.select("conv_id", "n", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        bounds = stored(bounds, "trie-search")
        found.append(bounds.where("lo = hi").select("conv_id", "n", F.col("lo").alias("first")))
        search = bounds.where("lo < hi")
    if not found:  # no conversation at all
        found = [convs.select("conv_id", "n", long(0).alias("first"))]
    firsts = found[0]
    for f in found[1:]:
        firsts = firsts.unionByName(f)
    firsts = stored(firsts, "trie-firsts")
    hung = owners(firsts.where("first > 0 AND first <= n").withColumn("depth", F.col("first") - 1)).select("conv_id", F.col("owner").alias("parent"))
    chains = stored(firsts.where("first <= n").join(hung, "conv_id", "left"), "trie-chains")

    kids = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("_kids"))
    own = nodes.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("_own"))
    own = own.join(chains.select(F.col("conv_id").alias("owner"), "n", "first", "parent"), "owner").join(kids, ["owner", "depth"], "left")
    leaf = ((F.col("depth") == F.col("n")) & F.col("_kids").isNull()).cast("long")
    own = stored(own.withColumn("_leaf", leaf), "trie-own")

    sums = own.groupBy(F.col("owner").alias("conv_id")).agg(F.first("parent").alias("up"), F.sum("_own").alias("saved"), F.sum("_leaf").alias("leaves"))
    sums = stored(sums, "trie-sums")
    while not sums.where("up IS NOT NULL").isEmpty():
        below = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
        above = sums.where("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        sums = stored(sums.join(below, "conv_id", "left").join(above, "up", "left").select("conv_id", F.col("_up").alias("up"), plus("saved", "_s"), plus("leaves", "_l")), "trie-sums")

    hung = chains.where("parent IS NOT NULL").join(sums.select("conv_id", "saved", "leaves"), "conv_id")
    hung = hung.groupBy(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))
    rows = own.join(hung, ["owner", "depth"], "left").withColumns({"_own": F.col("_own") + F.coalesce("_s", F.lit(0)), "_leaf": F.col("_leaf") + F.coalesce("_l", F.lit(0))}).drop("_s", "_l")
    rows = _two_levels(rows, "owner", F.shiftright("depth", BITS), [F.col("depth").desc()], {"saved_tokens": ("_own", "sum"), "n_leaves": ("_leaf", "sum")}, forward=False)
    ends = _digest(owners(convs.select("conv_id", F.col("n").alias("depth"))).select("owner", "depth", "conv_id"))
    return rows.join(ends, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("_kids", F.lit(0)) + (F.col("depth") < F.col("n")).cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
    )


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def conversation_trie(talks: DataFrame) -> DataFrame:
    """talks (conv_id, turn, role, text, ...) -> the rows of prefix_trie over the conversations as they are.

    Null roles and texts are empty ones; rows with a null conv_id take no part; other columns are not read. Turns of one
    number are in order of role and text, repeated ones as often as they occur. Texts of any length enter by their hash
    alone. No row: no row.
    """
    turns = stored(numbered(talks), "trie-turns")
    return prefix_trie(turns, stored(lengths(turns), "trie-lengths"))


#: Conversations share turns with the first of FAMILY ids, fewer than SHARED of them.
FAMILY, SHARED = 5, 9


def rebuilt(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations of which each begins with turns of its family's first: h of them, by its id's checksum,
    or all there are, then has its own after the first h."""
    turns = stored(numbered(talks), "trie-turns")
    known = stored(lengths(turns), "trie-lengths")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED))
    known = known.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h})
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    known = known.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("_n", F.lit(0))))
    known = stored(known.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "trie-known")
    own = turns.join(known.select("conv_id", "h", "k"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "h1", "h2", "bytes")
    first = turns.where(F.col("pos") < SHARED).withColumnRenamed("conv_id", "base").join(known.select("conv_id", "base", "h"), "base").where("pos <= h")
    return own.unionByName(first.select(*own.columns)), known.select("conv_id", "n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


_CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT l.c, l.n, l.c - l.c % {FAMILY} AS b, {_CRC.replace("(c AS", "(l.c AS")} % {SHARED} AS h, coalesce(m.n, 0) AS bn FROM l LEFT JOIN l m ON m.c = l.c - l.c % {FAMILY}),
r AS (SELECT k.c, t.p, role, text FROM k JOIN t ON t.c = k.b AND t.p <= h UNION ALL SELECT k.c, t.p - h + least(h, bn), role, text FROM k JOIN t ON t.c = k.c AND t.p > h),
x AS (SELECT c, p AS d, strlen(text) AS bytes, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS g FROM r
      UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT d, g, min(c) AS o, count(*) AS m, any_value(bytes) AS bytes FROM x GROUP BY ALL),
u AS (SELECT v.*, y.d AS pd, y.g AS pg FROM n v JOIN x y ON y.c = v.o AND y.d <= v.d),
f AS (SELECT pd AS d, pg AS g, count(*) AS kids FROM u WHERE pd = d - 1 GROUP BY ALL),
s AS (SELECT u.pd AS d, u.pg AS g, sum((u.m - 1) * u.bytes) AS saved, count(*) FILTER (f.kids IS NULL) AS leaves FROM u LEFT JOIN f ON f.d = u.d AND f.g = u.g GROUP BY ALL),
e AS (SELECT d, g, sha256(string_agg(CAST(x.c AS VARCHAR), ',' ORDER BY x.c)) AS h FROM x JOIN (SELECT c, max(d) AS d FROM x GROUP BY 1) z USING (c, d) GROUP BY ALL)
SELECT n.o AS conv_id, n.d AS depth, w.o AS parent_conv_id, n.m AS n_convs, coalesce(f.kids, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM n LEFT JOIN f USING (d, g) JOIN s USING (d, g) LEFT JOIN e USING (d, g) LEFT JOIN u ON u.d = n.d AND u.g = n.g AND u.pd = n.d - 1 LEFT JOIN n w ON w.d = u.pd AND w.g = u.pg"""

QUERIES = {"op12_conversation_trie": op12}
ORACLES = {"op12_conversation_trie": ORACLE}
