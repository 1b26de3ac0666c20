"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, sent_if_small, stored, table, whole, words

#: The symbols that the base rule counts, and further marks that prose rarely has.
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>!~^=_@{}[]\\"
#: Metric (an integer) -> (size, step, most): the metric counts in steps of step / size, so step over the size's 10th percentile is
#: what one count more makes in a short document of the group; most is the largest value that the base rule lets pass.
METRICS = {
    "m_symbols": ("word_chars", 1000, 1000),
    "m_marks": ("word_chars", 1000, 1000),
    "m_upper": ("word_chars", 1000, 1000),
    "m_dup_lines": ("n_lines", 1000, 1000),
    "m_repeat": ("n_words", 10_000, 200),
    "m_word_len": ("word_chars", 100, None),
}
SIZES = ["word_chars", "n_words", "n_lines"]
#: A group's threshold is its third quartile and SPREAD times its interquartile range or that step, whichever is larger, but not above the
#: middle between its 99th percentile and the largest value there can be, so that each rule can reject something.
SPREAD = 8
#: Groups of fewer documents use the sketch of their language, and languages of fewer that of all documents.
LEAST_GROUP = 50
#: Groups up to which the thresholds are sent to every task, so that a group of any size stays where it was read.
GROUPS = 100_000
#: Bits that a sketch keeps of a value: relative error under 2 ** -(BITS - 1).
BITS = 6

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(df: DataFrame) -> DataFrame:
    """Adds the base counts and the metrics of `text`, and drops it.

    Windows of five words are compared by a 64-bit hash inside the row; a text without an equal pair, the usual case,
    is done after one hash set, the others sort their windows. No row leaves its task.
    """
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.withColumns({"_t": t, "_words": words(F.col("text")), "_lines": lines})
    n = F.size("_words")
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(5)])
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("_t", WHITE, "")).cast("long"),
            "n_symbols": _count(F.col("_t"), SYMBOLS),
            "_marks": _count(F.col("_t"), MARKS),
            "_upper": (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_w": F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("_words", "_lines", "_t", "text")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform("_s", lambda x, j: F.when((x.h == F.get("_s", j + 1).h) | (x.h == F.get("_s", j - 1).h), x.i))
    df = df.withColumn("_p", F.sort_array(F.array_compact(twice))).drop("_w", "_s")
    reach = F.transform("_p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("_p", j + 1), p + 5) - p))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_p")
    per = lambda x, y, k=1000: (F.lit(k) * F.col(x)) / F.greatest(F.col(y), F.lit(1))
    metrics = {
        "m_symbols": per("n_symbols", "word_chars"),
        "m_marks": per("_marks", "word_chars"),
        "m_upper": per("_upper", "word_chars"),
        "m_dup_lines": per("n_dup_lines", "n_lines"),
        "m_repeat": per("n_repeat_words", "n_words"),
        "m_word_len": per("word_chars", "n_words", 100),
    }
    return df.withColumns({k: F.floor(v).cast("long") for k, v in metrics.items()}).drop("_marks", "_upper")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of metrics and sizes: counts over buckets that keep the leading BITS bits of a value.

    Two sketches merge by adding counts, so partial sketches are combined before the shuffle and a group of any size
    arrives as a few hundred rows for each task that has read some of it.
    """
    v = F.col("v")
    shift = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    low = F.expr("shiftleft(shiftright(v, _k), _k)")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in [*METRICS, *SIZES]]))
    return (
        measured.select("lang", "source", pairs.alias("_m"))
        .select("lang", "source", "_m.metric", "_m.v")
        .withColumn("_k", shift.cast("int"))
        .select("lang", "source", "metric", low.alias("bucket"))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def limits_sql(sketch: str) -> str:
    """(lang, source, t_<metric>...) from a sketch's table: thresholds of each group, or of the level above if it is small; SQL of Spark and DuckDB."""

    def level(by: str) -> str:
        point = lambda q: f"min(CASE WHEN upto * 100 >= total * {q} THEN bucket END) AS q{q}"
        of = lambda m, q: f"max(CASE WHEN metric = '{m}' THEN {q} END)"
        step = lambda size, k: f"CAST(floor({k} / greatest({of(size, 'q10')}, 1)) AS BIGINT)"
        wide = lambda m, size, k: f"{of(m, 'q75')} + {SPREAD} * greatest({of(m, 'q75 - q25')}, {step(size, k)}, 1)"
        middle = lambda m, most: f"CAST(floor(({of(m, 'q99')} + {most}) / 2) AS BIGINT)"
        limit = lambda m, size, k, most: f"{f'least({wide(m, size, k)}, {middle(m, most)})' if most else wide(m, size, k)} AS t_{m[2:]}"
        group = f"GROUP BY {by}" if by else ""
        return f"""SELECT {by + "," if by else ""} max(total) AS n, {", ".join(limit(m, *x) for m, x in METRICS.items())}
          FROM (SELECT {by + "," if by else ""} metric, max(total) AS total, {point(10)}, {point(25)}, {point(75)}, {point(99)}
            FROM (SELECT {by + "," if by else ""} metric, bucket, sum(n) OVER (PARTITION BY {by + "," if by else ""} metric ORDER BY bucket) AS upto,
                    sum(n) OVER (PARTITION BY {by + "," if by else ""} metric) AS total
                  FROM (SELECT {by + "," if by else ""} metric, bucket, sum(n) AS n FROM {sketch} GROUP BY {by + "," if by else ""} metric, bucket) s) r
            GROUP BY {by + "," if by else ""} metric) q {group}"""

    chosen = lambda t: f"CASE WHEN o.n >= {LEAST_GROUP} THEN o.{t} WHEN l.n >= {LEAST_GROUP} THEN l.{t} ELSE (SELECT {t} FROM a) END AS {t}"
    return f"""WITH a AS ({level("")})
      SELECT o.lang, o.source, {", ".join(chosen(f"t_{m[2:]}") for m in METRICS)}
      FROM ({level("lang, source")}) o JOIN ({level("lang")}) l ON o.lang = l.lang"""


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, t_<metric>...): one row for each group of the sketch."""
    return sketch.sparkSession.sql(limits_sql("{sketch}"), sketch=sketch)


def quality_rules(docs: DataFrame, carry: list[str]) -> DataFrame:
    """docs (text, lang, source, ...) -> the columns of `carry`, the base counts, base_failed, kept, reason.

    kept is false if base_failed, or if a metric lies above its group's threshold; reason names the first such metric.
    Thresholds come from the documents that the base rule lets pass; a group without one has none and keeps what passes.
    Null or blank texts fail the base rule (under ten words). A null lang or source counts as the group ''. Repeated rows
    are judged each by itself and counted each. An empty table gives no rows. Carried columns keep their names unless
    an output column has the name, which then wins.
    """
    own = {*BASE, "base_failed", "kept", "reason"}
    base = whole(docs, "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    carried = [c for c in carry if c not in own]
    base = base.select(F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in carry]).alias("_row"), "text", "lang", "source")
    measured = stored(measure(base), "quality")
    return (
        _judged(measured, _limits(measured))
        .select(F.col("_row"), *BASE, _failed().alias("base_failed"), "reason")
        .select(*[F.col(f"_row.`{c}`").alias(c) for c in carried], *BASE, "base_failed", F.col("reason").isNull().alias("kept"), "reason")
    )


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _limits(measured: DataFrame) -> DataFrame:
    """The thresholds of each group, to be sent to every task if groups are few."""
    return sent_if_small(stored(thresholds(sketches(measured.where(~_failed()))), "quality-limits"), GROUPS)


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with `reason`, null for a document that stays."""
    reason = F.coalesce(F.when(_failed(), F.lit("base")), *[F.when(F.col(m) > F.col(f"t_{m[2:]}"), F.lit(m[2:])) for m in METRICS])
    return measured.join(limits, ["lang", "source"], "left").withColumn("reason", reason)


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that quality_rules rejects; same columns.

    Documents are measured twice, once for the thresholds and once where they are filtered, so only counts are stored in between.
    """
    rows = whole(docs, "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    limits = _limits(stored(measure(rows.drop("_row")), "quality-measures"))
    return _judged(measure(rows), limits).where("reason IS NULL").select("_row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])


_per = "CAST(floor(({k} * CAST({x} AS DOUBLE)) / greatest({y}, 1)) AS BIGINT)"


def oracle() -> str:
    chars = lambda s: f"length(t) - length(translate(t, '{s}', ''))".replace("\\", "\\")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ms = {
        "m_symbols": _per.format(k=1000, x="n_symbols", y="word_chars"),
        "m_marks": _per.format(k=1000, x="marks", y="word_chars"),
        "m_upper": _per.format(k=1000, x="upper", y="word_chars"),
        "m_dup_lines": _per.format(k=1000, x="n_dup_lines", y="n_lines"),
        "m_repeat": _per.format(k=1000, x="n_repeat_words", y="n_words"),
        "m_word_len": _per.format(k=100, x="word_chars", y="n_words"),
    }
    failed = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
    s AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: trim(x, {white}) <> '') AS ls FROM d),
    win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM s)),
    dup AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
    rep AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS r FROM dup GROUP BY doc_id),
    c AS (SELECT s.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {white}, '')) AS BIGINT) AS word_chars,
            CAST({chars(SYMBOLS)} AS BIGINT) AS n_symbols, CAST({chars(MARKS)} AS BIGINT) AS marks,
            CAST(length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS BIGINT) AS upper, CAST(len(ls) AS BIGINT) AS n_lines,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
          FROM s LEFT JOIN rep ON s.doc_id = rep.doc_id),
    m AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in ms.items())} FROM c),
    long AS (UNPIVOT (SELECT lang, source, {", ".join([*METRICS, *SIZES])} FROM m WHERE NOT ({failed})) ON {", ".join([*METRICS, *SIZES])} INTO NAME metric VALUE v),
    k AS (SELECT *, greatest(length(ltrim(bin(v), '0')) - {BITS}, 0) AS sh FROM long),
    sk AS (SELECT lang, source, metric, (v >> sh) << sh AS bucket, count(*) AS n FROM k GROUP BY ALL),
    w AS ({limits_sql("sk")}),
    j AS (SELECT m.*, {failed} AS base_failed,
            CASE WHEN {failed} THEN 'base' {" ".join(f"WHEN {x} > t_{x[2:]} THEN '{x[2:]}'" for x in METRICS)} END AS reason
          FROM m LEFT JOIN w ON m.lang = w.lang AND m.source = w.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM j"""


QUERIES = {"op3_quality_rules": op3}
ORACLES = {"op3_quality_rules": oracle()}
