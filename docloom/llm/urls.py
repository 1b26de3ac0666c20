"""URL filter: host and path rules, then a path-template tree per host judged by smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sent_if_small, stored, table

#: Fixed values: (verdict, host, path) of the contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Levels that oracle()'s SQL spells out; the tree itself follows paths to their end.
DEPTH = 6
#: A branch keeps its name if it has LEAST labelled pages and its share of good ones differs from its siblings' by Z standard errors.
LEAST, Z = 20, 3.0
#: Pseudo-labels by which a template leans on its host, and a host on the whole table; templates below CUT are blocked.
STRENGTH, CUT = 10.0, 0.5
#: Templates up to this many rows are sent to every task; beyond it they are joined by key.
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and the start of the path; else nulls."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = rule.when(fits, h + p) if rule is not None else F.when(fits, h + p)
        verdict = verdict.when(fits, v) if verdict is not None else F.when(fits, v)
    none = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (none, none)


def segments(path: Column) -> Column:
    """Path segments with runs of digits as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, "[0-9]+", "*"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """pages (host, path, ...) with `good`: 1 or 0 by the label of the document that the path's last number names, else null.

    A document is good if every label row has quality 1 and none is toxic.
    """
    label = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("decimal(20,0)").alias("_doc"))
        .agg(F.min(F.when((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    )
    number = F.expr("try_cast(regexp_extract(path, '([0-9]{1,19})[^0-9]*$', 1) AS decimal(20,0))")
    return pages.withColumn("_doc", number).join(label, "_doc", "left").drop("_doc")


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, segs, n, labels, good: sums over pages with equal segments) -> (host, segs, template, blocked).

    Level by level, a node's branches are compared with their siblings; those that don't differ merge into the wildcard.
    Sums per node are combined before each shuffle and joined back, so no node's branches are gathered in one task.
    Below a node with fewer than 2 * LEAST labelled pages no branch can differ: its paths end in wildcards and are done.
    """
    paths = paths.withColumn("at", F.lit(""))
    done, d = [paths.where(F.size("segs") == 0)], 0
    paths = paths.where(F.size("segs") > 0)
    while not paths.isEmpty():
        paths = paths.withColumn("seg", F.get("segs", F.lit(d)))
        branch = paths.groupBy("host", "at", "seg").agg(F.sum("labels").alias("l"), F.sum("good").alias("g"))
        node = branch.groupBy("host", "at").agg(F.sum("l").alias("nl"), F.sum("g").alias("ng"))
        node = sent_if_small(stored(node.where(F.col("nl") >= 2 * LEAST), "url-nodes"), BROADCAST_ROWS)
        rest_l, rest_g = F.col("nl") - F.col("l"), F.col("ng") - F.col("g")
        p, gap = F.col("ng") / F.col("nl"), F.abs(F.col("g") / F.col("l") - rest_g / rest_l)
        apart = (F.col("l") >= LEAST) & (rest_l >= LEAST)
        own = (
            branch.where(F.col("l") >= LEAST)
            .join(node, ["host", "at"])
            .where(F.when(apart, gap > Z * F.sqrt(p * (1 - p) * (1.0 / F.col("l") + 1.0 / rest_l))).otherwise(F.lit(False)))
            .select("host", "at", "seg", F.lit(True).alias("own"))
        )
        named = F.concat("at", F.lit("/"), F.when(F.col("own"), F.col("seg")).otherwise(F.lit("*")))
        rest = F.concat("at", F.repeat(F.lit("/*"), F.size("segs") - d))
        judged = (
            paths.join(node.select("host", "at", F.lit(True).alias("wide")), ["host", "at"], "left")
            .join(own, ["host", "at", "seg"], "left")
            .select("host", "segs", "n", "labels", "good", F.when(F.col("wide"), named).otherwise(rest).alias("at"), (F.col("wide").isNotNull() & (F.size("segs") > d + 1)).alias("open"))
        )
        judged, d = stored(judged, "url-templates"), d + 1
        done.append(judged.where("NOT open").drop("open"))
        paths = judged.where("open").drop("open")
    paths = stored(reduce(DataFrame.unionByName, done), "url-templates")
    every = paths.agg(((F.sum("good") + STRENGTH) / (F.sum("labels") + STRENGTH)).alias("p_all"))
    by_host = paths.groupBy("host").agg(F.sum("labels").alias("hl"), F.sum("good").alias("hg"))
    by_template = paths.groupBy("host", "at").agg(F.sum("labels").alias("tl"), F.sum("good").alias("tg"))
    p_all = every.first()[0]  # one number
    p_host = (F.col("hg") + STRENGTH * F.lit(1.0 if p_all is None else p_all)) / (F.col("hl") + STRENGTH)
    purity = (F.col("tg") + STRENGTH * p_host) / (F.col("tl") + STRENGTH)
    judged = by_template.join(by_host, "host").select("host", "at", (purity < CUT).alias("blocked"))
    return paths.join(judged, ["host", "at"]).select("host", "segs", F.col("at").alias("template"), "blocked")


def url_filter(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (page_id, url, ...) -> (page_id, host, path, rule, verdict, template); other columns are not read.

    A null url, or one without `://`, has an empty host and path and is judged like any other. Repeated rows give
    repeated rows and count each. rules is a short list that becomes one expression. An empty table gives no rows;
    without labels nothing is blocked but by rules.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = stored(labelled(split, labels).withColumn("segs", segments(F.col("path"))), "urls")
    sums = split.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("good").alias("labels"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    found = stored(templates(stored(sums, "url-paths")), "url-verdicts")
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return split.join(found, ["host", "segs"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.coalesce("template", F.lit("")).alias("template"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def oracle() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    levels, last = [], "t0"
    for d in range(1, DEPTH + 1):
        levels.append(f"""
    b{d} AS (SELECT host, tpl, segs[{d}] AS seg, sum(labels) AS l, sum(good) AS g FROM {last} WHERE len(segs) >= {d} GROUP BY ALL),
    n{d} AS (SELECT host, tpl, sum(l) AS nl, sum(g) AS ng FROM b{d} GROUP BY ALL),
    o{d} AS (SELECT host, tpl, seg FROM b{d} JOIN n{d} USING (host, tpl) WHERE l >= {LEAST} AND nl - l >= {LEAST}
             AND CASE WHEN l >= {LEAST} AND nl - l >= {LEAST} THEN abs(g / l - (ng - g) / (nl - l)) > {Z} * sqrt((ng / nl) * (1 - ng / nl) * (1.0::DOUBLE / l + 1.0::DOUBLE / (nl - l))) END),
    t{d} AS (SELECT p.host, p.segs, p.labels, p.good,
             CASE WHEN len(p.segs) < {d} THEN p.tpl ELSE p.tpl || '/' || CASE WHEN o.seg IS NOT NULL THEN o.seg ELSE '*' END END AS tpl
             FROM {last} p LEFT JOIN o{d} o ON p.host = o.host AND p.tpl = o.tpl AND p.segs[{d}] = o.seg)""")
        last = f"t{d}"
    return f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
                      regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
    lab AS (SELECT doc_id, min(CASE WHEN coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
    s AS (SELECT u.*, good, list_slice(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '*', 'g')), 1, {DEPTH}) AS segs
          FROM u LEFT JOIN lab ON try_cast(nullif(regexp_extract(path, '([0-9]{{1,19}})[^0-9]*$', 1), '') AS DECIMAL(20, 0)) = lab.doc_id),
    t0 AS (SELECT host, segs, count(good) AS labels, coalesce(sum(good), 0) AS good, '' AS tpl FROM s GROUP BY host, segs),{",".join(levels)},
    h AS (SELECT host, sum(labels) AS hl, sum(good) AS hg FROM {last} GROUP BY host),
    a AS (SELECT coalesce((sum(good) + {STRENGTH}) / (sum(labels) + {STRENGTH}), 1.0) AS p_all FROM {last}),
    j AS (SELECT t.host, t.tpl, (sum(t.good) + {STRENGTH} * ((any_value(hg) + {STRENGTH} * any_value(p_all)) / (any_value(hl) + {STRENGTH}))) / (sum(t.labels) + {STRENGTH}) < {CUT} AS blocked
          FROM {last} t JOIN h USING (host) CROSS JOIN a GROUP BY t.host, t.tpl)
    SELECT page_id, s.host, path, rule, coalesce(ruled, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, t.tpl AS template
    FROM (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM s) s JOIN {last} t ON s.host = t.host AND s.segs = t.segs JOIN j ON t.host = j.host AND t.tpl = j.tpl"""


QUERIES = {"op10_url_filter": op10}
ORACLES = {"op10_url_filter": oracle()}
