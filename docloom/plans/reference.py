"""One query for each operator of the retrieval engine over the test tables, beside the SQL that gives the same rows.

Domain tables (phrases, prompts, canned queries) are invented ones; the engine takes them as parameters.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_doubles, norm, normalised, ordered_join, preview, strip
from ..operators import catalog, chat, chunk, compose, embed, pages, retrieve, rewrite, route, sessions
from ..sources import conversations, files, models

QUERIES: dict = {}
ORACLES: dict = {}

#: (phrase, expansion), in order.
SYNONYMS = [("tre", "central registry"), ("the", "the main office"), ("what is the", "office description"), ("der", "die Stelle"), ("de la", "de la oficina"), ("is", "exists")]
#: key -> (name, prompt)
PROMPTS = {"general_assistant": ("General", "You answer briefly."), "user": ("Visitor", "You greet a visitor."), "assistant": ("Helper", "You help the helper.")}
CANNED = [("/prices", "price list"), ("/contacts", "address and phone")]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(SYNONYMS)], "ord int, phrase string, expansion string")


def _prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PROMPTS.items()], "key string, name string, prompt string")


def _chunks_of(docs: DataFrame) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return chunk.chunk_rows(docs, name, F.col("text"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks_of(_read(spark, d, "documents"))


_SIZE, _BACK = chunk.SIZE, chunk.OVERLAP
_STOP = f"""CASE WHEN s + {_SIZE} < n AND position(' ' IN reverse(substr(t, s + 1, {_SIZE}))) BETWEEN 1 AND {_SIZE - 1}
              THEN s + {_SIZE} - position(' ' IN reverse(substr(t, s + 1, {_SIZE}))) ELSE s + {_SIZE} END"""
CHUNKS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, t, n, 0 AS k, s, {_STOP} AS e FROM (SELECT *, 0 AS s FROM d) WHERE n > {_SIZE}
  UNION ALL
  SELECT doc_id, t, n, k, s, {_STOP} AS e FROM (SELECT doc_id, t, n, k + 1 AS k, CASE WHEN e - {_BACK} > s THEN e - {_BACK} ELSE e END AS s FROM w) WHERE s < n),
p AS (
  SELECT doc_id, n, k, t AS content FROM (SELECT *, 0 AS k FROM d) WHERE n <= {_SIZE}
  UNION ALL
  SELECT * FROM (SELECT doc_id, n, k, regexp_replace(substr(t, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS content FROM w) WHERE content <> ''),
chunks AS (
  SELECT 'doc_' || doc_id || '.txt' AS filename, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_id, content,
         CAST(length(content) AS INT) AS chunk_size, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, CAST(n AS INT) AS file_size FROM p)"""


@query("chunk_documents", CHUNKS_SQL + " SELECT * FROM chunks")
def _(spark, d):
    return _chunks(spark, d).select("filename", "chunk_id", "content", "metadata.chunk_size", "metadata.total_chunks", "metadata.file_size")


@query("kb_stats", CHUNKS_SQL + " SELECT count(DISTINCT filename) AS total_documents, count(*) AS total_chunks FROM chunks")
def _(spark, d):
    return catalog.stats(_chunks(spark, d))


@query("kb_list", "SELECT DISTINCT 'doc_' || doc_id || '.txt' AS filename FROM documents WHERE text IS NOT NULL AND (length(text) <= 1000 OR regexp_matches(text, '\\S'))")
def _(spark, d):
    return catalog.filenames(_chunks(spark, d))


@query("extension_filter", "SELECT page_id, regexp_extract(p, '[^/]*$') AS filename FROM (SELECT page_id, p || CASE page_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' ELSE '.PDF' END AS p FROM (SELECT page_id, rtrim(regexp_extract(url, '^[^?#]*'), '/') AS p FROM pages)) WHERE regexp_matches(p, '\\.(txt|md|py)$')")
def _(spark, d):
    pages = _read(spark, d, "pages")
    ends = F.get(F.array(*[F.lit(x) for x in (".md", ".txt", ".py", ".PDF")]), (F.col("page_id") % 4).cast("int"))
    path = F.concat(F.rtrim(F.regexp_extract("url", "^[^?#]*", 0), F.lit("/")), ends)
    return pages.select("page_id", path.alias("p")).where(route.has_suffix(F.col("p"))).select("page_id", F.element_at(F.split("p", "/"), -1).alias("filename"))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("vector_topk", f"SELECT b.vec_id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 3")
def _(spark, d):
    rows = _read(spark, d, "embeddings")
    asked = rows.where("vec_id = 0").select("embedding").first()
    return retrieve.top_k(rows.where("vec_id <> 0"), asked[0], 3, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


_BATCH = f"""SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"""


def _found(spark, d, k=5):
    rows = _read(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.top_k_batch(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, k)


@query("vector_topk_batch", f"SELECT query_id, id, CAST(rank AS INT) AS rank, round(sim, 6) AS similarity FROM ({_BATCH}) WHERE rank <= 5")
def _(spark, d):
    return _found(spark, d).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("vector_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def _(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", F.round(norm(as_doubles(F.col("embedding"))), 6).alias("norm"))


@query("normalise", "SELECT vec_id, i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(v, lambda x: x / n)) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))")
def _(spark, d):
    unit = F.posexplode(normalised(as_doubles(F.col("embedding")))).alias("i", "x")
    return _read(spark, d, "embeddings").select("vec_id", unit).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _hits(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return _found(spark, d, 3).join(docs, "id").select("query_id", "rank", "content", F.col("similarity").alias("score"))


_HITS = f"SELECT query_id, rank, text AS content, sim AS score FROM ({_BATCH}) JOIN documents ON id = doc_id WHERE rank <= 3"
_ASKED = "SELECT vec_id AS query_id, 'question ' || vec_id AS query FROM embeddings WHERE vec_id % 25 = 0"


def _asked(spark, d):
    ids = _read(spark, d, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"))
    return ids.select("query_id", F.concat(F.lit("question "), F.col("query_id").cast("string")).alias("query"))


def _embedded(spark, d):
    """Documents as chunks with the vector of the same number."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.struct(F.col("source").alias("file_path")).alias("metadata"))
    return docs.join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")


_FOUND = f"""SELECT query_id, CAST(rank AS INT) AS rank, text AS content, sim AS score, source FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id IN (SELECT doc_id FROM documents)) JOIN documents ON id = doc_id WHERE rank <= 3"""


def _searched(spark, d):
    asked = _read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.search(_embedded(spark, d), asked, 3)


@query("text_search", f"SELECT query_id, rank, content, round(score, 6) AS score, source FROM ({_FOUND})")
def _(spark, d):
    return _searched(spark, d).select("query_id", "rank", "content", F.round("score", 6).alias("score"), F.col("metadata.file_path").alias("source"))


@query("kb_switch", f"""SELECT q.query_id, CASE WHEN q.query_id % 100 = 0 THEN coalesce(context, '') ELSE '' END AS context FROM ({_ASKED}) q
  LEFT JOIN (SELECT query_id, string_agg('[Source ' || rank || ', relevance: ' || printf('%.2f', score) || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM ({_FOUND}) GROUP BY 1) c ON q.query_id = c.query_id""")
def _(spark, d):
    return compose.switched_context(_asked(spark, d), _searched(spark, d), F.col("query_id") % 100 == 0)


@query("search_confidence", f"SELECT q.query_id, round(CASE WHEN any_value(m) IS NULL THEN 0.0 ELSE least(any_value(m) * 1.2, 1.0) END, 6) AS confidence FROM ({_ASKED}) q LEFT JOIN (SELECT query_id, avg(score) AS m FROM ({_HITS}) GROUP BY 1) h ON q.query_id = h.query_id GROUP BY 1")
def _(spark, d):
    return compose.confidence(_asked(spark, d), _hits(spark, d)).select("query_id", F.round("confidence", 6).alias("confidence"))


@query("rag_context", f"SELECT query_id, string_agg(printf('[Source %d, relevance: %.2f]', rank, score) || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM ({_HITS}) GROUP BY 1")
def _(spark, d):
    return compose.rag_context(_hits(spark, d))


@query("answer_context", f"SELECT query_id, string_agg('Source ' || rank || ':' || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) AS context FROM ({_HITS}) GROUP BY 1")
def _(spark, d):
    return compose.answer_context(_hits(spark, d))


@query("search_listing", f"SELECT q.query_id, CASE WHEN any_value(b) IS NULL THEN 'Nothing found.' ELSE 'Results for ''' || any_value(q.query) || ''':' || chr(10) || chr(10) || any_value(b) END AS listing FROM ({_ASKED}) q LEFT JOIN (SELECT query_id, string_agg(rank || '. ' || content || chr(10) || printf('(relevance: %.3f)', score), chr(10) || chr(10) ORDER BY rank) AS b FROM ({_HITS}) GROUP BY 1) h ON q.query_id = h.query_id GROUP BY 1")
def _(spark, d):
    return compose.search_listing(_asked(spark, d), _hits(spark, d))


_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 20)[1:4]"


@query("extractive_answer", f"SELECT doc_id, 'Found:' || chr(10) || array_to_string(list_transform({_LINES}, lambda x: '• ' || x), chr(10)) || chr(10) || 'Ask for more.' AS answer FROM (SELECT doc_id, text AS t FROM documents)")
def _(spark, d):
    return _read(spark, d, "documents").select("doc_id", compose.extractive_answer(F.col("text"), "Found:\n", "\nAsk for more.").alias("answer"))


@query("full_answer", f"WITH h AS ({_HITS}), c AS (SELECT query_id, string_agg('Source ' || rank || ':' || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) AS t, string_agg(CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END, '|' ORDER BY rank) AS sources, least(avg(score) * 1.2, 1.0) AS m FROM h GROUP BY 1) SELECT q.query_id, CASE WHEN t IS NULL THEN 'No answer.' ELSE 'Found:' || chr(10) || array_to_string(list_transform({_LINES}, lambda x: '• ' || x), chr(10)) || chr(10) || 'Ask for more.' END AS answer, coalesce(sources, '') AS sources, round(coalesce(m, 0.0), 6) AS confidence FROM ({_ASKED}) q LEFT JOIN c ON q.query_id = c.query_id")
def _(spark, d):
    told = compose.answers(_asked(spark, d), _hits(spark, d), "Found:\n", "\nAsk for more.", "No answer.")
    return told.select("query_id", "answer", F.array_join("sources.content", "|").alias("sources"), F.round("confidence", 6).alias("confidence"))


@query("source_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def _(spark, d):
    return _read(spark, d, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


_SYN = f"(SELECT row_number() OVER () - 1 AS ord, * FROM (VALUES {_values(SYNONYMS)}) v(phrase, expansion))"


@query("expand_synonyms", f"""
WITH q AS (SELECT conv_id, turn, text AS q FROM conversations UNION ALL SELECT conv_id, -1 - turn, ' The ' FROM conversations WHERE turn = 0),
f AS (SELECT q, CASE WHEN x THEN expansion ELSE substr(q, 1, position(phrase IN lower(q)) - 1) || expansion || substr(q, position(phrase IN lower(q)) + length(phrase)) END AS e,
        row_number() OVER (PARTITION BY q ORDER BY x DESC, length(phrase) DESC, ord) AS r
      FROM (SELECT *, regexp_replace(lower(q), '^\\s+|\\s+$', '', 'g') = phrase AS x FROM (SELECT DISTINCT q FROM q) JOIN {_SYN} s ON contains(lower(q), phrase)))
SELECT conv_id, turn, coalesce(e, q.q) AS expanded FROM q LEFT JOIN f ON q.q = f.q AND r = 1""")
def _(spark, d):
    talks = _read(spark, d, "conversations")
    asked = talks.select("conv_id", "turn", F.col("text").alias("query")).unionByName(talks.where("turn = 0").select("conv_id", (-1 - F.col("turn")).alias("turn"), F.lit(" The ").alias("query")))
    return rewrite.expand_synonyms(asked, _synonyms(spark)).select("conv_id", "turn", "expanded")


@query("query_for_search", f"""
WITH f AS (SELECT q, CASE WHEN x THEN expansion ELSE substr(q, 1, position(phrase IN lower(q)) - 1) || expansion || substr(q, position(phrase IN lower(q)) + length(phrase)) END AS e,
        row_number() OVER (PARTITION BY q ORDER BY x DESC, length(phrase) DESC, ord) AS r
      FROM (SELECT *, regexp_replace(lower(q), '^\\s+|\\s+$', '', 'g') = phrase AS x FROM (SELECT DISTINCT text AS q FROM conversations) JOIN {_SYN} s ON contains(lower(q), phrase)))
SELECT conv_id, turn, text AS message, coalesce(e, text) AS query_for_search FROM conversations c LEFT JOIN f ON c.text = f.q AND r = 1 WHERE role = 'user'""")
def _(spark, d):
    """What a request searches by, beside what the model is told."""
    asked = _read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("message"))
    return retrieve.with_query_for_search(asked, _synonyms(spark))


@query("abbrev_lookup", f"SELECT conv_id, turn, coalesce(expansion, w) AS expanded FROM (SELECT conv_id, turn, string_split(text, ' ')[1] AS w FROM conversations) LEFT JOIN {_SYN} s ON lower(w) = phrase")
def _(spark, d):
    asked = _read(spark, d, "conversations").select("conv_id", "turn", F.get(F.split("text", " "), F.lit(0)).alias("w"))
    return rewrite.abbreviation(asked, _synonyms(spark), "w").select("conv_id", "turn", "expanded")


_PRO = f"(VALUES {_values([(k, *v) for k, v in PROMPTS.items()])}) p(key, name, prompt)"
_KEYED = "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'missing' ELSE role END AS asked FROM conversations"


def _keyed(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "missing").otherwise(F.col("role")).alias("asked"))


@query("prompt_lookup", f"SELECT conv_id, turn, asked, coalesce(p.name, '{PROMPTS['general_assistant'][0]}') AS name, coalesce(p.prompt, '{PROMPTS['general_assistant'][1]}') AS prompt FROM ({_KEYED}) LEFT JOIN {_PRO} ON asked = key")
def _(spark, d):
    return chat.prompt_lookup(_keyed(spark, d), _prompts(spark), "asked", "general_assistant")


@query("prompt_strict", f"SELECT conv_id, turn, asked, key IS NOT NULL AS accepted, coalesce(key, 'general_assistant') AS active FROM ({_KEYED}) LEFT JOIN {_PRO} ON asked = key")
def _(spark, d):
    rows = _keyed(spark, d).withColumn("now", F.lit("general_assistant"))
    return chat.prompt_change(rows, _prompts(spark), "asked", "now").drop("now")


@query("prompt_list", f"SELECT key, name, coalesce(n, 0) AS uses FROM {_PRO} LEFT JOIN (SELECT asked, count(*) AS n FROM ({_KEYED}) GROUP BY 1) ON asked = key")
def _(spark, d):
    return chat.list_prompts(_prompts(spark), _keyed(spark, d), "asked")


_ENDS = "CASE WHEN turn % 3 = 0 THEN NULL ELSE 'Re: ' || text END"


@query("turn_pairs", f"SELECT conv_id, turn, part, CASE part WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE part WHEN 0 THEN text ELSE {_ENDS} END AS text FROM (SELECT *, unnest([0, 1]) AS part FROM conversations WHERE {_ENDS} IS NOT NULL)")
def _(spark, d):
    """What a turn appends to the log: both rows if it was answered, none otherwise."""
    rows = _read(spark, d, "conversations")
    answered = rows.select("conv_id", "turn", F.col("text").alias("message"), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("Re: "), "text")).alias("answer"))
    return chat.turn_pair(answered, ["conv_id", "turn"])


@query("session_ids", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'new-' || sha256(CAST(event_id AS VARCHAR)) ELSE CAST(user_id AS VARCHAR) END AS session_id FROM events")
def _(spark, d):
    """Every fourth request comes without a session."""
    rows = _read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("session_id"))
    return sessions.with_session(rows, ["event_id"])


@query("saved_conversations", f"SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '2025-01-01T00:00:00' ELSE 'unknown' END AS timestamp, CASE conv_id % 3 WHEN 0 THEN '{PROMPTS['user'][0]}' ELSE 'unknown' END AS prompt_name, CAST(CASE conv_id % 3 WHEN 0 THEN count(*) ELSE 0 END AS INT) AS messages, conv_id % 3 = 2 AS error FROM conversations GROUP BY conv_id")
def _(spark, d):
    """Whole saved objects, empty ones and broken ones in one listing."""
    rows = conversations.history_of(_read(spark, d, "conversations"))
    name, prompt = PROMPTS["user"]
    saved = conversations.as_object(F.col("history"), F.lit("2025-01-01T00:00:00"), F.lit("local"), F.lit("user"), F.lit(name), F.lit(prompt))
    third = F.col("conv_id") % 3
    rows = rows.select("conv_id", F.when(third == 0, saved).when(third == 1, F.lit("{}")).otherwise(F.concat(F.lit("{broken "), saved)).alias("saved"))
    return conversations.listing(rows, "saved")


class Refusing:
    """Vectors of two numbers that SQL can make too: the length, and the length of the first line; texts of some lengths fail."""

    def get_embeddings(self, texts: list[str]) -> list[list[float] | None]:
        for t in texts:
            if len(t) % 11 == 0:
                raise ValueError(f"{len(t)} characters")
        return [None if len(t) % 7 == 0 else [float(len(t)), float(len(t.split("\n")[0]))] for t in texts]


@query("embedding_errors", """SELECT conv_id, turn, CASE WHEN e IS NULL THEN n END AS first, CASE WHEN e IS NULL THEN CAST(length(string_split(text, chr(10))[1]) AS DOUBLE) END AS second, e AS error
  FROM (SELECT *, CAST(length(text) AS DOUBLE) AS n, CASE WHEN text IS NULL THEN 'no text' WHEN length(text) % 11 = 0 THEN 'ValueError: ' || length(text) || ' characters' WHEN length(text) % 7 = 0 THEN 'no vector' END AS e FROM conversations)""")
def _(spark, d):
    """Requests of many texts in which some fail: each text has a vector or says why it has none."""
    rows = embed.embedded(_read(spark, d, "conversations"), "text", Refusing(), retries=0)
    return rows.select("conv_id", "turn", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(1)).alias("second"), F.col("embedding_error").alias("error"))


@query("history_window_10", "SELECT event_id, coalesce(string_agg(e2, ',' ORDER BY t2, i2), '') AS earlier FROM (SELECT a.event_id, b.event_type AS e2, b.ts AS t2, b.event_id AS i2 FROM (SELECT *, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a LEFT JOIN (SELECT *, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 10 AND a.r - 1) GROUP BY 1")
def _(spark, d):
    rows = _read(spark, d, "events")
    rows = chat.with_earlier(rows, "user_id", ["ts", "event_id"], F.col("event_type"), F.date_trunc("month", "ts"))
    return rows.select("event_id", F.array_join("earlier", ",").alias("earlier"))


def _keep(n):
    sql = f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= {n}"
    return query(f"history_keep_{n}", sql)(lambda spark, d: chat.newest(_read(spark, d, "events"), "user_id", ["ts", "event_id"], n).select("user_id", "event_id"))


_keep(chat.KEPT_BASIC)
_keep(chat.KEPT_ADVANCED)


@query("clear_history", "SELECT user_id, event_id FROM events e LEFT JOIN (SELECT user_id AS u, max(event_id) AS m FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = u WHERE m IS NULL OR event_id > m")
def _(spark, d):
    return chat.since_clear(_read(spark, d, "events"), "user_id", "event_id", "event_type", "purchase").select("user_id", "event_id")


@query("prompt_with_context", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND text <> '' THEN 'You answer briefly.' || chr(10) || chr(10) || 'Context:' || chr(10) || text ELSE 'You answer briefly.' END AS prompt FROM conversations")
def _(spark, d):
    context = F.when(F.col("turn") % 2 == 0, F.col("text"))
    return _read(spark, d, "conversations").select("conv_id", "turn", chat.with_context(F.lit("You answer briefly."), context).alias("prompt"))


_MSG = "struct_pack(role := role, content := text)"


@query("chat_payload", f"""
SELECT conv_id, turn, to_json(struct_pack(model := 'local', messages := list_concat(list_concat([struct_pack(role := 'system', content := 'You answer briefly.')], coalesce(h, [])), [struct_pack(role := 'user', content := text)]), temperature := 0.7, max_tokens := 2000, stream := false)) AS body
FROM (SELECT *, list({_MSG}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h FROM conversations)""")
def _(spark, d):
    rows = _read(spark, d, "conversations")
    past = chat.earlier("conv_id", ["turn"], F.struct("role", F.col("text").alias("content")))
    said = chat.messages(F.lit("You answer briefly."), F.col("past"), F.col("text"))
    return rows.withColumn("past", past).select("conv_id", "turn", chat.payload(F.lit("local"), said).alias("body"))


@query("conversation_stats", "SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages FROM conversations GROUP BY 1")
def _(spark, d):
    return chat.role_counts(_read(spark, d, "conversations"))


@query("usage_stats", "SELECT count(*) FILTER (event_type <> 'error') AS total_messages, CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN event_id % 100 END), 0) AS BIGINT) AS total_tokens, count(*) FILTER (event_id % 3 > 0) AS total_rag_queries FROM events")
def _(spark, d):
    return chat.usage(_read(spark, d, "events"), F.col("event_type") != "error", F.col("event_id") % 100, F.col("event_id") % 3)


def _log(spark, d):
    rows = _read(spark, d, "events")
    return rows.select(F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_id").alias("seq"), F.lit("user").alias("role"), F.col("event_type").alias("content"))


@query("session_history", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS message_count, string_agg(event_type, ',' ORDER BY ts, event_id) AS contents FROM events GROUP BY 1")
def _(spark, d):
    return sessions.history(_log(spark, d)).select("session_id", "message_count", F.array_join("messages.content", ",").alias("contents"))


@query("session_messages", "SELECT CAST(user_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, event_type AS content FROM events")
def _(spark, d):
    return sessions.messages(_log(spark, d)).select("session_id", "position", "content")


@query("session_pages", """SELECT session_id, page, string_agg(event_type, ',' ORDER BY r) AS contents FROM (
  SELECT *, (r - 1) // 7 AS page FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)) GROUP BY 1, 2""")
def _(spark, d):
    return sessions.history_pages(_log(spark, d), 7).select("session_id", "page", F.array_join("messages.content", ",").alias("contents"))


@query("session_history_newest", "SELECT session_id, n AS message_count, string_agg(event_type, ',' ORDER BY ts, event_id) AS contents FROM (SELECT *, CAST(user_id AS VARCHAR) AS session_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY 1, 2")
def _(spark, d):
    return sessions.history(_log(spark, d), 10).select("session_id", "message_count", F.array_join("messages.content", ",").alias("contents"))


@query("session_visits", """SELECT session_id, min(ts) AS opened, max(ts) AS last, count(*) AS message_count, count(*) AS user_messages FROM (
  SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(p) <= 259200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS stretch
  FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY session_id, stretch""")
def _(spark, d):
    """Stretches of a user's events without three days between them."""
    return sessions.visits(_log(spark, d), 3 * 86400)


@query("active_sessions", "SELECT count(DISTINCT user_id) AS active_sessions FROM events")
def _(spark, d):
    return sessions.active(_log(spark, d))


@query("session_lookup", "SELECT a.session_id, CASE WHEN n IS NULL THEN 404 ELSE 200 END AS status, coalesce(n, 0) AS message_count FROM (SELECT CAST(c_custkey AS VARCHAR) AS session_id FROM customer) a LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n FROM events GROUP BY 1) b ON a.session_id = b.session_id")
def _(spark, d):
    asked = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    return sessions.lookup(_log(spark, d), asked)


@query("session_upsert", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS message_rows, count(*) FILTER (part = 0) AS user_rows FROM (SELECT user_id, unnest(CASE WHEN event_type = 'purchase' THEN [1] ELSE [0, 1] END) AS part FROM events) GROUP BY 1")
def _(spark, d):
    error = F.when(F.col("content") == "purchase", "failed")
    replies = sessions.with_session(_log(spark, d)).select("session_id", "ts", F.col("content").alias("message"), F.lit("ok").alias("answer"), error.alias("error"))
    rows = sessions.log_rows(replies)
    return rows.groupBy("session_id").agg(F.count("*").alias("message_rows"), F.count_if(F.col("role") == "user").alias("user_rows"))


_LINE = "CASE turn % 4 WHEN 0 THEN '/TOPK ' || conv_id WHEN 1 THEN '/nope ' || text WHEN 2 THEN '/clear' ELSE text END"


def _line():
    turn = F.col("turn") % 4
    return F.when(turn == 0, F.concat(F.lit("/TOPK "), F.col("conv_id").cast("string"))).when(turn == 1, F.concat(F.lit("/nope "), F.col("text"))).when(turn == 2, F.lit("/clear")).otherwise(F.col("text"))


def _route(bot):
    known = ", ".join(f"'{c}'" for c in route.COMMANDS[bot])
    sql = f"SELECT conv_id, turn, command, argument, CASE WHEN command IS NULL THEN 'message' WHEN command IN ({known}) THEN command ELSE 'unknown' END AS routed FROM (SELECT conv_id, turn, CASE WHEN starts_with(l, '/') THEN lower(string_split(l, ' ')[1]) END AS command, CASE WHEN starts_with(l, '/') AND contains(l, ' ') THEN substr(l, position(' ' IN l) + 1) END AS argument FROM (SELECT *, {_LINE} AS l FROM conversations))"

    def run(spark, d):
        command, argument = route.command_parts(_line())
        return _read(spark, d, "conversations").select("conv_id", "turn", command.alias("command"), argument.alias("argument"), route.route(command, bot).alias("routed"))

    query("command_route" if bot == "rag" else f"command_route_{bot}", sql)(run)


for _bot in route.COMMANDS:
    _route(_bot)


@query("canned_queries", f"SELECT conv_id, c.query FROM (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '/prices' WHEN 1 THEN '/contacts' ELSE '/help' END AS command FROM conversations WHERE turn = 0) JOIN (VALUES {_values(CANNED)}) c(command, query) USING (command)")
def _(spark, d):
    third = F.col("conv_id") % 3
    rows = _read(spark, d, "conversations").where("turn = 0").select("conv_id", F.when(third == 0, "/prices").when(third == 1, "/contacts").otherwise("/help").alias("command"))
    return route.canned_query(rows, spark.createDataFrame(CANNED, "command string, query string"), "command").select("conv_id", "query")


_MESSAGE = "CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) ELSE text END"


@query("request_validation", f"SELECT conv_id, turn, CASE WHEN m IS NULL OR trim(m, ' ' || chr(10)) = '' THEN 400 ELSE 200 END AS status, CASE WHEN m IS NULL THEN 'message is missing' WHEN trim(m, ' ' || chr(10)) = '' THEN 'message is empty' END AS error FROM (SELECT *, {_MESSAGE} AS m FROM conversations)")
def _(spark, d):
    third = F.col("turn") % 3
    status, error = route.validated(F.when(third == 1, F.lit(" \n")).when(third == 2, F.col("text")))
    return _read(spark, d, "conversations").select("conv_id", "turn", status.alias("status"), error.alias("error"))


@query("blank_skip", f"SELECT conv_id, turn FROM conversations WHERE trim({_MESSAGE}, ' ' || chr(10)) <> ''")
def _(spark, d):
    third = F.col("turn") % 3
    rows = _read(spark, d, "conversations").withColumn("m", F.when(third == 1, F.lit(" \n")).when(third == 2, F.col("text")))
    return route.not_blank(rows, "m").select("conv_id", "turn")


@query("topk_guard", "SELECT conv_id, turn, CASE WHEN regexp_full_match(a, '[0-9]{1,18}') THEN CAST(a AS BIGINT) ELSE -1 END AS k FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST(conv_id AS VARCHAR) WHEN 1 THEN conv_id || 'x' ELSE '-1' END AS a FROM conversations)".replace("CAST(a AS", "TRY_CAST(a AS"))
def _(spark, d):
    third, key = F.col("turn") % 3, F.col("conv_id").cast("string")
    arg = F.when(third == 0, key).when(third == 1, F.concat(key, F.lit("x"))).otherwise(F.lit("-1"))
    return _read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(route.count_argument(arg), F.lit(-1)).alias("k"))


@query("load_path", "SELECT conv_id, turn, CASE WHEN starts_with(n, 'conversations/') THEN n ELSE 'conversations/' || n END AS path FROM (SELECT conv_id, turn, CASE WHEN ends_with(a, '.json') THEN a ELSE a || '.json' END AS n FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'talk' || conv_id WHEN 1 THEN 'talk' || conv_id || '.json' ELSE 'conversations/talk' || conv_id END AS a FROM conversations))")
def _(spark, d):
    third, name = F.col("turn") % 3, F.concat(F.lit("talk"), F.col("conv_id").cast("string"))
    arg = F.when(third == 0, name).when(third == 1, F.concat(name, F.lit(".json"))).otherwise(F.concat(F.lit("conversations/"), name))
    return _read(spark, d, "conversations").select("conv_id", "turn", route.load_path(arg).alias("path"))


_JOINED = "string_agg(role || '=' || text, '|' ORDER BY turn)"


def _flat(history):
    return F.array_join(F.transform(history, lambda m: F.concat(m.role, F.lit("="), m.content)), "|")


@query("conversation_roundtrip_v1", f"SELECT conv_id, {_JOINED} AS history, to_json(list({_MSG} ORDER BY turn)) AS saved FROM conversations GROUP BY 1")
def _(spark, d):
    saved = conversations.history_of(_read(spark, d, "conversations")).select("conv_id", conversations.as_array(F.col("history")).alias("saved"))
    return saved.select("conv_id", _flat(conversations.from_array(F.col("saved"))).alias("history"), "saved")


@query("conversation_roundtrip_v2", f"SELECT conv_id, {_JOINED} AS history, 'user' AS prompt_key FROM conversations GROUP BY 1")
def _(spark, d):
    rows = conversations.history_of(_read(spark, d, "conversations"))
    name, prompt = PROMPTS["user"]
    saved = conversations.as_object(F.col("history"), F.lit("2025-01-01T00:00:00"), F.lit("local"), F.lit("user"), F.lit(name), F.lit(prompt))
    history, key = conversations.from_object(F.col("saved"))
    return rows.select("conv_id", saved.alias("saved")).select("conv_id", _flat(history).alias("history"), key.alias("prompt_key"))


@query("conversation_pages", f"""SELECT conv_id, page, string_agg(role || '=' || text, '|' ORDER BY r) AS history FROM (
  SELECT *, (r - 1) // 3 AS page FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)) GROUP BY 1, 2""")
def _(spark, d):
    """Saved in three steps, the last of them twice: each save changes a conversation's last page alone."""
    kept = conversations.PagedConversations(spark, _shared(spark, "pages"), 3)
    rows = _read(spark, d, "conversations")
    for version, some in enumerate(["turn < 2", "turn = 2 OR turn = 3", "turn > 3", "turn > 3"]):
        kept.save(rows.where(some), min(version, 2))
    return kept.pages().select("conv_id", "page", _flat(F.col("messages")).alias("history"))


@query("conversation_pages_forms", f"""WITH p AS (SELECT conv_id, page, string_agg(role || '=' || text, '|' ORDER BY turn) AS history, to_json(list({_MSG} ORDER BY turn)) AS saved
  FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS page FROM conversations) GROUP BY 1, 2)
  SELECT conv_id, page, history, saved, history AS history_v2, history AS history_v3 FROM p""")
def _(spark, d):
    """A page is a short conversation: each of the three saved forms takes it and gives it back."""
    rows = _read(spark, d, "conversations")
    rows = pages.paged(rows, "conv_id", ["turn"], F.struct("role", F.col("text").alias("content")), F.floor(F.col("turn") / pages.RANGE), 3)
    h, at, n = F.col("messages"), F.lit("2025-01-02T03:04:05").cast("timestamp"), F.lit(0).cast("long")
    name, prompt = PROMPTS["user"]
    two = conversations.as_object(h, F.lit("2025-01-01T00:00:00"), F.lit("local"), F.lit("user"), F.lit(name), F.lit(prompt))
    three = conversations.as_state(h, F.size(h).cast("long"), n, n, at, F.lit("local"), F.lit("user"), at)
    rows = rows.select("conv_id", "page", conversations.as_array(h).alias("saved"), two.alias("two"), three.alias("three"))
    back = [conversations.from_array(F.col("saved")), conversations.from_object(F.col("two"))[0], conversations.from_state(F.col("three")).conversation_history]
    return rows.select("conv_id", "page", "saved", *[_flat(x).alias(c) for x, c in zip(back, ["history", "history_v2", "history_v3"])])


@query("conversation_roundtrip_v3", f"SELECT conv_id, {_JOINED} AS history, count(*) AS total_messages, '2025-01-02T03:04:05' AS start_time FROM conversations GROUP BY 1")
def _(spark, d):
    rows = conversations.history_of(_read(spark, d, "conversations"))
    at = F.lit("2025-01-02 03:04:05").cast("timestamp_ntz")
    saved = conversations.as_state(F.col("history"), F.size("history").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), at, F.lit("local"), F.lit("user"), at)
    state = conversations.from_state(F.col("saved"))
    return rows.select("conv_id", saved.alias("saved")).select("conv_id", _flat(state.conversation_history).alias("history"), state.stats.total_messages.alias("total_messages"), state.stats.start_time.alias("start_time"))


@query("store_upsert", CHUNKS_SQL + " SELECT filename, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'New: ' || content ELSE content END AS content FROM chunks")
def _(spark, d):
    old = _chunks(spark, d)
    return files.upserted(old, old.where("chunk_id % 2 = 0").withColumn("content", F.concat(F.lit("New: "), "content"))).select("filename", "chunk_id", "content")


def _shared(spark, name):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = folder or f"{tempfile.gettempdir()}/docloom"
    return f"{folder.rstrip('/')}/stores/{name}-{uuid.uuid4().hex}"


def _store(spark, name):
    return files.ChunkStore(spark, _shared(spark, name))


@query("store_roundtrip", CHUNKS_SQL + """, s AS (SELECT filename, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'New: ' || content ELSE content END AS content FROM chunks)
  SELECT *, 'upserted' AS step FROM s UNION ALL SELECT filename, chunk_id, content, 'appended' FROM chunks WHERE chunk_id = 0""")
def _(spark, d):
    """A store written, upserted and read again, then cleared, appended to and read again."""
    store, chunks = _store(spark, "roundtrip"), _chunks(spark, d)
    store.append(chunks)
    store.upsert(chunks.where("chunk_id % 2 = 0").withColumn("content", F.concat(F.lit("New: "), "content")))
    first = store.read().select("filename", "chunk_id", "content", F.lit("upserted").alias("step"))
    store.clear()
    store.append(chunks.where("chunk_id = 0"))
    return first.unionByName(store.read().select("filename", "chunk_id", "content", F.lit("appended").alias("step")))


@query("store_ingest", CHUNKS_SQL + """ SELECT filename, chunk_id, content, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS version
  FROM chunks JOIN (SELECT doc_id, 'doc_' || doc_id || '.txt' AS filename FROM documents) USING (filename)""")
def _(spark, d):
    """Documents as files, two of three of them longer at first: the second ingest chunks those alone, and a third one finds nothing new."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    store, new = _store(spark, "ingest"), _read(spark, d, "documents").select("doc_id", name.alias("path"), name.alias("filename"), "text")
    old = new.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" "), "text")))
    chunks = lambda texts: chunk.chunk_rows(texts, F.col("filename"), F.col("text"))
    for texts in (old, new, new):
        store.ingest(texts, chunks)
    return store.read(commits=True).select("filename", "chunk_id", "content", "version")


@query("completion_response", "SELECT conv_id, turn, text AS content, CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END AS total_tokens, 'm' || turn || ',n' AS models, 'm' || turn AS first_model, true AS connected FROM conversations")
def _(spark, d):
    """Answers of model servers, read back from their JSON."""
    rows = _read(spark, d, "conversations")
    usage = F.when(F.col("turn") % 2 == 0, F.struct(F.length("text").alias("total_tokens")))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), usage.alias("usage")))
    listed = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("m"), F.col("turn")).alias("id")), F.struct(F.lit("n").alias("id"))).alias("data")))
    rows = rows.select("conv_id", "turn", answer.alias("a"), listed.alias("l"))
    content, tokens = models.completion(F.col("a"))
    return rows.select("conv_id", "turn", content.alias("content"), tokens.cast("long").alias("total_tokens"), F.array_join(models.model_ids(F.col("l")), ",").alias("models"), models.first_model(F.col("l")).alias("first_model"), models.connected(F.col("l")).alias("connected"))


@query("store_clear", CHUNKS_SQL + " SELECT count(*) AS before, CAST(count(*) FILTER (false) AS BIGINT) AS total_chunks FROM chunks")
def _(spark, d):
    """A store written and cleared; the version before is still there to read."""
    store = _store(spark, "clear")
    full = store.append(_chunks(spark, d))
    before = store.read(full)
    store.clear()
    return catalog.stats(before).select(F.col("total_chunks").alias("before")).crossJoin(catalog.stats(store.read()).select("total_chunks"))


#: Every fifth document comes again, cut to its first half.
_HALVED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM documents)"


@query("store_replace", CHUNKS_SQL.replace("FROM documents", f"FROM {_HALVED}") + " SELECT filename, chunk_id, content FROM chunks")
def _(spark, d):
    """Files added again after they have become shorter: none of their old chunks stays."""
    store, docs = _store(spark, "replace"), _read(spark, d, "documents")
    store.append(_chunks_of(docs))
    half = F.expr("substring(text, 1, CAST(floor(length(text) / 2) AS INT))")
    store.replace_files(_chunks_of(docs.where("doc_id % 5 = 0").withColumn("text", half)))
    store.compact()
    return store.read().select("filename", "chunk_id", "content")


#: Width of the fake vectors in queries; the default of the operator is 1536.
WIDTH = 64


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, "contexts")  # texts are cut and embedded once, however often the search reads them
    store.append(embed.with_embeddings(_chunks(spark, d), "content", embed.FakeEmbedder(WIDTH)))
    chunks = store.read().select(F.xxhash64("filename", "chunk_id").alias("id"), "content", F.col("embedding").alias("vector"))
    asked = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = rewrite.expand_synonyms(asked, _synonyms(spark))
    asked = embed.with_embeddings(asked, "expanded", embed.FakeEmbedder(WIDTH), "vector").select("query_id", "vector")
    found = retrieve.top_k_batch(chunks, asked, 3)
    return found.join(chunks.select("id", "content"), "id").select("query_id", "rank", "content", F.col("similarity").alias("score"))


@query("fake_embedding_topk")
def _(spark, d):
    return _contexts(spark, d).select("query_id", "rank", "content", F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions -> rewritten -> embedded -> three nearest chunks -> context."""
    return compose.rag_context(_contexts(spark, sf_dir))
