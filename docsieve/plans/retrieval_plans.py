"""Retrieval and session queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.functions.text import tokens
from docsieve.operators import retrieval as rt
from docsieve.operators import sessions as ss
from docsieve.plans.registry import query, table, text_table

# ---------------------------------------------------------------- vectors

# Queries: every hundredth vector.
_VQ_SQL = "SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0"
_COS = "round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6)"


def _knn_sql(k: int, where: str = "true") -> str:
    return f"""SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id AS id, score, label FROM (
      SELECT query_id, vec_id, label, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, vec_id) AS r
      FROM ({_VQ_SQL}) q, embeddings WHERE {where}) WHERE r <= {k}"""


def _vector_queries(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _knn(spark, sf, k, **kw):
    return rt.knn(_vector_queries(spark, sf), table(spark, sf, "embeddings"), k, id="vec_id", **kw)


def _letters(c):
    """A vector of letter counts: an embedding function that SQL can repeat."""
    low = F.lower(c)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in "aeiourstn"])


def _letters_sql(x: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower({x})) - length(replace(lower({x}), '{ch}', '')) AS DOUBLE)" for ch in "aeiourstn") + "]"


@query("a19_embed_expression", f"SELECT doc_id, array_to_string(list_transform({_letters_sql('text')}, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS cells FROM documents")
def a19_expression(spark, sf):
    out = rt.embed(table(spark, sf, "documents").select("doc_id", "text"), "text", _letters)
    cells = F.transform("embedding", lambda v: v.cast("bigint").cast("string"))
    return out.select("doc_id", F.array_join(cells, ",").alias("cells"))


_TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_tokens(x: str) -> str:
    return _TOKENS.format(x)


@query("a19_embed", f"SELECT doc_id, 64 AS dim, CAST(len({sql_tokens('text')}) AS DOUBLE) AS terms FROM documents")
def a19(spark, sf):
    out = rt.embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v)
    return out.select("doc_id", F.size("embedding").alias("dim"), total.alias("terms"))


@query("a20_knn", f"SELECT query_id, rank, id, score FROM ({_knn_sql(10)})")
def a20(spark, sf):
    return _knn(spark, sf, 10)


@query("a20_knn_grid", f"SELECT query_id, rank, id, score FROM ({_knn_sql(10)})")
def a20_grid(spark, sf):
    # The way for query tables that are too large to send to every task.
    return _knn(spark, sf, 10, block_bytes=20_000)


@query("a21_knn_filtered", f"SELECT query_id, rank, id, score FROM ({_knn_sql(5, 'label >= 2')})")
def a21(spark, sf):
    return _knn(spark, sf, 5, where=F.col("label") >= 2)


# ---------------------------------------------------------------- keywords

_BM25_SQL = f"""
  WITH d AS (SELECT doc_id, t, len(t) AS dl FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
    q AS (SELECT item_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM benchmark),
    p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT item_id AS query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
          FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY 1, 2)
  SELECT query_id, CAST(r AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= {{k}}"""


def _text_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(spark, sf, k, **kw):
    return rt.bm25(_text_queries(spark, sf), text_table(spark, sf, "documents"), k, id="doc_id", **kw)


def _k(sql: str, k: int) -> str:
    return sql.replace("{k}", str(k))


@query("a23_bm25", _k(_BM25_SQL, 10))
def a23(spark, sf):
    return _bm25(spark, sf, 10)


@query("a23_bm25_blocks", _k(_BM25_SQL, 10))
def a23_blocks(spark, sf):
    # Many small blocks of queries over the same postings.
    return _bm25(spark, sf, 10, query_terms=300)


def _letter_knn(spark, sf, k):
    q = rt.embed(_text_queries(spark, sf), "query", _letters)
    return rt.knn(q, rt.embed(text_table(spark, sf, "documents"), "text", _letters), k, id="doc_id")


_LETTER_KNN_SQL = f"""SELECT query_id, rank, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
      SELECT b.item_id AS query_id, d.doc_id AS id, CASE WHEN list_sum(d.v) = 0 THEN 0 ELSE round(list_cosine_similarity(b.v, d.v), 6) END AS s
      FROM (SELECT item_id, {_letters_sql('text')} AS v FROM benchmark) b, (SELECT doc_id, {_letters_sql('text')} AS v FROM documents) d)) WHERE rank <= 15"""


_HYBRID_SQL = f"""
  SELECT query_id, CAST(r AS INTEGER) AS rank, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (
      SELECT query_id, id, round(sum(1.0e0 / (rank + 60)), 9) AS score FROM (
        SELECT query_id, rank, id FROM ({_LETTER_KNN_SQL}) UNION ALL SELECT query_id, rank, id FROM ({_k(_BM25_SQL, 15)})) GROUP BY 1, 2)) WHERE r <= {{k}}"""


def _hybrid(spark, sf, k):
    return rt.hybrid_search(_letter_knn(spark, sf, 15), _bm25(spark, sf, 15), k)


@query("a22_hybrid_search", _k(_HYBRID_SQL, 5))
def a22(spark, sf):
    return _hybrid(spark, sf, 5)


# ---------------------------------------------------------------- after the ranking


def _found(spark, sf, k=15):
    """Ranked documents with their text; the source plays the part of the address."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.col("text").alias("chunk_text"))
    return _bm25(spark, sf, k).join(docs, "id")


FOUND_SQL = f"SELECT b.*, d.source AS url, d.text AS chunk_text FROM ({_k(_BM25_SQL, 15)}) b JOIN documents d ON d.doc_id = b.id"


@query("a24_diversify", f"""
  SELECT query_id, CAST(r AS INTEGER) AS rank, id, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank) AS n FROM ({FOUND_SQL})) WHERE n = 1) WHERE r <= 5""")
def a24(spark, sf):
    return rt.diversify(_found(spark, sf), "url", 5).select("query_id", "rank", "id", "url")


OVERLAP_SQL = f"CAST(len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct({sql_tokens('f.chunk_text')}))) AS DOUBLE)"


@query("a25_rerank", f"""
  SELECT query_id, CAST(r AS INTEGER) AS rank, id, s AS new_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS r FROM (
    SELECT f.query_id, f.rank, f.id, {OVERLAP_SQL} AS s FROM ({FOUND_SQL}) f JOIN benchmark b ON b.item_id = f.query_id)) WHERE r <= 5""")
def a25(spark, sf):
    both = _found(spark, sf).join(_text_queries(spark, sf), "query_id")
    overlap = F.size(F.array_intersect(tokens(F.col("query")), tokens(F.col("chunk_text"))))
    return rt.rerank(both, overlap, 5).select("query_id", "rank", "id", "new_score")


@query("a26_build_context", f"""
  SELECT b.item_id AS query_id, md5(coalesce(c, 'No relevant documentation found.')) AS context FROM benchmark b LEFT JOIN (
    SELECT query_id, string_agg('[Source ' || rank || '] ' || url || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c
    FROM ({FOUND_SQL}) GROUP BY query_id) ON query_id = b.item_id""")
def a26(spark, sf):
    out = rt.build_context(_text_queries(spark, sf), _found(spark, sf))
    return out.select("query_id", F.md5("context").alias("context"))


@query("a27_retrieval_query", """
  SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS query FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') WHERE r <= 3 GROUP BY conv_id""")
def a27(spark, sf):
    return ss.retrieval_query(table(spark, sf, "conversations")).select("conv_id", F.md5("query").alias("query"))


@query("a28_index_health", f"""
  SELECT b.item_id AS query_id, coalesce(n, 0) AS results, coalesce(l, false) AS valid, round(coalesce(s, 0), 6) AS relevance,
    coalesce(n, 0) > 0 AND coalesce(l, false) AND coalesce(s, 0) >= 0.6 AS healthy
  FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n, bool_and(length(chunk_text) > 10) AS l,
    avg(CASE WHEN contains(lower(chunk_text), 'tion') OR contains(lower(chunk_text), 'the') THEN 1.0e0 ELSE 0.0e0 END) AS s FROM ({FOUND_SQL}) GROUP BY query_id) ON query_id = b.item_id""")
def a28(spark, sf):
    out = rt.index_health(_text_queries(spark, sf), _found(spark, sf), ["tion", "the"])
    return out.withColumn("relevance", F.round("relevance", 6))


@query("a29_result_overlap", f"""
  WITH r AS ({_k(_BM25_SQL, 10)}), p AS (SELECT item_id AS a, item_id + 1 AS b FROM benchmark)
  SELECT a, b, CAST((SELECT count(*) FROM r x JOIN r y ON x.id = y.id WHERE x.query_id = p.a AND y.query_id = p.b) AS INTEGER) AS shared,
    (SELECT count(*) FROM r x JOIN r y ON x.id = y.id WHERE x.query_id = p.a AND y.query_id = p.b)
      < least((SELECT count(*) FROM r WHERE query_id = a), (SELECT count(*) FROM r WHERE query_id = b)) AS distinct_results FROM p""")
def a29(spark, sf):
    pairs = table(spark, sf, "benchmark").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    return rt.result_overlap(_bm25(spark, sf, 10), pairs)


@query("a30_citation_count", f"""
  SELECT b.item_id AS query_id, count(url) AS retrieved, CAST(sum(CASE WHEN contains(b.text || ' src1 src3 src5', url) THEN 1 ELSE 0 END) AS BIGINT) AS cited
  FROM benchmark b LEFT JOIN ({FOUND_SQL}) f ON f.query_id = b.item_id GROUP BY b.item_id""")
def a30(spark, sf):
    answers = _text_queries(spark, sf).select("query_id", F.concat("query", F.lit(" src1 src3 src5")).alias("answer"))
    return rt.citation_count(answers, _found(spark, sf))


# ---------------------------------------------------------------- sessions

TURNS_SQL = """
  SELECT conv_id AS session_id, n AS turn_number, left(arg_min(text, turn) FILTER (role = 'user'), 4000) AS user_message,
    left(arg_min(text, turn) FILTER (role = 'assistant'), 4000) AS assistant_response FROM (
    SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n
    FROM conversations WHERE role IN ('user', 'assistant')) WHERE n > 0 GROUP BY conv_id, n"""


def _turns(spark, sf):
    return ss.turns_from_messages(table(spark, sf, "conversations"))


@query("a93_turns_from_messages", f"SELECT session_id, turn_number, md5(user_message) AS user_message, md5(assistant_response) AS assistant_response FROM ({TURNS_SQL})")
def a93(spark, sf):
    return _turns(spark, sf).select(
        "session_id", "turn_number", F.md5("user_message").alias("user_message"), F.md5("assistant_response").alias("assistant_response")
    )


@query("a94_history", f"""
  SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_number, half) AS INTEGER) AS position, role, md5(content) AS content FROM (
    SELECT session_id, turn_number, 0 AS half, 'user' AS role, user_message AS content, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) AS r FROM ({TURNS_SQL})
    UNION ALL SELECT session_id, turn_number, 1, 'assistant', assistant_response, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) FROM ({TURNS_SQL}))
  WHERE r <= 2 AND content <> ''""")
def a94(spark, sf):
    return ss.history(_turns(spark, sf), 2).select("session_id", "position", "role", F.md5("content").alias("content"))


@query("a95_recent_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def a95(spark, sf):
    return ss.recent_messages(table(spark, sf, "conversations"), 2).select("conv_id", "turn", "role")


@query("a96_fold_threads", """
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, role, md5(text) AS content,
    CAST(count_if(role = 'user') OVER (PARTITION BY conv_id) AS INTEGER) AS turn_count, max(turn) OVER (PARTITION BY conv_id) AS updated_at
  FROM conversations WHERE role <> '' AND text <> ''""")
def a96(spark, sf):
    return ss.fold_threads(table(spark, sf, "conversations")).withColumn("content", F.md5("content"))


def _memories(spark, sf):
    """What each user did last, one memory per kind of event."""
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), "props", F.col("ts").alias("saved_at"), "value").select(
        "user_id", "key", F.concat("key", F.lit(" worth "), F.floor("value").cast("string"), F.lit(" "), "props").alias("value"), "saved_at"
    )


_MEMORY_SQL = """SELECT user_id, event_type AS key, arg_max(event_type || ' worth ' || CAST(floor(value) AS BIGINT) || ' ' || props, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2"""


@query("a97_upsert_memory", f"SELECT user_id, key, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved_at FROM ({_MEMORY_SQL})")
def a97(spark, sf):
    return ss.upsert_memory(_memories(spark, sf)).withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"))


_RQ_SQL = "SELECT user_id AS query_id, user_id, arg_min('worth ' || event_type || ' ' || props, event_id) AS query FROM events GROUP BY user_id"


@query("a98_recall", f"""
  SELECT query_id, key, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM (
    SELECT q.query_id, m.key, CAST(len(list_intersect(list_distinct({sql_tokens('q.query')}), list_distinct({sql_tokens('m.value')}))) AS BIGINT) AS score
    FROM ({_RQ_SQL}) q JOIN ({_MEMORY_SQL}) m ON m.user_id = q.user_id)) WHERE r <= 3""")
def a98(spark, sf):
    asked = table(spark, sf, "events").groupBy("user_id").agg(
        F.min_by(F.concat(F.lit("worth "), "event_type", F.lit(" "), "props"), "event_id").alias("query")
    ).withColumn("query_id", F.col("user_id"))
    overlap = lambda query, value: F.size(F.array_intersect(tokens(query), tokens(value))).cast("bigint")
    return ss.recall(ss.upsert_memory(_memories(spark, sf)), asked, overlap, 3).select("query_id", "key", "score", "rank")


@query("a99_history_with_fallback", f"""
  SELECT session_id, turn_number, 'primary' AS store FROM ({TURNS_SQL}) WHERE contains(user_message, 'ion') UNION ALL
  SELECT session_id, turn_number, 'secondary' FROM ({TURNS_SQL}) WHERE session_id NOT IN (SELECT session_id FROM ({TURNS_SQL}) WHERE contains(user_message, 'ion'))""")
def a99(spark, sf):
    turns = _turns(spark, sf)
    primary = turns.where(F.contains("user_message", F.lit("ion"))).withColumn("store", F.lit("primary"))
    out = ss.history_with_fallback(primary, turns.withColumn("store", F.lit("secondary")))
    return out.select("session_id", "turn_number", "store")


@query("a100_safe_user_id", "SELECT c_custkey, replace(replace(c_name || '@mail.' || c_mktsegment, '.', '_'), '@', '_at_') AS user_id FROM customer")
def a100(spark, sf):
    raw = F.concat("c_name", F.lit("@mail."), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", ss.safe_user_id(raw).alias("user_id"))


_TOOLS = {"german": ["UND ", "nicht"], "french": [" Les ", " une "], "never": ["qqqq"], "english": [" the "]}


@query("a101_match_triggers", " UNION ALL ".join(
    f"SELECT conv_id, turn, '{n}' AS tool FROM conversations WHERE " + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in ws)
    for n, ws in _TOOLS.items()))
def a101(spark, sf):
    return ss.match_triggers(table(spark, sf, "conversations"), "text", _TOOLS).select("conv_id", "turn", "tool")
