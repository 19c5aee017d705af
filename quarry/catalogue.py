"""The registered queries over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import ip, scalar
from quarry.operators import analytics as a
from quarry.operators import chunking, render, search, upkeep
from quarry.operators.keyword_index import KeywordIndex
from quarry.operators.vector_index import VectorIndex
from quarry.plans import indexing, schedule
from quarry.session import scratch_path
from quarry.sources import conversations, crawl, files, views
from quarry.sources.views import table
from quarry.streaming import ratelimit, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANGE = a.Period(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 23, 59, 59, 999000))
ROLLING = a.Period(days=1000, today=dt.date(2024, 1, 25))
NOW = dt.datetime(2024, 1, 20)
#: A fixed query vector of the embeddings' 64 dimensions.
QUERY = [((i * 37) % 101 - 50) / 50 for i in range(64)]
WORDS = "the of"
SOURCES = ["src0", "src1", "src2", "src3", "src4"]

LOG_SQL = """
WITH log AS (
  SELECT CASE event_type WHEN 'view' THEN 'search-docs' WHEN 'click' THEN 'search-code' WHEN 'error' THEN 'search-docs' WHEN 'purchase' THEN 'explore-docs' ELSE 'knowledge-faq' END AS tool_name,
    CASE WHEN k % 10 = 9 THEN '<redacted>' ELSE concat('q', k) END AS query_text,
    CASE WHEN event_type = 'error' THEN 0 ELSE k % 7 END AS result_count,
    CASE WHEN event_type = 'error' OR k % 7 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 100 END AS top_score,
    CASE WHEN user_id % 13 = 0 THEN -1 ELSE CAST(floor(value) AS INT) END AS latency_ms,
    CASE WHEN k % 11 = 0 THEN NULL ELSE concat('src', k % 4) END AS source_name,
    ts AS created_at, user_id
  FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events)
)"""
IN_RANGE = "created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59.999'"
IN_ROLLING = "created_at >= TIMESTAMP '2023-01-25 00:00:00'"
LIVE, TOLD = "latency_ms >= 0", "query_text <> '<redacted>'"

CHUNKS_SQL = """
WITH chunks AS (
  SELECT doc_id AS id, source AS source_name, concat('https://docs.example.com/', source, '/', doc_id) AS source_url,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('Title ', doc_id) END AS title, text AS content, CAST(embedding AS DOUBLE[]) AS embedding,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('https://git.example.com/', lang) END AS repo_url,
    concat('docs/', doc_id // 16, '.md') AS file_path, n_chars AS end_line, lang AS language, CAST(doc_id % 16 AS INT) AS chunk_index,
    doc_id % 10 + 0.5 AS confidence, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INT)) AS indexed_at, concat('v', doc_id % 2) AS version
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id
)"""
QUERY_SQL = "[" + ", ".join(f"{x!r}" for x in QUERY) + "]::DOUBLE[]"
COSINE = f"list_cosine_similarity(embedding, {QUERY_SQL})"
TOKENS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
RANK_BY_VECTOR = f"SELECT id, {COSINE} AS similarity FROM chunks ORDER BY similarity DESC, id LIMIT"
HAS_WORDS = "list_contains(tokens, 'the') AND list_contains(tokens, 'of')"
RANK_BY_WORDS = f"SELECT id, CAST(len(list_filter(tokens, lambda t: t IN ('the', 'of'))) AS DOUBLE) AS similarity FROM (SELECT id, {TOKENS} AS tokens FROM chunks) WHERE {HAS_WORDS} ORDER BY similarity DESC, id LIMIT"


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# analytics


def summary_sql(where: str, inside: str) -> str:
    return f"""{LOG_SQL}, live AS (SELECT * FROM log WHERE {where} AND {LIVE} AND {TOLD} AND {inside}),
    ranked AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS r, count(*) OVER () AS n FROM live)
    SELECT (SELECT count(*) FROM log WHERE {where}) AS all_time_total, count(*) AS window_total, count(*) FILTER (result_count = 0) AS empty_count,
      round(CASE WHEN count(*) = 0 THEN 0 ELSE CAST(count(*) FILTER (result_count = 0) AS DOUBLE) / count(*) END, 6) AS empty_rate,
      CAST(coalesce(round(avg(latency_ms)), 0) AS BIGINT) AS avg_latency_ms,
      coalesce((SELECT min(latency_ms) FROM ranked WHERE r = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)), 0) AS p95_latency_ms, count(*) > 100000 AS p95_sampled
    FROM live"""


@query("analytics_summary", summary_sql("true", IN_RANGE))
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.summary(views.query_log(spark, d), RANGE)


@query("analytics_summary_filtered", summary_sql("tool_name LIKE 'search-%' AND source_name = 'src1'", IN_RANGE))
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.summary(a.filtered(views.query_log(spark, d), "search", "src1"), RANGE)


@query("analytics_summary_rolling", summary_sql("true", IN_ROLLING))
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.summary(views.query_log(spark, d), ROLLING)


def per_day_sql(first: str, last: str, inside: str) -> str:
    return f"""{LOG_SQL} SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(c.n, 0) AS n
    FROM (SELECT CAST(unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day) s
    LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM log WHERE {LIVE} AND {TOLD} AND {inside} GROUP BY 1) c ON s.day = c.day"""


@query("analytics_per_day", per_day_sql("2024-01-05", "2024-01-20", IN_RANGE))
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.per_day(views.query_log(spark, d), RANGE)


@query("analytics_per_day_rolling", per_day_sql("2023-01-25", "2024-01-25", IN_ROLLING))
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.per_day(views.query_log(spark, d), ROLLING)


@query("analytics_by_source", f"{LOG_SQL} SELECT source_name, count(*) AS n FROM log WHERE {LIVE} AND {IN_RANGE} AND source_name IS NOT NULL GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.by_source(views.query_log(spark, d), RANGE)


@query(
    "analytics_top_queries",
    f"""{LOG_SQL} SELECT query_text, tool_name, count(*) AS n, round(avg(result_count) FILTER (result_count >= 0), 6) AS avg_results, round(avg(top_score), 6) AS avg_top_score
    FROM log WHERE {LIVE} AND {TOLD} AND {IN_RANGE} GROUP BY 1, 2 HAVING bool_or(result_count > 0) ORDER BY n DESC, query_text, tool_name LIMIT 50""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.top_queries(views.query_log(spark, d), RANGE)


@query(
    "analytics_empty_queries",
    f"""{LOG_SQL} SELECT query_text, tool_name, source_name, count(*) AS n, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_seen
    FROM log WHERE {LIVE} AND {TOLD} AND {IN_RANGE} AND result_count = 0 GROUP BY 1, 2, 3 ORDER BY n DESC, query_text, tool_name, source_name NULLS LAST LIMIT 50""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.empty_queries(views.query_log(spark, d), RANGE)


@query("analytics_tool_counts", f"{LOG_SQL} SELECT split_part(tool_name, '-', 1) AS tool_type, count(*) AS n FROM log WHERE {LIVE} AND {IN_RANGE} GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.tool_counts(views.query_log(spark, d), RANGE)


@query("analytics_earliest_day", f"{LOG_SQL} SELECT strftime(min(created_at), '%Y-%m-%d') AS earliest_day FROM log")
def _(spark: SparkSession, d: str) -> DataFrame:
    return a.earliest_day(views.query_log(spark, d))


@query("analytics_retention", f"{LOG_SQL} SELECT tool_name, count(*) AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest FROM log WHERE created_at > TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    left = a.retained(views.query_log(spark, d), NOW, 10)
    return left.groupBy("tool_name").agg(F.count("*").alias("n"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("oldest"))


# retrieval


@query("vector_topk", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUERY_SQL}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {QUERY_SQL}) DESC, vec_id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(search.vector_search(rows, QUERY, 10).select("id", "similarity"), "similarity")


@query("vector_topk_filtered", f"{CHUNKS_SQL} SELECT id, file_path, round(similarity, 6) AS similarity FROM (SELECT id, file_path, {COSINE} AS similarity FROM chunks WHERE source_name = 'src1' AND version = 'v1' ORDER BY similarity DESC, id LIMIT 10) WHERE similarity >= 0.2")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = search.vector_search(views.chunks(spark, d), QUERY, 10, "src1", "v1", 0.2)
    return rounded(found.select("id", "file_path", "similarity"), "similarity")


@query("keyword_simple", f"{CHUNKS_SQL} {RANK_BY_WORDS} 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return search.simple_keyword_search(docs, WORDS, 20).select("id", "similarity")


@query("keyword_postings", f"{CHUNKS_SQL} {RANK_BY_WORDS} 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return search.postings_search(search.postings(docs), WORDS, 20)


_STORED: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, d: str, kind: str, build: Callable[[str], object]) -> object:
    """An index over the tables of a folder, built at its first use in an application and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _STORED:
        _STORED[key] = build(scratch_path(spark, kind))
    return _STORED[key]


def keyword_index(spark: SparkSession, d: str) -> KeywordIndex:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return stored(spark, d, "keyword-index", lambda path: KeywordIndex.build(docs, path))


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    return stored(spark, d, "vector-index", lambda path: VectorIndex.build(views.chunks(spark, d), path))


#: Words outside ASCII, which stems leave alone and which are no other word's stem, so that SQL can tell them.
FAR_WORDS = "für ü"
BM25_SQL = f"""{CHUNKS_SQL}, t AS (SELECT id, {TOKENS} AS tokens FROM chunks), s AS (SELECT count(*) AS n, avg(len(tokens)) AS average FROM t),
  c AS (SELECT id, len(tokens) AS l, len(list_filter(tokens, lambda x: x = 'für')) AS a, len(list_filter(tokens, lambda x: x = 'ü')) AS b FROM t),
  f AS (SELECT sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS b FROM c),
  r AS (SELECT id, ln(1 + (n - f.a + 0.5) / (f.a + 0.5)) * c.a * 2.2 / (c.a + 1.2 * (0.25 + 0.75 * l / average)) + ln(1 + (n - f.b + 0.5) / (f.b + 0.5)) * c.b * 2.2 / (c.b + 1.2 * (0.25 + 0.75 * l / average)) AS s FROM c, s, f WHERE c.a > 0 AND c.b > 0)
  SELECT id, round(s, 6) AS similarity FROM r ORDER BY s DESC, id LIMIT 20"""
COVERS_SQL = f"""{CHUNKS_SQL}, t AS (SELECT id, {TOKENS} AS tokens FROM chunks), p AS (SELECT id, unnest(range(1, len(tokens) + 1)) AS k, unnest(tokens) AS w FROM t),
  w AS (SELECT id, k, max(CASE WHEN w = 'für' THEN k END) OVER o AS a, max(CASE WHEN w = 'ü' THEN k END) OVER o AS b FROM p WHERE w IN ('für', 'ü') WINDOW o AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT id, least(a, b) AS first, min(k) AS last FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
  SELECT id, round(sum(1.0::DOUBLE / (last - first)), 6) AS similarity FROM c GROUP BY 1 ORDER BY sum(1.0::DOUBLE / (last - first)) DESC, id LIMIT 20"""


@query("keyword_ranked", BM25_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(keyword_index(spark, d).ranked(FAR_WORDS, 20).select("id", "similarity"), "similarity")


@query("keyword_proximity", COVERS_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(keyword_index(spark, d).proximate(FAR_WORDS, 20).select("id", "similarity"), "similarity")


@query("keyword_index_terms", f"{CHUNKS_SQL} SELECT term, count(DISTINCT id) AS documents, max(tf) AS most FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS}) AS term FROM chunks) GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    index = KeywordIndex.build(docs, scratch_path(spark, "keyword-index"), simple=True)
    return index.rows_of_terms()


@query("vector_index_topk", f"{CHUNKS_SQL} SELECT id, round(similarity, 6) AS similarity FROM ({RANK_BY_VECTOR} 10)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector_index(spark, d).search(QUERY, 10).select("id", "similarity"), "similarity")


@query("vector_index_filtered", f"{CHUNKS_SQL} SELECT id, file_path, round(similarity, 6) AS similarity FROM (SELECT id, file_path, {COSINE} AS similarity FROM chunks WHERE source_name = 'src1' AND version = 'v1' AND embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 10) WHERE similarity >= 0.2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vector_index(spark, d).search(QUERY, 10, "src1", "v1", 0.2).select("id", "file_path", "similarity"), "similarity")


@query(
    "address_ranges",
    """WITH r AS (SELECT DISTINCT 16 + s_suppkey % 9 AS n, ((167772160 + (s_suppkey % 64) * 65536) >> (16 - s_suppkey % 9)) AS p, concat('10.', s_suppkey % 64, '.0.0/', 16 + s_suppkey % 9) AS cidr FROM supplier),
    a AS (SELECT c_custkey, 167772160 + (c_custkey % 64) * 65536 + (c_custkey // 64 % 256) * 256 + c_custkey % 256 AS ip FROM customer)
    SELECT c_custkey, arg_max(cidr, n) AS matched FROM a LEFT JOIN r ON (ip >> (32 - n)) = p GROUP BY 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").selectExpr("c_custkey", "concat_ws('.', '10', c_custkey % 64, c_custkey DIV 64 % 256, c_custkey % 256) AS ip")
    ranges = table(spark, d, "supplier").selectExpr("concat('10.', s_suppkey % 64, '.0.0/', 16 + s_suppkey % 9) AS cidr")
    return ip.in_ranges(rows, ranges).select("c_custkey", "matched")


@query(
    "hybrid_rrf",
    f"""{CHUNKS_SQL}, v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS r, 0 AS l FROM ({RANK_BY_VECTOR} 40)),
    w AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS r, 1 AS l FROM ({RANK_BY_WORDS} 40)),
    f AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s, min(l * 1000 + r) AS o FROM (SELECT * FROM v UNION ALL SELECT * FROM w) GROUP BY id)
    SELECT id, round(s, 6) AS similarity FROM f ORDER BY s DESC, o LIMIT 20""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.hybrid_search(views.chunks(spark, d), QUERY, WORDS, 20, simple=True).select("id", "similarity"), "similarity")


FAQ_SQL = """
WITH faq AS (
  SELECT conv_id AS id, concat('faq', conv_id % 3) AS source_name, q.text AS title, concat('Q: ', q.text, chr(10), chr(10), 'A: ', a.text) AS content, conv_id % 10 / 10.0 AS confidence
  FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1) q
  JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1) a USING (conv_id)
)"""


#: The first line after Q:, and what follows the first line that begins with A:.
QUESTION_SQL = r"nullif(trim(regexp_extract(content, '^Q:\s*([^\n\r\x{85}\x{2028}\x{2029}]+?)(?:\n|$)', 1), ' '), '')"
ANSWER_SQL = r"md5(CASE WHEN contains(content, chr(10) || 'A:') THEN trim(regexp_extract(content, '\nA:\s*([\s\S]*)', 1), ' ') ELSE content END)"


def faq_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A question and answer of each conversation."""
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    said = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n").alias("answer"))
    return asked.join(said, "conv_id").selectExpr(
        "conv_id AS id", "concat('faq', conv_id % 3) AS source_name", "title", "concat('Q: ', title, '\n\nA: ', answer) AS content", "concat('{\"confidence\": 0.', conv_id % 10, '}') AS metadata",
        "timestampadd(MINUTE, CAST(conv_id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS indexed_at", "CAST(NULL AS ARRAY<FLOAT>) AS embedding", "concat('c/', conv_id) AS file_path", "CAST(NULL AS STRING) AS source_url",
    )


@query("faq_browse", f"{FAQ_SQL} SELECT id, source_name, title, md5(content) AS content_md5, CAST(confidence AS DOUBLE) AS confidence FROM faq WHERE source_name IN ('faq0', 'faq2') AND confidence >= 0.7 ORDER BY source_name, id DESC LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.faq_browse(faq_chunks(spark, d), ["faq0", "faq2"], 0.7, 100).select("id", "source_name", "title", F.md5("content").alias("content_md5"), "confidence")


@query("faq_answers", f"{FAQ_SQL} SELECT id, {QUESTION_SQL} AS question, {ANSWER_SQL} AS answer_md5 FROM faq")
def _(spark: SparkSession, d: str) -> DataFrame:
    return faq_chunks(spark, d).select("id", scalar.question(F.col("content")).alias("question"), F.md5(scalar.answer(F.col("content"))).alias("answer_md5"))


@query(
    "knowledge_search",
    f"""{CHUNKS_SQL}, s AS (SELECT id, source_name, confidence, {COSINE} AS similarity FROM chunks WHERE source_name IN ('src0', 'src1', 'src2', 'src3', 'src4')),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY similarity DESC, id) AS k FROM s), t AS (SELECT * FROM r WHERE k <= 20 ORDER BY similarity DESC, id LIMIT 20)
    SELECT id, source_name, round(similarity, 6) AS similarity, CAST(confidence AS DOUBLE) AS confidence FROM t WHERE confidence >= 3.5""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = search.knowledge_search(views.chunks(spark, d), QUERY, SOURCES, 20, 3.5)
    return rounded(found.select("id", "source_name", "similarity", "confidence"), "similarity")


@query("related_files", f"{CHUNKS_SQL} SELECT path, round(max(similarity), 6) AS similarity FROM (SELECT concat('/', source_name, '/', file_path) AS path, {COSINE} AS similarity, id FROM chunks ORDER BY similarity DESC, id LIMIT 50) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(search.related_files(views.chunks(spark, d), QUERY, limit=50), "similarity")


LINES_SQL = "SELECT concat('/', source_name, '/', file_path) AS path, id, unnest(str_split(content, chr(10))) AS text, generate_subscripts(str_split(content, chr(10)), 1) AS line FROM"


@query("literal_grep", f"{CHUNKS_SQL} SELECT path, CAST(line AS INT) AS line, md5(text) AS text_md5, id FROM ({LINES_SQL} chunks) WHERE contains(lower(text), 'of the')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(views.chunks(spark, d), "of THE").select("path", "line", F.md5("text").alias("text_md5"), "id")


@query("semantic_grep", f"{CHUNKS_SQL}, hits AS (SELECT * FROM chunks WHERE id IN (SELECT id FROM ({RANK_BY_VECTOR} 20)) OR id IN (SELECT id FROM ({RANK_BY_WORDS} 20))) SELECT path, CAST(line AS INT) AS line, md5(text) AS text_md5, id FROM ({LINES_SQL} hits) WHERE contains(lower(text), 'of the')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.semantic_grep(views.chunks(spark, d), QUERY, "of the").select("path", "line", F.md5("text").alias("text_md5"), "id")


@query("file_listing", f"{CHUNKS_SQL} SELECT source_name AS name, true AS is_dir, CAST(sum(strlen(content)) AS BIGINT) AS size, CAST(sum(len(content) - len(replace(content, chr(10), ''))) AS BIGINT) AS lines FROM chunks GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.listing(views.chunks(spark, d), "/")


# state of the index


@query("index_stats", f"{CHUNKS_SQL} SELECT source_name, count(*) AS chunks, NULL::BIGINT AS repos FROM chunks GROUP BY 1 UNION ALL SELECT '*', count(*), count(DISTINCT repo_url) FROM chunks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.index_stats(views.chunks(spark, d))


@query("distinct_items", f"{CHUNKS_SQL} SELECT DISTINCT file_path FROM chunks")
def _(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.item_ids(views.chunks(spark, d))


@query("removed_items", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"))
    return upkeep.removed_ids(ids("documents", "doc_id"), ids("embeddings", "vec_id"))


NEW_SQL = "SELECT id, source_name, file_path, chunk_index, concat('New ', id) AS title FROM chunks WHERE language = 'en' AND version = 'v1'"


def _new_version(chunks: DataFrame) -> DataFrame:
    return chunks.where("language = 'en' AND version = 'v1'").withColumn("title", F.concat(F.lit("New "), "id"))


@query("chunk_upsert", f"{CHUNKS_SQL}, new AS ({NEW_SQL}) SELECT id, source_name, file_path, chunk_index, title FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.source_name = c.source_name AND n.file_path = c.file_path AND n.chunk_index = c.chunk_index) UNION ALL SELECT * FROM new")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunks(spark, d).select("id", "source_name", "file_path", "chunk_index", "title", "language", "version")
    return upkeep.upserted(rows, _new_version(rows)).drop("language", "version")


@query("chunk_reindex", f"{CHUNKS_SQL}, new AS ({NEW_SQL}) SELECT id, source_name, file_path, chunk_index, title FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.source_name = c.source_name AND n.file_path = c.file_path) UNION ALL SELECT * FROM new")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunks(spark, d).select("id", "source_name", "file_path", "chunk_index", "title", "language", "version")
    return upkeep.reindexed(rows, _new_version(rows)).drop("language", "version")


# texts


@query("llms_index", f"{CHUNKS_SQL} SELECT source_name, file_path, coalesce(arg_min_null(title, chunk_index), file_path) AS title FROM chunks GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return render.llms_index(views.chunks(spark, d))


@query("llms_full", f"{CHUNKS_SQL} SELECT source_name, file_path, md5(string_agg(content, chr(10) ORDER BY chunk_index, id)) AS content_md5 FROM chunks GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return render.llms_full(views.chunks(spark, d)).select("source_name", "file_path", F.md5("content").alias("content_md5"))


@query("thread_transcript", "SELECT conv_id AS thread, md5(string_agg(concat('[', turn, '] ', coalesce(role, 'unknown'), ': ', coalesce(text, '')), chr(10) || chr(10) ORDER BY turn, text)) AS transcript_md5 FROM conversations GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return render.transcripts(views.threads(spark, d)).select("thread", F.md5("transcript").alias("transcript_md5"))


@query("low_semantic_value", "SELECT doc_id, CASE WHEN text IS NULL THEN false ELSE len(text) >= 500 AND CAST(len(regexp_replace(text[1:8192], '[^0-9.,;=]', '', 'g')) AS DOUBLE) / len(text[1:8192]) > 0.3 END AS low FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalar.low_semantic_value(F.col("text")).alias("low"))


@query(
    "url_derivation",
    """SELECT doc_id, concat('https://x.example/', regexp_replace(regexp_replace(regexp_replace(concat(source, '/(', lang, ')/', CASE WHEN n_chars > 2000 THEN 'index' ELSE concat('p', doc_id) END, '.md'), '\\.md$', ''), '\\([^)]*\\)/', '', 'g'), '/index$', '')) AS url FROM documents""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/("), "lang", F.lit(")/"), F.when(F.col("n_chars") > 2000, "index").otherwise(F.concat(F.lit("p"), "doc_id")), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", scalar.derived_url(path, "https://x.example/", strip_suffix=".md", strip_route_groups=True, strip_index=True).alias("url"))


@query("glob_match", "SELECT page_id, regexp_matches(url, '^https?://[^/]*/(?:en|fr)/.*$') AND NOT contains(url, '#') AS chosen FROM pages WHERE url IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    chosen = scalar.glob_match(F.col("url"), ["http*://*/en/**", "http*://*/fr/**"], ["**#**"])
    return table(spark, d, "pages").where("url IS NOT NULL").select("page_id", chosen.alias("chosen"))


@query("language_detect", "SELECT lang, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'typescript' WHEN 'fr' THEN 'weird' ELSE 'makefile' END AS language, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr("CASE lang WHEN 'en' THEN concat('a/', doc_id, '.py') WHEN 'de' THEN concat(doc_id, '.TSX') WHEN 'fr' THEN concat(doc_id, '.weird') ELSE 'Makefile' END")
    return table(spark, d, "documents").groupBy("lang", scalar.language(path).alias("language")).agg(F.count("*").alias("n"))


# chunkers


def item_rows(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    if name == "pages":
        return table(spark, d, name).select(F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("id"), F.col("html").alias("content"))
    return table(spark, d, name).select(F.concat("source", F.lit("/"), "doc_id", F.lit(".py")).alias("id"), F.col("text").alias("content"))


def digested(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "chunk_index", "title", "start_line", "end_line", "language", F.array_join("heading_path", " > ").alias("heading_path"), F.md5("content").alias("content_md5"))


SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279) || chr(8232) || chr(8233)"


@query("chunk_raw_text", f"SELECT concat(source, '/', doc_id, '.py') AS id, CAST(0 AS INT) AS chunk_index, md5(trim(text, {SPACES_SQL})) AS content_md5 FROM documents WHERE trim(text, {SPACES_SQL}) <> '' AND NOT contains(text, chr(10) || chr(10))")
def _(spark: SparkSession, d: str) -> DataFrame:
    # the SQL knows documents of one paragraph; those with blank lines are held against brute force
    return digested(chunking.chunked(item_rows(spark, d), "raw-text")).select("id", "chunk_index", "content_md5")


JOINED_SQL = f"""
WITH RECURSIVE items AS (SELECT concat('docs/', doc_id // 16) AS id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY 1),
ps AS (SELECT id, list_filter(list_transform(regexp_split_to_array(content, '\\n\\n+'), lambda p: trim(p, {SPACES_SQL})), lambda p: p <> '') AS p FROM items),
fold AS (
  SELECT id, p, 1 AS i, 0 AS k, len(p[1]) AS size FROM ps WHERE len(p) > 0
  UNION ALL
  SELECT id, p, i + 1, CASE WHEN size + 2 + len(p[i + 1]) <= 2400 THEN k ELSE k + 1 END, CASE WHEN size + 2 + len(p[i + 1]) <= 2400 THEN size + 2 + len(p[i + 1]) ELSE len(p[i + 1]) END FROM fold WHERE i < len(p)
),
whole AS (SELECT id, k, string_agg(p[i], chr(10) || chr(10) ORDER BY i) AS t FROM fold GROUP BY 1, 2),
ends AS (SELECT *, right(lag(t) OVER (PARTITION BY id ORDER BY k), 200) AS e FROM whole)
SELECT id, CAST(k AS INT) AS chunk_index, md5(trim(CASE WHEN e IS NULL THEN t ELSE concat(CASE WHEN contains(e, chr(10)) THEN concat(chr(10), list_last(str_split(e, chr(10)))) ELSE e END, chr(10), chr(10), t) END, {SPACES_SQL})) AS content_md5 FROM ends"""


@query("chunk_raw_text_joined", JOINED_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Files of up to sixteen documents, one after the other: paragraphs are merged, split into chunks and overlap."""
    parts = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.concat(F.lit("docs/"), F.expr("doc_id DIV 16")).alias("id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("all"))
    items = parts.select("id", F.array_join(F.transform("all", lambda r: r["text"]), "\n\n").alias("content"))
    return digested(chunking.chunked(items, "raw-text")).select("id", "chunk_index", "content_md5")


@query("chunk_qa", f"{FAQ_SQL} SELECT CAST(id AS VARCHAR) AS id, CAST(0 AS INT) AS chunk_index, {QUESTION_SQL} AS title, md5(trim(content, {SPACES_SQL})) AS content_md5 FROM faq WHERE trim(content, {SPACES_SQL}) <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    faq = faq_chunks(spark, d).select(F.col("id").cast("string").alias("id"), "content")
    return digested(chunking.chunked(faq, "qa")).select("id", "chunk_index", "title", "content_md5")


@query("chunk_document")
def _(spark: SparkSession, d: str) -> DataFrame:
    return digested(chunking.chunked(item_rows(spark, d), "document"))


@query("chunk_markdown")
def _(spark: SparkSession, d: str) -> DataFrame:
    return digested(chunking.chunked(item_rows(spark, d), "markdown"))


@query("chunk_code")
def _(spark: SparkSession, d: str) -> DataFrame:
    return digested(chunking.chunked(item_rows(spark, d), "code"))


@query("chunk_html")
def _(spark: SparkSession, d: str) -> DataFrame:
    return digested(chunking.chunked(item_rows(spark, d, "pages"), "html"))


# the pages' links are given as one attribute, from the root of their site; other forms are held against small pages in the tests
LINKS_SQL = """
WITH found AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages WHERE url IS NOT NULL),
each AS (SELECT page_id, origin, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS place FROM found),
made AS (SELECT page_id, place, rtrim(origin || regexp_extract(replace(replace(href, '&quot;', '"'), '&amp;', '&'), '^[^#]*'), '/') AS link FROM each),
firsts AS (SELECT page_id, link, min(place) AS place FROM made GROUP BY page_id, link)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INT) AS i, link FROM firsts"""


@query("link_extraction", LINKS_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").where("url IS NOT NULL")
    return pages.select("page_id", F.posexplode(crawl.links(F.coalesce("html", F.lit("")), "url")).alias("i", "link"))


# for pages as given: scripts and styles, comments and tags are taken out, then the entities that occur are read
VISIBLE_SQL = """
WITH bodies AS (SELECT page_id, coalesce(regexp_extract(html, '<body[^>]*>(.*)', 1, 's'), '') AS body FROM pages),
bare AS (SELECT page_id, regexp_replace(regexp_replace(body, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs'), '<[^>]*>', '', 'gs') AS text FROM bodies),
shown AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(text, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;?', '&', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM bare)
SELECT page_id, CAST(length(text) AS INT) AS n_chars, md5(text) AS text_md5 FROM shown"""


@query("visible_text", VISIBLE_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", crawl.visible_text(F.coalesce("html", F.lit(""))).alias("text")).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("index_documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = item_rows(spark, d).select("id", "content", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_url"), F.lit("{}").alias("metadata"))
    found = indexing.chunk_rows(rows, "docs", "document", indexing.hashed_embedder)
    return found.select("id", "file_path", "chunk_index", "title", F.md5("content").alias("content_md5"), F.size("embedding").alias("dimensions"), F.get("embedding", F.lit(0)).alias("first"))


# state


@query(
    "session_expiry",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS n_events
    FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events))
    GROUP BY user_id, s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return sessions.expired(events).select("user_id", at("started"), at("last_seen"), "n_events")


RATE_SQL = """
WITH RECURSIVE requests AS (SELECT user_id AS key, event_id, ts FROM events),
windows AS (
  SELECT key, min(ts) AS start FROM requests GROUP BY key
  UNION ALL
  SELECT r.key, min(r.ts) FROM windows w JOIN requests r ON r.key = w.key AND r.ts >= w.start + INTERVAL 86400 SECOND GROUP BY r.key
),
counted AS (
  SELECT r.key, event_id, epoch_us(ts) / 1e6 AS now, epoch_us(w.start) / 1e6 AS start, row_number() OVER (PARTITION BY r.key, w.start ORDER BY ts, event_id) AS n
  FROM requests r ASOF JOIN windows w ON r.key = w.key AND r.ts >= w.start
)
SELECT key, event_id, n <= 2 AS admitted, CASE WHEN n <= 2 THEN 0 ELSE round(start + 86400 - now, 3) END AS retry_after FROM counted"""


@query("rate_limit", RATE_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id")
    return ratelimit.limited(requests, limit=2, window=86_400).select("key", "event_id", "admitted", F.round("retry_after", 3).alias("retry_after"))


ADMISSION_SQL = """
WITH RECURSIVE asked AS (
  SELECT user_id // 4 AS address, concat('10.0.', user_id // 4 // 256 % 256, '.', user_id // 4 % 256) AS ip, ts,
    CAST(CASE WHEN (user_id + 1) % 8 < 2 THEN (user_id + 1) // 8 * 8 ELSE user_id END AS VARCHAR) AS sid, CASE event_type WHEN 'purchase' THEN 'close' ELSE 'open' END AS kind
  FROM events
),
-- addresses 1 and 2, 3 and 4 and so on share a session
placed AS (SELECT *, (address + 1) // 2 AS linked, row_number() OVER (PARTITION BY (address + 1) // 2 ORDER BY ts, sid, ip, kind) AS i FROM asked),
walk AS (
  SELECT linked, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(sid VARCHAR, ip VARCHAR)[]) AS owned, CAST(NULL AS VARCHAR) AS ip, CAST(NULL AS VARCHAR) AS verdict FROM (SELECT DISTINCT linked FROM placed)
  UNION ALL
  SELECT linked, i,
    CASE verdict WHEN 'closed' THEN list_filter(owned, lambda o: o.sid <> sid) WHEN 'open' THEN list_append(owned, {'sid': sid, 'ip': ip}) ELSE owned END, ip, verdict
  FROM (
    SELECT p.linked, p.i, p.ip, p.sid, w.owned,
      CASE WHEN kind = 'close' THEN 'closed' WHEN p.ip = '10.0.0.0' THEN 'bypass'
        WHEN len(list_filter(w.owned, lambda o: o.sid = p.sid AND o.ip = p.ip)) > 0 THEN 'again' WHEN len(list_filter(w.owned, lambda o: o.sid = p.sid)) > 0 THEN 'sid-collision'
        WHEN len(list_filter(w.owned, lambda o: o.ip = p.ip)) >= 3 THEN 'rate-limit' ELSE 'open' END AS verdict
    FROM walk w JOIN placed p ON p.linked = w.linked AND p.i = w.i + 1
  )
)
SELECT ip, verdict, count(*) AS n FROM walk WHERE i > 0 GROUP BY ip, verdict"""


@query("session_admission", ADMISSION_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    # four users share an address, and of eight users two share a session from different addresses
    sid = "CASE WHEN (user_id + 1) % 8 < 2 THEN (user_id + 1) DIV 8 * 8 ELSE user_id END"
    rows = table(spark, d, "events").selectExpr("concat('10.0.', user_id DIV 4 DIV 256 % 256, '.', user_id DIV 4 % 256) AS ip", f"CAST({sid} AS STRING) AS sid", "ts", "CASE event_type WHEN 'purchase' THEN 'close' ELSE 'open' END AS kind")
    marked = ip.allowlisted(rows, ["10.0.0.0/32"])
    return sessions.admitted(marked, per_ip=3).groupBy("ip", "verdict").agg(F.count("*").alias("n"))


@query(
    "startup_plan",
    """WITH s AS (SELECT source, max(doc_id) AS token, min(doc_id) AS old, count(*) AS n FROM documents GROUP BY 1)
    SELECT source AS source_key, CASE WHEN n % 3 = 0 THEN 'full' WHEN n % 5 = 0 THEN 'full' WHEN n % 3 = 1 THEN 'incremental' ELSE CASE WHEN token = old THEN 'none' ELSE 'incremental' END END AS action FROM s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").cast("string").alias("token"), F.min("doc_id").cast("string").alias("old"), F.count("*").alias("n"))
    sources = by.select(F.lit("code").alias("source_type"), F.col("source").alias("source_key"), (F.col("n") % 3 == 1).alias("local"), F.col("token").alias("current_token"))
    states = by.where("n % 3 != 0").select(F.lit("code").alias("source_type"), F.col("source").alias("source_key"), F.when(F.col("n") % 5 != 0, F.col("old")).alias("last_commit_sha"), F.lit("idle").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("last_indexed_at"))
    return schedule.startup_actions(sources, states, "2024-01-02 12:00:00").select("source_key", "action")


@query("thread_participants", "SELECT thread, string_agg(role, ',' ORDER BY first) AS participants FROM (SELECT conv_id AS thread, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return conversations.participants(views.threads(spark, d)).select("thread", F.array_join("participants", ",").alias("participants"))


@query("source_snapshot", """WITH l AS (SELECT source, concat(doc_id, ':', n_chars, chr(10)) AS line FROM documents),
    p AS (SELECT source, substr(md5(line), 1, 3) AS part, count(*) AS n, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM l GROUP BY 1, 2)
    SELECT source AS path, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(concat(part, ':', digest, chr(10)), '' ORDER BY part)) AS token FROM p GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.col("source").alias("path"), F.concat("doc_id", F.lit(":"), "n_chars", F.lit("\n")).alias("line"))
    return files.digests(lines, "path").withColumnRenamed("digest", "token")


@query("inverted_index", f"{CHUNKS_SQL} SELECT term, count(DISTINCT id) AS chunks, count(*) AS occurrences FROM (SELECT id, unnest({TOKENS}) AS term FROM chunks) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return search.postings(docs).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"))


@query("faq_text", f"{FAQ_SQL} SELECT source_name, title, {ANSWER_SQL} AS answer_md5 FROM faq WHERE source_name IN ('faq2', 'faq0')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return render.faq_text(faq_chunks(spark, d), ["faq2", "faq0"]).select("source_name", "title", F.md5("answer").alias("answer_md5"))


@query("index_file_tree", f"{CHUNKS_SQL} SELECT path, CAST(sum(strlen(content)) AS BIGINT) AS size, count(*) AS chunks FROM (SELECT concat('/', source_name, '/', file_path) AS path, content FROM chunks) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = views.chunks(spark, d).select(search.virtual_path().alias("path"), F.octet_length("content").alias("size"))
    return rows.groupBy("path").agg(F.sum("size").alias("size"), F.count("*").alias("chunks"))


@query("site_source_type", "SELECT CASE WHEN avg(CASE WHEN regexp_matches(lower(url), '\\.mdx?$') THEN 1.0 ELSE 0 END) > 0.5 THEN 'markdown' ELSE 'html' END AS type FROM pages WHERE url IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return crawl.source_type(table(spark, d, "pages").where("url IS NOT NULL"))
