"""The index tables as views of the driver's tables, so that every query has data that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log, from events."""
    events = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)))
    return events.selectExpr(
        "CASE event_type WHEN 'view' THEN 'search-docs' WHEN 'click' THEN 'search-code' WHEN 'error' THEN 'search-docs' WHEN 'purchase' THEN 'explore-docs' ELSE 'knowledge-faq' END AS tool_name",
        "CASE WHEN k % 10 = 9 THEN '<redacted>' ELSE concat('q', k) END AS query_text",
        "CASE WHEN event_type = 'error' THEN 0 ELSE k % 7 END AS result_count",
        "CASE WHEN event_type = 'error' OR k % 7 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 100 END AS top_score",
        "CASE WHEN user_id % 13 = 0 THEN -1 ELSE CAST(floor(value) AS INT) END AS latency_ms",
        "CASE WHEN k % 11 = 0 THEN NULL ELSE concat('src', k % 4) END AS source_name",
        "CAST(user_id AS STRING) AS session_id",
        "CAST(ts AS TIMESTAMP_NTZ) AS created_at",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table, from all documents and, where there are any, the embeddings with their numbers; up to sixteen documents of a source make a file."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    joined = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return joined.selectExpr(
        "doc_id AS id", "source AS source_name", "concat('https://docs.example.com/', source, '/', doc_id) AS source_url",
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('Title ', doc_id) END AS title", "text AS content", "embedding",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('https://git.example.com/', lang) END AS repo_url",
        "concat('docs/', doc_id DIV 16, '.md') AS file_path", "CAST(1 AS INT) AS start_line", "CAST(n_chars AS INT) AS end_line", "lang AS language", "CAST(doc_id % 16 AS INT) AS chunk_index",
        "concat('{\"confidence\": ', CAST((doc_id % 10) AS INT), '.5}') AS metadata",
        "timestampadd(MINUTE, CAST(doc_id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS indexed_at", "'0000000' AS commit_sha", "concat('v', doc_id % 2) AS version",
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of conversations: thread, position, author and text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("position"), F.col("role").alias("author"), F.col("text"))
