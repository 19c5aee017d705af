"""Changes of the index tables. Each returns the new state as a DataFrame; replace() publishes it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schemas import CHUNK_KEY, STATE_KEY


def upserted(existing: DataFrame, new: DataFrame, key: list[str] = CHUNK_KEY) -> DataFrame:
    """existing, with the rows of new in the place of rows with their keys."""
    return existing.join(new.select(*key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def reindexed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing, with all chunks of the files in new replaced, so that files may shrink."""
    files = ["source_name", "file_path"]
    return existing.join(new.select(*files).distinct(), files, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def without_files(existing: DataFrame, gone: DataFrame) -> DataFrame:
    """existing without the files (source_name, file_path) of gone."""
    return existing.join(gone.select("source_name", "file_path"), ["source_name", "file_path"], "left_anti")


def without_source(existing: DataFrame, source: str) -> DataFrame:
    return existing.where(~F.col("source_name").eqNullSafe(F.lit(source)))


def state_upserted(states: DataFrame, changes: DataFrame) -> DataFrame:
    """Index states with the given changes. A change to 'indexing' keeps the old token; one to 'idle' clears the error."""
    old = states.select(*STATE_KEY, F.col("last_commit_sha").alias("_sha"), F.col("last_indexed_at").alias("_at"))
    new = changes.join(old, STATE_KEY, "left")
    new = new.withColumn("last_commit_sha", F.coalesce("last_commit_sha", "_sha")).withColumn("last_indexed_at", F.coalesce("last_indexed_at", "_at"))
    return upserted(states, new.withColumn("error_message", F.when(F.col("status") == "error", F.col("error_message"))), STATE_KEY)


def collected(rows: DataFrame, tool: str, fields: list[dict]) -> DataFrame:
    """Rows for the table of collected data: those that keep to the fields (name, type string, number or enum, values, required)."""
    ok = F.lit(True)
    for f in fields:
        c = F.col(f["name"])
        fits = c.try_cast("double").isNotNull() if f["type"] == "number" else c.isin(f["values"]) if f["type"] == "enum" else F.lit(True)
        ok = ok & (c.isNotNull() & fits if f.get("required", False) else c.isNull() | fits)
    data = F.to_json(F.struct(*[F.col(f["name"]).try_cast("double" if f["type"] == "number" else "string").alias(f["name"]) for f in fields]))
    return rows.where(ok).select(F.lit(tool).alias("tool_name"), data.alias("data"))


def json_metadata(heading_path: list[str], item: dict) -> str:
    """Metadata of a chunk: what the item says wins."""
    return json.dumps({"headingPath": heading_path, **item})


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by source in order, with totals over all sources."""
    by = chunks.groupBy("source_name").agg(F.count("*").alias("chunks"))
    total = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("repo_url").alias("repos"))
    return by.select("source_name", "chunks", F.lit(None).cast("long").alias("repos")).unionByName(total.select(F.lit("*").alias("source_name"), "chunks", "repos")).orderBy("source_name")


def item_ids(chunks: DataFrame, source: str | None = None) -> DataFrame:
    rows = chunks if source is None else chunks.where(F.col("source_name") == source)
    return rows.select("file_path").distinct()


def removed_ids(indexed: DataFrame, live: DataFrame) -> DataFrame:
    """Ids of indexed that live no longer holds."""
    return indexed.select("id").distinct().join(live.select("id"), "id", "left_anti")


def replace(df: DataFrame, path: str, partition: str = "source_name") -> None:
    """Publish a new state in the place of the partitions that it holds. df may not read path: write it elsewhere first."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
