"""Append-only ingestion of log rows and tool events with Structured Streaming."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.analytics import redacted

TELEMETRY = "_telemetry"
#: Events in one row of collected data.
MOST_EVENTS = 10_000


def log_stream(spark: SparkSession, folder: str, schema: str, keep_text: bool = True) -> DataFrame:
    """Rows of JSON files as they arrive in a folder, without query texts unless these may be kept."""
    return redacted(spark.readStream.schema(schema).json(folder), keep_text)


def append(stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def telemetry_stats(events: DataFrame) -> DataFrame:
    """One row: all events, file accesses and searches without result."""
    return events.agg(F.count("*").alias("totalCommands"), F.count_if(F.col("type") == "file_access").alias("fileAccesses"), F.count_if(F.col("type") == "grep_miss").alias("grepMisses"))


def flush(events: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Write the events of each micro-batch as rows of collected data, about MOST_EVENTS to a row. A batch that fails is tried again by Spark."""
    def write(batch: DataFrame, number: int) -> None:
        columns, rows = batch.columns, -(-batch.count() // MOST_EVENTS)
        if rows:
            parts = batch.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rows)))
            row = parts.groupBy("_part").agg(F.to_json(F.struct(F.collect_list(F.struct(*columns)).alias("events"))).alias("data"))
            row.select(F.lit(TELEMETRY).alias("tool_name"), "data", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def flush_bounded(events: DataFrame, folder: str, checkpoint: str, write: Callable[[DataFrame, int], None], when: str = "timestamp", most: int = MOST_EVENTS, **trigger: object) -> StreamingQuery:
    """Hand the events of each trigger to write(rows, number of the batch), those first that earlier writes failed on. At most so many are held; beyond, the oldest go.

    What a failed write leaves is a table under folder, one for each batch, so a query that is started again goes on with it. write may see a batch again after a crash, under the same number.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_batch", F.lit(number).cast("long"))
        if number:
            rows = spark.read.schema(rows.schema).parquet(f"{folder}/held/{number - 1}").unionByName(rows)
        order = [F.desc("_batch"), F.desc(when), *(F.desc(c) for c in batch.columns if c != when)]
        kept = rows.orderBy(*order).limit(most)
        kept.write.mode("overwrite").parquet(f"{folder}/tried/{number}")
        kept = spark.read.schema(rows.schema).parquet(f"{folder}/tried/{number}")
        try:
            write(kept.orderBy("_batch", when).drop("_batch"), number)
            kept = kept.where(F.lit(False))
        except Exception as e:  # the sink's failure is not the stream's end: its rows come first next time
            logging.getLogger(__name__).warning("batch %s stays in the buffer: %s", number, e)
        kept.write.mode("overwrite").parquet(f"{folder}/held/{number}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
