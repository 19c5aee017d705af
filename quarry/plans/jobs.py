"""The queue of indexing jobs as tables: jobs (job_id, source_key, kind, queued_at) and an append-only log of runs (job_id, at, event: started, done or failed).

One run at a time for each source, and at most ``slots`` in all, first come first served. A failed job does not hold up others. A run that was started
longer than a lease ago and has not ended counts as lost: its job is started again, so a queue goes on after its driver died.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOBS, RUNS = "job_id string, source_key string, kind string, queued_at timestamp", "job_id string, at timestamp, event string, note string"


def states(jobs: DataFrame, runs: DataFrame, now: str, lease: float = 3600.0) -> DataFrame:
    """jobs with state (waiting, running, lost, done or failed), by their last event, and tries. Repeated job_ids count once, as queued first."""
    first = jobs.withColumn("_k", F.row_number().over(Window.partitionBy("job_id").orderBy("queued_at", "source_key", "kind"))).where("_k = 1").drop("_k")
    order = F.struct("at", F.when(F.col("event") == "started", 0).otherwise(1))  # of equal times, an end comes last
    last = runs.groupBy("job_id").agg(F.max_by("event", order).alias("event"), F.max("at").alias("at"), F.count_if(F.col("event") == "started").alias("tries"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("at")
    running = F.when(age > F.lit(int(lease * 1_000_000)), "lost").otherwise("running")
    state = F.when(F.col("event").isNull(), "waiting").when(F.col("event") == "started", running).otherwise(F.col("event"))
    return first.join(last, "job_id", "left").select(*first.columns, state.alias("state"), F.coalesce("tries", F.lit(0).cast("long")).alias("tries"))


def runnable(jobs: DataFrame, runs: DataFrame, now: str, slots: int = 1, lease: float = 3600.0) -> DataFrame:
    """The jobs to start now: the first waiting or lost one of each source that has none running, in order, as many as there are free slots."""
    all_jobs = states(jobs, runs, now, lease)
    busy = all_jobs.where("state = 'running'")
    free = F.greatest(F.lit(0), F.lit(slots) - F.col("busy"))
    mine = F.row_number().over(Window.partitionBy("source_key").orderBy("queued_at", "job_id"))
    ready = all_jobs.where("state IN ('waiting', 'lost')").join(busy.select("source_key").distinct(), "source_key", "left_anti")
    # one row for each source that waits; of these no more than the slots are numbered
    heads = ready.withColumn("_mine", mine).where("_mine = 1").drop("_mine").orderBy("queued_at", "job_id").limit(slots)
    place = F.row_number().over(Window.orderBy("queued_at", "job_id"))
    return heads.withColumn("_place", place).join(F.broadcast(busy.agg(F.count("*").alias("busy")))).where(F.col("_place") <= free).select(*jobs.columns).orderBy("queued_at", "job_id")


def drained(spark: SparkSession, jobs: DataFrame, path: str, work: Callable[[dict], str], now: Callable[[], str], slots: int = 1, lease: float = 3600.0) -> DataFrame:
    """Run jobs until none can start, and return their states. work takes a job as a dict and returns a note; what it raises ends that job as failed. Starts and ends are
    appended to the log under path, which another driver may take up."""

    def log(job_id: str, event: str, note: str | None = None) -> None:
        row = spark.createDataFrame([(job_id, event, note)], "job_id string, event string, note string")
        row.select("job_id", F.lit(now()).cast("timestamp").alias("at"), "event", "note").coalesce(1).write.mode("append").parquet(path)

    spark.createDataFrame([], RUNS).write.mode("append").parquet(path)
    while True:
        ready = runnable(jobs, spark.read.schema(RUNS).parquet(path), now(), slots, lease).collect()
        if not ready:
            return states(jobs, spark.read.schema(RUNS).parquet(path), now(), lease)
        for job in ready:
            log(job.job_id, "started")
            try:
                log(job.job_id, "done", work(job.asDict()))
            except Exception as e:  # one job's failure is its state, not the queue's end
                log(job.job_id, "failed", str(e)[:1000])
