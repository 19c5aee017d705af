"""What to index when: a plan of actions as a table, from sources, their states and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stale(now: str, hours: float = 24) -> Column:
    """Whether a state was never indexed, failed, or is older than so many hours."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_indexed_at").cast("timestamp"))
    return F.col("last_indexed_at").isNull() | (F.col("status") == "error") | (age > hours * 3_600_000_000)


def startup_actions(sources: DataFrame, states: DataFrame, now: str, hours: float = 24) -> DataFrame:
    """An action for each source (source_type, source_key, local, current_token; current_token null where the check failed, empty where the source is not there): full, incremental or none.

    Sources without state, or with a state that failed or has no token, are read in full, local ones always incrementally; others if their token
    changed, and if that can't be told, if they are stale. If all would be read in full, they are marked as one run.
    """
    rows = sources.join(states, ["source_type", "source_key"], "left")
    action = (
        F.when(F.col("status").isNull() | (F.col("status") == "error") | (F.coalesce("last_commit_sha", F.lit("")) == ""), "full")
        .when(F.col("local"), "incremental")
        .when(F.col("current_token").isNotNull(), F.when(F.col("current_token").eqNullSafe(F.col("last_commit_sha")), "none").otherwise("incremental"))
        .otherwise(F.when(stale(now, hours), "incremental").otherwise("none"))
    )
    rows = rows.select("source_type", "source_key", action.alias("action"))
    total = rows.agg((F.count_if(F.col("action") != "full") == 0).alias("one_run"))
    return rows.join(F.broadcast(total))


def nightly_due(now: Column, last_run: Column, hour: int, running: Column) -> Column:
    """Whether the nightly run is due: once for each UTC date, at the hour, unless one is running."""
    return (F.hour(now) == hour) & (last_run.isNull() | (F.to_date(last_run) < F.to_date(now))) & ~running


def push_triggers(pushes: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources that pushes (repository, ref, default_branch, paths) make read again: those of the repository, if the push is to its default branch and touches a path that
    begins with one of the source's prefixes (no prefixes: any)."""
    on = pushes.where(F.col("ref") == F.concat(F.lit("refs/heads/"), "default_branch"))
    hit = F.exists("paths", lambda p: F.exists("prefixes", lambda x: p.startswith(x)))
    return on.join(sources, "repository").where((F.size(F.coalesce("prefixes", F.array())) == 0) | hit).select("source_type", "source_key", "repository").distinct()


def reaction_triggers(reactions: DataFrame, sources: DataFrame) -> DataFrame:
    """Chat sources whose channel got the reaction that they wait for."""
    return reactions.join(sources, (reactions["emoji"] == sources["trigger_emoji"]) & F.array_contains(sources["channels"], reactions["channel"])).select("source_type", "source_key").distinct()


def queued(jobs: DataFrame) -> DataFrame:
    """The jobs (source_key, queued_at) to run, first come first served, one for each source."""
    return jobs.groupBy("source_key").agg(F.min("queued_at").alias("queued_at")).orderBy("queued_at", "source_key")
