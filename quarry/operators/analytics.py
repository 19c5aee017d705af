"""Analytics of the query log: totals, rates, latencies, day series, rankings and retention.

Rows with negative latency are backfilled and count in no window; redacted query texts count for sources and tools
only. Windows are two timestamps, both included, or a number of days up to and including today, at most
ROLLING_CAP_DAYS, without an upper bound. All functions take the log as a DataFrame and today as a date.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the log's contract.
REDACTED = "<redacted>"
P95_ROW_CAP = 100_000
ROLLING_CAP_DAYS = 366
MAX_DAYS = 100_000
MAX_LIMIT = 200
RETENTION_DAYS = 90


@dataclass(frozen=True)
class Period:
    """From start to end, or the last days up to today."""

    start: dt.datetime | None = None
    end: dt.datetime | None = None
    days: int = 7
    today: dt.date | None = None

    @property
    def explicit(self) -> bool:
        return self.start is not None and self.end is not None

    def first_day(self) -> dt.date:
        return self.start.date() if self.explicit else self.today - dt.timedelta(days=min(self.days, ROLLING_CAP_DAYS) - 1)

    def last_day(self) -> dt.date:
        return self.end.date() if self.explicit else self.today

    def holds(self, when: str = "created_at") -> Column:
        ntz = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
        if self.explicit:
            return F.col(when).between(ntz(self.start), ntz(self.end))
        return F.col(when) >= ntz(dt.datetime.combine(self.first_day(), dt.time()))


def period_of(params: dict[str, str], today: dt.date) -> Period:
    """A period from request parameters from, to and days; ValueError for what is not allowed."""
    low, high, days = params.get("from"), params.get("to"), params.get("days")
    if (low is None) != (high is None):
        raise ValueError("from and to go together")
    if low is not None:
        if not all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) for x in (low, high)):
            raise ValueError("dates are YYYY-MM-DD")
        start, end = dt.date.fromisoformat(low), dt.date.fromisoformat(high)
        if start > end:
            raise ValueError("from lies after to")
        if (end - start).days + 1 > MAX_DAYS:
            raise ValueError(f"a range holds {MAX_DAYS} days at most")
        return Period(dt.datetime.combine(start, dt.time()), dt.datetime.combine(end, dt.time(23, 59, 59, 999000)), today=today)
    return Period(days=whole_number(days, 7, MAX_DAYS, "days"), today=today)


def whole_number(text: str | None, default: int, most: int, name: str) -> int:
    """A positive whole number of at most most; digits only."""
    if text is None:
        return default
    if not re.fullmatch(r"\d+", text) or not 1 <= int(text) <= most:
        raise ValueError(f"{name} is a whole number from 1 to {most}")
    return int(text)


def filtered(log: DataFrame, tool_type: str | None = None, source: str | None = None) -> DataFrame:
    """Rows of tools whose name begins with the type and a hyphen, and of the source; None leaves a filter out."""
    if tool_type:
        log = log.where(F.col("tool_name").startswith(f"{tool_type}-"))
    return log.where(F.col("source_name") == source) if source else log


def _live() -> Column:
    return F.col("latency_ms") >= 0


def _told() -> Column:
    return F.col("query_text") != REDACTED


def summary(log: DataFrame, period: Period) -> DataFrame:
    """One row: all_time_total, window_total, empty_count, empty_rate, avg_latency_ms, p95_latency_ms, p95_sampled.

    One pass: latencies are whole numbers, so the log is first counted by latency, and the nearest-rank percentile is
    read from running sums over the few distinct values instead of a sort of the log.
    """
    inside = _live() & _told() & period.holds()
    counts = log.select(F.when(inside, F.col("latency_ms")).alias("latency"), (F.col("result_count") == 0).alias("empty"))
    counts = counts.groupBy("latency").agg(F.count("*").alias("n"), F.count_if("empty").alias("n_empty"))
    known = F.col("latency").isNotNull()
    running = F.sum(F.when(known, F.col("n"))).over(Window.orderBy(F.col("latency").asc_nulls_first()))
    total = F.sum(F.when(known, F.col("n"))).over(Window.partitionBy())
    ranked = counts.withColumn("running", running).withColumn("total", total)
    target = F.least(F.floor(F.col("total") * 0.95), F.col("total") - 1)
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_time_total"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("window_total"),
        F.coalesce(F.sum(F.when(known, F.col("n_empty"))), F.lit(0)).alias("empty_count"),
        F.round(F.coalesce(F.sum(F.when(known, F.col("n_empty"))) / F.sum(F.when(known, F.col("n"))), F.lit(0.0)), 6).alias("empty_rate"),
        F.coalesce(F.round(F.sum(F.when(known, F.col("latency") * F.col("n"))) / F.sum(F.when(known, F.col("n")))), F.lit(0)).cast("long").alias("avg_latency_ms"),
        F.coalesce(F.min(F.when(known & (F.col("running") > target), F.col("latency"))), F.lit(0)).alias("p95_latency_ms"),
        F.coalesce(F.sum(F.when(known, F.col("n"))) > P95_ROW_CAP, F.lit(False)).alias("p95_sampled"),
    )


def by_source(log: DataFrame, period: Period) -> DataFrame:
    rows = log.where(_live() & period.holds() & F.col("source_name").isNotNull())
    return rows.groupBy("source_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_name")


def per_day(log: DataFrame, period: Period) -> DataFrame:
    """A row for each day of the period, also those without queries."""
    spark = log.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(period.first_day()), F.lit(period.last_day()))).alias("day"))
    counts = log.where(_live() & _told() & period.holds()).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("day")


def earliest_day(log: DataFrame) -> DataFrame:
    """The first day of the whole log, whatever the filters; null if it is empty."""
    return log.agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("earliest_day"))


def top_queries(log: DataFrame, period: Period, limit: int = 50) -> DataFrame:
    rows = log.where(_live() & _told() & period.holds()).groupBy("query_text", "tool_name")
    found = rows.agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("result_count") >= 0, F.col("result_count"))), 6).alias("avg_results"), F.round(F.avg("top_score"), 6).alias("avg_top_score"), F.bool_or(F.col("result_count") > 0).alias("any")
    )
    return found.where("any").drop("any").orderBy(F.desc("n"), "query_text", "tool_name").limit(limit)


def empty_queries(log: DataFrame, period: Period, limit: int = 50) -> DataFrame:
    rows = log.where(_live() & _told() & period.holds() & (F.col("result_count") == 0)).groupBy("query_text", "tool_name", "source_name")
    found = rows.agg(F.count("*").alias("n"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    return found.orderBy(F.desc("n"), "query_text", "tool_name", F.asc_nulls_last("source_name")).limit(limit)


def tool_counts(log: DataFrame, period: Period) -> DataFrame:
    """Queries by the part of the tool's name before its first hyphen."""
    rows = log.where(_live() & period.holds())
    return rows.groupBy(F.split_part("tool_name", F.lit("-"), F.lit(1)).alias("tool_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool_type")


def retained(log: DataFrame, now: dt.datetime, days: float = RETENTION_DAYS) -> DataFrame:
    """The log without rows of days ago and before."""
    if not math.isfinite(days) or days <= 0:
        raise ValueError("days must be a positive number")
    return log.where(F.col("created_at") > F.lit((now - dt.timedelta(days=days)).isoformat(sep=" ")).cast("timestamp_ntz"))


def redacted(rows: DataFrame, keep_text: bool) -> DataFrame:
    """Rows for the log, without their texts unless these may be kept."""
    return rows if keep_text else rows.withColumn("query_text", F.lit(REDACTED))


def latency_sample(log: DataFrame, period: Period, most: int = P95_ROW_CAP, seed: int = 0) -> DataFrame:
    """Latencies of a window, all of them or a random sample of the given size, for histograms."""
    rows = log.where(_live() & _told() & period.holds()).select("latency_ms")
    return rows.orderBy(F.rand(seed)).limit(most)
