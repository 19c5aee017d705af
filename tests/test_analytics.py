import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import analytics as a
from quarry.schemas import QUERY_LOG

DAY = dt.datetime(2024, 3, 10, 12)


def log(spark, rows):
    base = {"tool_name": "search-docs", "query_text": "q", "result_count": 1, "top_score": 0.5, "latency_ms": 10, "source_name": "docs", "session_id": None, "created_at": DAY}
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in QUERY_LOG.split(", ")) for r in rows], QUERY_LOG)


def period(**k):
    return a.Period(today=DAY.date(), **k)


@pytest.mark.parametrize("values, want", [([7], 7), ([5] * 9, 5), ([1, 9], 9), (range(1, 101), 96), (range(1, 21), 20), ([], 0)])
def test_p95_is_nearest_rank(spark, values, want):
    got = a.summary(log(spark, [{"latency_ms": v} for v in values]), period()).first()
    assert got.p95_latency_ms == want and got.window_total == len(list(values))


def test_what_counts_where(spark):
    rows = log(spark, [{}, {"latency_ms": -1}, {"query_text": a.REDACTED}, {"result_count": 0, "top_score": None, "latency_ms": 13}, {"created_at": DAY - dt.timedelta(days=40)}, {"source_name": None, "tool_name": "search"}])
    got = a.summary(rows, period()).first()
    assert (got.all_time_total, got.window_total, got.empty_count, got.avg_latency_ms, got.p95_sampled) == (6, 3, 1, 11, False)
    assert got.empty_rate == pytest.approx(1 / 3, abs=1e-6)
    assert {tuple(r) for r in a.by_source(rows, period()).collect()} == {("docs", 3)}
    assert a.tool_counts(rows, period()).first().n == 4
    assert a.summary(a.filtered(rows, "search"), period()).first().all_time_total == 5
    assert a.earliest_day(rows).first()[0] == "2024-01-30"


def test_empty_log(spark):
    got = a.summary(log(spark, [{}]).where(F.lit(False)), period()).first()
    assert (got.all_time_total, got.window_total, got.empty_rate, got.avg_latency_ms, got.p95_latency_ms) == (0, 0, 0.0, 0, 0)


def test_average_rounds_half_up(spark):
    assert a.summary(log(spark, [{"latency_ms": 2}, {"latency_ms": 3}]), period()).first().avg_latency_ms == 3


def test_days_without_queries_are_there(spark):
    rows = log(spark, [{"created_at": DAY - dt.timedelta(days=d)} for d in (0, 2, 2, 13, 20)])
    got = [tuple(r) for r in a.per_day(rows, period(days=14)).collect()]
    assert len(got) == 14 and got[0] == ("2024-02-26", 1) and got[-1] == ("2024-03-10", 1) and sum(n for _, n in got) == a.summary(rows, period(days=14)).first().window_total == 4


def test_rolling_window_is_capped(spark):
    assert a.per_day(log(spark, [{}]), period(days=1000)).count() == a.ROLLING_CAP_DAYS


def test_late_row_belongs_to_its_utc_day(spark):
    rows = log(spark, [{"created_at": dt.datetime(2024, 3, 9, 23, 59, 59, 500000)}, {"created_at": dt.datetime(2024, 3, 9, 23, 59, 59, 999500)}])
    p = a.period_of({"from": "2024-03-08", "to": "2024-03-09"}, DAY.date())
    assert [tuple(r) for r in a.per_day(rows, p).collect()] == [("2024-03-08", 0), ("2024-03-09", 1)]


@pytest.mark.parametrize("params", [{"from": "2024-01-01"}, {"from": "2024-02-30", "to": "2024-03-01"}, {"from": "2024-03-02", "to": "2024-03-01"}, {"from": "1.1.2024", "to": "2.1.2024"}, {"days": "0"}, {"days": "7x"}, {"days": "100001"}, {"from": "1500-01-01", "to": "2024-01-01"}])
def test_parameters_that_are_refused(params):
    with pytest.raises(ValueError):
        a.period_of(params, DAY.date())


def test_retention(spark):
    rows = log(spark, [{"created_at": DAY - dt.timedelta(days=d)} for d in (0, 89, 90, 91)])
    assert a.retained(rows, DAY).count() == 2
    for days in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            a.retained(rows, DAY, days)


def test_redaction(spark):
    assert {r.query_text for r in a.redacted(log(spark, [{}, {"query_text": "x"}]), False).collect()} == {a.REDACTED}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(-1, 99), st.sampled_from(["q", a.REDACTED])), min_size=1, max_size=30))
def test_bars_sum_to_the_total(spark, rows):
    df = log(spark, [{"created_at": DAY - dt.timedelta(days=d), "latency_ms": ms, "query_text": q} for d, ms, q in rows])
    p = period(days=8)
    assert a.per_day(df, p).agg(F.sum("n")).first()[0] == a.summary(df, p).first().window_total


def test_latency_sample(spark):
    rows = log(spark, [{"latency_ms": v} for v in range(30)] + [{"latency_ms": -1}])
    assert a.latency_sample(rows, period(), 10).count() == 10 and a.latency_sample(rows, period()).count() == 30
