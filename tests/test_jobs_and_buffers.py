"""The job queue, embedding calls, streamed admission, the bounded buffer, and addresses in ranges."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import ip
from quarry.plans import indexing, jobs
from quarry.streaming import ingest, sessions


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def queue(spark, *rows):
    return spark.createDataFrame([(j, s, "full", at(m)) for j, s, m in rows], jobs.JOBS)


def test_runnable(spark):
    q = queue(spark, ("j1", "a", 0), ("j2", "a", 1), ("j3", "b", 2), ("j4", "c", 3), ("j3", "b", 9))
    runs = lambda *rows: spark.createDataFrame([(j, at(m), e, None) for j, m, e in rows], jobs.RUNS)
    ready = lambda r, slots=9, now=60: [x.job_id for x in jobs.runnable(q, r, str(at(now)), slots, 3600).collect()]
    assert ready(runs()) == ["j1", "j3", "j4"] and ready(runs(), 1) == ["j1"]
    assert ready(runs(("j1", 10, "started"))) == ["j3", "j4"] and ready(runs(("j1", 10, "started")), 1) == []
    assert ready(runs(("j1", 10, "started"), ("j1", 10, "failed"))) == ["j2", "j3", "j4"]
    assert ready(runs(("j1", 10, "started")), now=71) == ["j1", "j3", "j4"]  # lost with its driver
    assert {r.job_id: (r.state, r.tries) for r in jobs.states(q, runs(("j3", 1, "started"), ("j3", 2, "done")), str(at(60))).collect()} == {"j1": ("waiting", 0), "j2": ("waiting", 0), "j3": ("done", 1), "j4": ("waiting", 0)}


def test_queue_goes_on_after_failures_and_restarts(spark, tmp_path):
    q, ran = queue(spark, ("j1", "a", 0), ("j2", "b", 1), ("j3", "a", 2)), []

    def work(job):
        ran.append(job["job_id"])
        if job["job_id"] == "j2":
            raise ValueError("no such source")
        return "ok"

    spark.createDataFrame([("j1", at(0), "started", None)], jobs.RUNS).write.parquet(f"{tmp_path}/runs")
    clock = iter(range(100, 1000))
    got = jobs.drained(spark, q, f"{tmp_path}/runs", work, lambda: str(at(next(clock))))
    assert {r.job_id: (r.state, r.tries) for r in got.collect()} == {"j1": ("done", 2), "j2": ("failed", 1), "j3": ("done", 1)} and ran == ["j1", "j2", "j3"]
    assert jobs.drained(spark, q, f"{tmp_path}/runs", work, lambda: str(at(next(clock)))).count() == 3 and len(ran) == 3


def test_embedding_calls_are_of_the_providers_size(spark):
    def provider():
        return lambda texts: [[float(len(texts)), float(len(t))] for t in texts]

    rows = spark.range(0, 150, 1, 1).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = rows.withColumn("e", indexing.embedded("t", provider, "local")).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[7].e.vector is None and got[7].e.error is None
    assert [r.e.vector for r in got if r.id != 7] == [[31.0 if r.id < 32 else 22.0 if r.id >= 128 else 32.0, float(r.id)] for r in got if r.id != 7]


def test_failed_texts_are_told_apart(spark):
    def provider():
        tries = []

        def embed(texts):
            tries.append(1)
            if len(tries) == 1:
                raise ConnectionError("busy")
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return [[1.0]] * len(texts)

        return embed

    def down():
        def embed(texts):
            raise TimeoutError("down")

        return embed

    rows = spark.createDataFrame([(i, "bad" if i in (3, 8) else "good") for i in range(10)], "id long, t string").coalesce(1)
    got = rows.withColumn("embedded", indexing.embedded("t", provider, "local", pause=0.0))
    assert sorted((r.id, r.error) for r in indexing.failures(got).collect()) == [(3, "ValueError: refused"), (8, "ValueError: refused")]
    got = rows.withColumn("embedded", indexing.embedded("t", down, "local", retries=2, pause=0.0)).select("embedded.*").distinct().collect()
    assert [(r.vector, r.error, r.attempts) for r in got] == [(None, "TimeoutError: down", 2)]
    with pytest.raises(Exception, match="refused"):
        rows.select(indexing.embedding(F.col("t"), provider)).collect()


def session_events(n, seed=1):
    rng = random.Random(seed)
    return [("one", f"ip{rng.randrange(3)}", f"s{rng.randrange(12)}", at(0) + dt.timedelta(seconds=i), rng.choice(["open", "open", "close"]), rng.random() < 0.1) for i in range(n)]


EVENTS = "server string, ip string, sid string, ts timestamp, kind string, allowed boolean"


def streamed(spark, folder, parts, most=10**6):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", most).parquet(f"{folder}/in").withWatermark("ts", "0 seconds")
    query = sessions.admitted_stream(events, per_ip=3).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table("admitted").select("ts", "sid", "ip", "kind", "verdict").collect())


def test_streamed_admission_equals_the_batch(spark, tmp_path):
    rows = session_events(300)
    want = sorted(tuple(r) for r in sessions.admitted(spark.createDataFrame(rows, EVENTS), per_ip=3).select("ts", "sid", "ip", "kind", "verdict").collect())
    assert {v for *_, v in want} == {"open", "again", "bypass", "closed", "rate-limit", "sid-collision"}
    assert streamed(spark, tmp_path, [rows[:120], rows[120:]]) == want


def test_idle_sessions_end(spark, tmp_path):
    opened = [("one", "a", f"s{i}", at(i), "open", False) for i in range(3)]
    later = [("one", "a", "s9", at(20), "open", False), ("one", "b", "s1", at(31.5), "open", False), ("one", "b", "s2", at(31.6), "open", False), ("one", "a", "s8", at(33), "open", False)]
    got = {sid: v for ts, sid, ip, _, v in streamed(spark, tmp_path, [opened + later]) if ts >= at(20)}
    assert got == {"s9": "rate-limit", "s1": "open", "s2": "sid-collision", "s8": "open"}


def test_bounded_buffer(spark, tmp_path):
    calls = []

    def write(rows, number):
        calls.append([r.n for r in rows.collect()])
        if len(calls) in (1, 2):
            raise OSError("sink is down")

    for first in (0, 4, 8, 12):
        spark.createDataFrame([(first + i, at(first + i)) for i in range(4)], "n long, timestamp timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema("n long, timestamp timestamp").parquet(f"{tmp_path}/in")
        ingest.flush_bounded(events, f"{tmp_path}/buffer", f"{tmp_path}/at", write, most=6).awaitTermination(60)
    assert calls == [[0, 1, 2, 3], [2, 3, 4, 5, 6, 7], [6, 7, 8, 9, 10, 11], [12, 13, 14, 15]]


def test_addresses_in_ranges(spark):
    rng = random.Random(3)
    ranges = [f"10.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.choice([8, 15, 16, 22, 24, 31, 32])}" for _ in range(60)] + ["2001:db8::/32", "2001:db8:0:1::/64", "::ffff:192.0.2.0/120", "0.0.0.0/0", "bad", None, "10.0.0.0/8", "10.0.0.0/8"]
    addresses = [f"10.{rng.randrange(5)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(200)] + ["2001:db8::1", "2001:db8:0:1::5", "2001:db9::1", "::ffff:192.0.2.7", "192.0.2.9", "no", "", None] + ["10.1.1.1"] * 50

    def brute(a):
        found = ip.normal(a)
        if not found:
            return None
        nets = []
        for c in ranges:
            try:
                version, low, high = ip.bounds(c)
            except (ValueError, AttributeError):
                continue
            if version == ipaddress.ip_address(found).version and int(low, 16) <= int(ipaddress.ip_address(found)) <= int(high, 16):
                nets.append((int(high, 16) - int(low, 16), c))
        return min(nets)[1] if nets else None

    rows = spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "n long, ip string")
    found = ip.in_ranges(rows, spark.createDataFrame([(c,) for c in ranges], "cidr string"))
    assert [r.matched for r in found.orderBy("n").collect()] == [brute(a) for a in addresses]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert {r.matched for r in ip.in_ranges(rows, spark.createDataFrame([], "cidr string")).collect()} == {None}
