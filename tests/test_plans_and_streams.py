import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.catalogue import QUERIES
from quarry.operators.chunking import Sizes
from quarry.plans import indexing, schedule
from quarry.schemas import CHUNKS, INDEX_STATE, QUERY_LOG
from quarry.streaming import ingest, ratelimit, sessions


def items(spark, *rows):
    return spark.createDataFrame([(i, c, None, None, "{}") for i, c in rows], "id string, content string, title string, source_url string, metadata string")


def test_indexing_replaces_what_was_read(spark):
    empty = spark.createDataFrame([], CHUNKS)
    rows = lambda x: indexing.chunk_rows(x, "docs", "raw-text", indexing.hashed_embedder, Sizes(target_tokens=2), token="c1")
    first = items(spark, ("a", "one one one\n\ntwo two two"), ("b", "bee"))
    table = indexing.indexed(empty, rows(first), first).persist()
    assert sorted((r.file_path, r.chunk_index) for r in table.collect()) == [("a", 0), ("a", 1), ("b", 0)]
    assert len(table.first().embedding) == 64 and {r.commit_sha for r in table.collect()} == {"c1"}
    second = items(spark, ("a", "short"), ("c", "new"))
    table = indexing.indexed(table, rows(second), second, spark.createDataFrame([("b",)], "id string"))
    assert sorted((r.file_path, r.content) for r in table.collect()) == [("a", "short"), ("c", "new")]


def test_metadata_and_urls(spark):
    x = spark.createDataFrame([("a.md", "# Top\n\n## Sub\nwords " * 4, None, None, '{"headingPath": "own", "k": "v"}'), ("b.md", "text", "Item title", "http://own", None)], items(spark).schema)
    got = {r.file_path: r for r in indexing.chunk_rows(x, "docs", "markdown", indexing.hashed_embedder, base=F.concat(F.lit("http://base/"), "id")).collect()}
    assert got["a.md"].source_url == "http://base/a.md" and '"headingPath":"own"' in got["a.md"].metadata and got["b.md"].source_url == "http://own"


def test_states_of_a_run(spark):
    states = spark.createDataFrame([], INDEX_STATE)
    states = indexing.run_source(spark, states, "code", "k", lambda: "sha1").persist()
    assert [(r.status, r.last_commit_sha) for r in states.collect()] == [("idle", "sha1")]

    def fails():
        raise OSError("no network")

    got = indexing.run_source(spark, states, "code", "k", fails).first()
    assert (got.status, got.last_commit_sha, got.error_message) == ("error", "sha1", "no network")


def test_startup_plan(spark):
    sources = spark.createDataFrame([("code", "new", False, "s"), ("code", "failed", False, "s"), ("code", "local", True, None), ("code", "same", False, "s"), ("code", "moved", False, "t"), ("code", "old", False, None), ("code", "fresh", False, None)], "source_type string, source_key string, local boolean, current_token string")
    at = lambda h: dt.datetime(2024, 1, 2, h)
    states = spark.createDataFrame([("code", k, "s", t, s, None) for k, t, s in (("failed", at(5), "error"), ("local", at(5), "idle"), ("same", at(5), "idle"), ("moved", at(5), "idle"), ("old", dt.datetime(2024, 1, 1), "idle"), ("fresh", at(5), "idle"))], INDEX_STATE)
    got = {r.source_key: (r.action, r.one_run) for r in schedule.startup_actions(sources, states, "2024-01-02 12:00:00").collect()}
    assert got == {k: (v, False) for k, v in {"new": "full", "failed": "full", "local": "incremental", "same": "none", "moved": "incremental", "old": "incremental", "fresh": "none"}.items()}
    assert schedule.startup_actions(sources.where("source_key = 'new'"), states, "2024-01-02").first().one_run


def test_triggers(spark):
    pushes = spark.createDataFrame([("r", "refs/heads/main", "main", ["docs/a"]), ("r", "refs/heads/dev", "main", ["src/a"])], "repository string, ref string, default_branch string, paths array<string>")
    sources = spark.createDataFrame([("t", "docs", "r", ["docs/"]), ("t", "src", "r", ["src/"]), ("t", "all", "r", []), ("t", "other", "q", [])], "source_type string, source_key string, repository string, prefixes array<string>")
    assert {r.source_key for r in schedule.push_triggers(pushes, sources).collect()} == {"docs", "all"}
    chats = spark.createDataFrame([("slack", "s", "books", ["c1"])], "source_type string, source_key string, trigger_emoji string, channels array<string>")
    assert schedule.reaction_triggers(spark.createDataFrame([("books", "c1"), ("books", "c2")], "emoji string, channel string"), chats).count() == 1
    jobs = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "source_key string, queued_at int")
    assert [r.source_key for r in schedule.queued(jobs).collect()] == ["b", "a"]


def test_nightly(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 1, 3), False), (dt.datetime(2024, 1, 2, 3), dt.datetime(2024, 1, 2, 3), False), (dt.datetime(2024, 1, 2, 4), None, False), (dt.datetime(2024, 1, 2, 3), None, True), (dt.datetime(2024, 1, 2, 3), None, False)], "now timestamp_ntz, last timestamp_ntz, running boolean")
    assert [r[0] for r in rows.select(schedule.nightly_due(F.col("now"), F.col("last"), 3, F.col("running"))).collect()] == [True, False, False, False, True]


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_rate_limit_windows_begin_with_the_first_request(spark):
    rows = spark.createDataFrame([("a", at(s)) for s in (5, 10, 20, 64, 65, 66)] + [("b", at(64))], "key string, ts timestamp")
    got = [(r.key, r.admitted, r.retry_after) for r in ratelimit.limited(rows, 2).orderBy("key", "ts").collect()]
    assert got == [("a", True, 0), ("a", True, 0), ("a", False, 45), ("a", False, 1), ("a", True, 0), ("a", True, 0), ("b", True, 0)]


def test_rate_limit_stream(spark, tmp_path):
    rows = [("a", i, at(s)) for i, s in enumerate((5, 10, 20, 65))]
    for n in (2, 4):
        spark.createDataFrame(rows[n - 2 : n], "key string, id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ratelimit.limited_stream(spark.readStream.schema("key string, id long, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute"), 2)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.id, r.admitted) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(0, True), (1, True), (2, False), (3, True)}


def test_sessions_end_after_a_pause(spark):
    rows = spark.createDataFrame([(1, at(s)) for s in (0, 1800, 3601)] + [(2, at(0))], "user_id long, ts timestamp")
    assert sorted((r.user_id, r.n_events) for r in sessions.expired(rows).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_reaper(spark):
    rows = spark.createDataFrame([("a", at(0), True), ("b", at(0), False), ("c", at(1000), False)], "sid string, last_seen timestamp, used boolean")
    assert {r.sid for r in sessions.reaped(rows, "2024-01-01 00:20:00").collect()} == {"b"}
    assert {r.sid for r in sessions.reaped(rows, "2024-01-01 00:30:01").collect()} == {"a", "b"}


def test_admission(spark):
    rows = [("1", "a", 0, "open", False), ("1", "a", 1, "open", False), ("1", "b", 2, "open", False), ("1", "c", 3, "open", False), ("1", "a", 4, "close", False), ("1", "d", 5, "open", False), ("2", "b", 6, "open", False), ("3", "e", 7, "open", True)]
    df = spark.createDataFrame([(i, s, at(t), k, a) for i, s, t, k, a in rows], "ip string, sid string, ts timestamp, kind string, allowed boolean")
    assert [r.verdict for r in sessions.admitted(df, 2).orderBy("ts").collect()] == ["open", "again", "open", "rate-limit", "closed", "open", "sid-collision", "bypass"]
    assert tuple(sessions.capacity(df, 10).first()) == (8, False, True)


def brute_admission(events, per_ip):
    """One limiter that sees all events in their order."""
    owner, held, out = {}, {}, []
    for ip, sid, ts, kind, allowed in sorted(events, key=lambda e: (e[2], e[1], e[0], e[3])):
        if kind == "close":
            verdict = "closed"
            if sid in owner:
                held[owner.pop(sid)].discard(sid)
        elif allowed:
            verdict = "bypass"
        elif sid in owner:
            verdict = "again" if owner[sid] == ip else "sid-collision"
        elif len(held.setdefault(ip, set())) >= per_ip:
            verdict = "rate-limit"
        else:
            owner[sid], verdict = ip, "open"
            held[ip].add(sid)
        out.append((ip, sid, ts, kind, verdict))
    return sorted(out)


def test_admission_with_collisions_closes_and_ties(spark):
    rnd = random.Random(3)
    events = []
    for _ in range(3000):
        # addresses are linked in chains of different lengths, and one session is opened from anywhere
        ip = rnd.randrange(60)
        sid = rnd.choice([f"s{ip}", f"s{ip}", f"s{ip + rnd.randrange(2)}", f"t{rnd.randrange(9)}-{ip % 3}", "u"]) if ip % 10 else f"own{ip}-{rnd.randrange(8)}"
        events.append((f"10.0.0.{ip}", sid, at(rnd.randrange(600)), "close" if rnd.random() < 0.25 else "open", ip in (4, 20)))
    df = spark.createDataFrame(events, "ip string, sid string, ts timestamp, kind string, allowed boolean")
    got = sorted((r.ip, r.sid, r.ts, r.kind, r.verdict) for r in sessions.admitted(df, 2).collect())
    assert got == brute_admission(events, 2)
    assert {r[-1] for r in got} == {"open", "again", "bypass", "closed", "rate-limit", "sid-collision"}


def test_admission_edges(spark):
    schema = "ip string, sid string, ts timestamp, kind string, allowed boolean"
    verdicts = lambda rows: [r.verdict for r in sessions.admitted(spark.createDataFrame([(i, s, at(t), k, a) for i, s, t, k, a in rows], schema), 1).orderBy("ts").collect()]
    assert sessions.admitted(spark.createDataFrame([], schema)).count() == 0
    # a close frees the session for another address; an allowed open owns nothing; a refused one neither
    assert verdicts([("1", "a", 0, "open", False), ("2", "a", 1, "open", False), ("2", "a", 2, "close", False), ("2", "a", 3, "open", False)]) == ["open", "sid-collision", "closed", "open"]
    assert verdicts([("9", "a", 0, "open", True), ("1", "a", 1, "open", False), ("9", "a", 2, "open", True)]) == ["bypass", "open", "bypass"]
    assert verdicts([("1", "a", 0, "open", False), ("1", "b", 1, "open", False), ("2", "b", 2, "open", False)]) == ["open", "rate-limit", "open"]


def test_session_admission_query(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_type").collect()
    rows = []
    for r in events:
        address, sid = r.user_id // 4, (r.user_id + 1) // 8 * 8 if (r.user_id + 1) % 8 < 2 else r.user_id
        ip = f"10.0.{address // 256 % 256}.{address % 256}"
        rows.append((ip, str(sid), r.ts, "close" if r.event_type == "purchase" else "open", address < 1))
    want = collections.Counter((ip, verdict) for ip, _, _, _, verdict in brute_admission(rows, 3))
    got = {(r.ip, r.verdict): r.n for r in QUERIES["session_admission"](spark, sf).collect()}
    assert got == want and "sid-collision" in {v for _, v in got}


def test_startup_reads_sources_without_a_token_in_full(spark):
    sources = spark.createDataFrame([("code", "null", False, "s"), ("code", "empty", True, "s"), ("code", "gone", False, "")], "source_type string, source_key string, local boolean, current_token string")
    states = spark.createDataFrame([("code", "null", None, at(0), "idle", None), ("code", "empty", "", at(0), "idle", None), ("code", "gone", "s", at(0), "idle", None)], INDEX_STATE)
    assert {r.source_key: r.action for r in schedule.startup_actions(sources, states, "2024-01-01 01:00:00").collect()} == {"null": "full", "empty": "full", "gone": "incremental"}


def test_log_ingestion_and_telemetry(spark, tmp_path):
    source = f"{tmp_path}/log"
    spark.createDataFrame([("search-docs", "secret", 1, 0.5, 3, "docs", None, dt.datetime(2024, 1, 1))], QUERY_LOG).write.json(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.append(ingest.log_stream(spark, source, QUERY_LOG, keep_text=False), f"{tmp_path}/table", f"{tmp_path}/c1").awaitTermination(120)
    assert [r.query_text for r in spark.read.parquet(f"{tmp_path}/table").collect()] == ["<redacted>"]
    events = spark.createDataFrame([("command", "ls"), ("grep_miss", "x"), ("file_access", "y")], "type string, path string")
    assert tuple(ingest.telemetry_stats(events).first()) == (3, 1, 1)
    events.write.json(f"{tmp_path}/events")
    ingest.flush(spark.readStream.schema(events.schema).json(f"{tmp_path}/events"), f"{tmp_path}/collected", f"{tmp_path}/c2").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/collected").collect()
    assert len(got) == 1 and got[0].tool_name == ingest.TELEMETRY and got[0].data.count('"type"') == 3


def test_embedding_retries(spark):
    def provider():
        calls = []

        def embed(texts):
            calls.append(1)
            if len(calls) == 1:
                raise ConnectionError("once")
            return [[float(len(t))] for t in texts]

        return embed

    assert spark.createDataFrame([("abc",)], "t string").select(indexing.embedding(F.col("t"), provider)).first()[0] == [3.0]
    with pytest.raises(Exception, match="always"):
        def broken():
            def embed(texts):
                raise ConnectionError("always")

            return embed

        spark.createDataFrame([("abc",)], "t string").select(indexing.embedding(F.col("t"), broken, retries=1)).collect()
