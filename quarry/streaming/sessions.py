"""Sessions: expiry by idle time, admission by caps, and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.graph import components

#: Fixed defaults.
USED_TTL, UNUSED_TTL, PER_IP, GLOBAL = 30 * 60, 15 * 60, 20, 1000


def expired(events: DataFrame, key: str = "user_id", when: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """The sessions of each key: a pause of more than the gap ends one. Works on tables and, with a watermark, on streams."""
    window = F.session_window(when, gap)
    found = events.groupBy(key, window.alias("s")).agg(F.count("*").alias("n_events"), F.max(when).alias("last_seen"))
    return found.select(key, F.col("s.start").alias("started"), "last_seen", F.col("s.end").alias("expires"), "n_events")


def reaped(sessions: DataFrame, now: str, used_ttl: int = USED_TTL, unused_ttl: int = UNUSED_TTL) -> DataFrame:
    """The sessions (sid, last_seen, used) that are idle for longer than their kind may be."""
    idle = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return sessions.where(idle > F.when(F.col("used"), used_ttl).otherwise(unused_ttl) * F.lit(1_000_000).cast("long"))


def _verdict(r: tuple, owner: dict[str, str], held: dict[str, int], per_ip: int) -> str:
    """The verdict on an event (ip, sid, kind, allowed), after which owner (of sessions) and held (sessions by address) are up to date."""
    if r.kind == "close":
        if r.sid in owner:
            held[ip := owner.pop(r.sid)] -= 1
            if not held[ip]:
                del held[ip]
        return "closed"
    if r.allowed:
        return "bypass"
    if r.sid in owner:
        return "again" if owner[r.sid] == r.ip else "sid-collision"
    if held.get(r.ip, 0) >= per_ip:
        return "rate-limit"
    owner[r.sid], held[r.ip] = r.ip, held.get(r.ip, 0) + 1
    return "open"


def admitted(events: DataFrame, per_ip: int = PER_IP) -> DataFrame:
    """events (ip, sid, ts, kind open or close, allowed) with their verdict: open, again, bypass, closed, rate-limit or sid-collision.

    Opens from an allowed address bypass all checks and leave no trace. An admitted open makes its address the owner of
    the session and counts there until the session is closed, from whatever address. An open of an owned session changes
    nothing if it comes from the owner, and is refused from any other address; a refused open owns nothing.

    One verdict may hang on all earlier ones of the addresses and sessions that it is linked with by other events, so linked addresses
    form a group, and each group's events are read in order of ts, then sid, ip and kind, by one task. Groups are found
    first, as components; a group itself can't be split.
    """
    rows = events.select("ip", "sid", "ts", "kind", "allowed")
    asked = rows.where("NOT allowed AND kind = 'open'")
    # a session belongs to the group of its least address; sessions with several addresses link these
    own = asked.groupBy("sid").agg(F.min("ip").alias("first"), F.max("ip").alias("last"))
    linked = asked.join(own.where("first != last").select("sid", "first"), "sid").select(F.col("ip").alias("a"), F.col("first").alias("b")).distinct()
    groups = components(linked).withColumnRenamed("node", "first").withColumnRenamed("component", "linked")
    by_sid = own.join(groups, "first", "left").select("sid", F.coalesce("linked", "first").alias("group"))
    rows = rows.join(by_sid, "sid", "left").withColumn("group", F.coalesce("group", F.concat(F.lit("sid "), "sid"), F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, owner, held = None, {}, {}
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.group != group:
                    group, owner, held = r.group, {}, {}
                out.append(_verdict(r, owner, held, per_ip))
            yield batch[["ip", "sid", "ts", "kind"]].assign(verdict=out)

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("ip", "sid", "ts", "kind")) + ", verdict string"
    return rows.repartition(n, "group").sortWithinPartitions("group", "ts", "sid", "ip", "kind").mapInPandas(run, schema)


def admitted_stream(events: DataFrame, per_ip: int = PER_IP, ttl: float = USED_TTL) -> DataFrame:
    """The same verdicts for a stream of (server, ip, sid, ts, kind, allowed) with a watermark on ts, as rows (server, ip, sid, ts, kind, verdict).

    Each server admits for itself, so its open sessions are the state of its key. A timer at the end of the session that is idle longest closes it; a server
    without sessions has no state. Events of a micro-batch are read in order of ts, then sid, ip and kind; one that comes in a later
    micro-batch than its successors is read late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sessions = {s: (ip, last) for s, ip, last in zip(*state.get, strict=True)} if state.exists else {}
        out = []

        def reap(now: float) -> None:
            for s in [s for s, (_, last) in sessions.items() if now - last > ttl]:
                del sessions[s]

        if state.hasTimedOut:
            reap(state.getCurrentWatermarkMs() / 1000)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "sid", "ip", "kind"])
            for r in rows.itertuples():
                now = r.ts.timestamp()
                reap(now)
                owner, held = {s: ip for s, (ip, _) in sessions.items()}, {}
                for ip, _ in sessions.values():
                    held[ip] = held.get(ip, 0) + 1
                verdict = _verdict(r, owner, held, per_ip)
                if verdict == "closed":
                    sessions.pop(r.sid, None)
                elif verdict in ("open", "again"):
                    sessions[r.sid] = (r.ip, now)
                out.append((key[0], r.ip, r.sid, r.ts, r.kind, verdict))
        if sessions:
            state.update(([*sessions], [ip for ip, _ in sessions.values()], [last for _, last in sessions.values()]))
            state.setTimeoutTimestamp(max(int((min(last for _, last in sessions.values()) + ttl) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists or state.hasTimedOut:
            state.remove()
        yield pd.DataFrame(out, columns=["server", "ip", "sid", "ts", "kind", "verdict"])

    kept = "sids array<string>, ips array<string>, seen array<double>"
    return events.groupBy("server").applyInPandasWithState(run, "server string, ip string, sid string, ts timestamp, kind string, verdict string", kept, "append", GroupStateTimeout.EventTimeTimeout)


def capacity(sessions: DataFrame, most: int = GLOBAL) -> DataFrame:
    """How full the server is: open sessions, whether that is all it takes, and whether to warn (four fifths)."""
    return sessions.agg(F.count("*").alias("open"), (F.count("*") >= most).alias("full"), (F.count("*") >= 0.8 * most).alias("warn"))
