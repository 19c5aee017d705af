"""Fixed-window rate limits whose windows begin with a key's first request.

The state of a key is two numbers, so requests are sorted by key and time and read once; no key's requests are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed limits of requests a minute, by what is asked for.
LIMITS = {"register": 10, "authorize": 30, "token": 30}


def admit(start: float | None, count: int, now: float, limit: int, window: float) -> tuple[float, int, bool, float]:
    """The window's start and count after a request, whether it is admitted, and the seconds to wait if not."""
    if start is None or now - start >= window:
        start, count = now, 0
    if count >= limit:
        return start, count, False, start + window - now
    return start, count + 1, True, 0.0


def limited(requests: DataFrame, limit: int, window: float = 60.0, key: str = "key", when: str = "ts") -> DataFrame:
    """requests with the columns admitted and retry_after (seconds)."""
    columns = requests.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", admitted boolean, retry_after double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, count = None, None, 0
        for batch in batches:
            admitted, wait = [], []
            for k, t in zip(batch[key], batch["_seconds"], strict=True):
                if k != last:
                    last, start, count = k, None, 0
                start, count, ok, left = admit(start, count, t, limit, window)
                admitted.append(ok)
                wait.append(left)
            yield batch[columns].assign(admitted=admitted, retry_after=wait)

    rows = requests.withColumn("_seconds", F.unix_micros(F.col(when).cast("timestamp")) / 1e6)
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in columns if c not in (key, when)]
    return rows.repartition(n, key).sortWithinPartitions(key, when, *rest).mapInPandas(run, schema)


def limited_stream(requests: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """The same for a stream of (key string, id long, ts timestamp) with a watermark on ts, as rows (key, id, admitted). The state of a key goes when the watermark passes its window."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for i, t in zip(rows["id"], rows["ts"], strict=True):
            start, count, ok, _ = admit(start, count, t.timestamp(), limit, window)
            out.append((key[0], i, ok))
        state.update((start, count))
        state.setTimeoutTimestamp(max(int((start + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "id", "admitted"])

    return requests.groupBy("key").applyInPandasWithState(run, "key string, id long, admitted boolean", "start double, count long", "append", GroupStateTimeout.EventTimeTimeout)
