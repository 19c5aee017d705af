"""Paged web APIs as a Spark data source: one partition for each channel, pages fetched on the executors.

    spark.dataSource.register(ApiSource)
    spark.read.format("paged-api").schema(...).option("client", "package.module:function").option("channels", "a,b").load()

The client is a function (channel, cursor) -> (rows, next cursor or None); it raises Throttled for a status 429.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed limits of paging.
MAX_PAGES, MAX_RETRIES, LONGEST_WAIT = 100, 5, 300.0


class Throttled(Exception):
    """The server asks to wait for so many seconds."""

    def __init__(self, seconds: float | None = None):
        super().__init__(seconds)
        self.seconds = seconds


def patiently(call: Callable[[], object], retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of a call that is tried again when it is throttled, after the time asked for, or loses its connection, after growing pauses."""
    for attempt in range(retries + 1):
        try:
            return call()
        except (Throttled, ConnectionError) as e:
            if attempt == retries:
                raise
            asked = getattr(e, "seconds", None)
            sleep(min(LONGEST_WAIT, asked if asked and asked > 0 else 1.0 + attempt))


def pages(client: Callable[[str, str | None], tuple[list, str | None]], channel: str, most: int = MAX_PAGES, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    cursor = None
    for _ in range(most):
        rows, cursor = patiently(lambda: client(channel, cursor), sleep=sleep)  # noqa: B023
        yield rows
        if not cursor:
            return


class ChannelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client, self.channels = options["client"], [c for c in options["channels"].split(",") if c]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.channels]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.client.partition(":")
        client = getattr(importlib.import_module(module), name)
        for rows in pages(client, partition.value):
            yield from (tuple(r) for r in rows)


class ApiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged-api"

    def schema(self) -> str:
        return "channel string, ts string, user string, text string, thread_ts string, reply_count int"

    def reader(self, schema) -> ChannelReader:
        return ChannelReader(self.options)
