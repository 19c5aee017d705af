"""What clients of chat and workspace services read, as DataFrames, and channels as a stream.

    spark.dataSource.register(FeedSource)
    spark.readStream.format("channel-feed").schema("channel string, ts string, text string")
        .option("client", "package.module:factory").option("channels", "a,b").option("position", "ts").load()

A factory makes a client (see clients) on the executor that uses it; that of a stream gets the options, a dict of strings. Lists are read channel by
channel, threads and pages are dealt out to `at_once` tasks, names are asked for once each. What was fetched is written to the shared folder, so no
request is repeated when an executor is lost later, or when a result is used twice.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from quarry.session import written
from quarry.sources import conversations, notion
from quarry.sources.api import Throttled
from quarry.sources.clients import Page, Refused

Factory = Callable[[], Any]
FAILURES = (Refused, Throttled, ConnectionError)
REACTIONS = "array<struct<name: string, count: int>>"
MESSAGE = f"channel string, ts string, thread_ts string, reply_count int, user string, text string, reactions {REACTIONS}, error string"
SAID = f"channel string, id string, author string, text string, timestamp string, reactions {REACTIONS}, error string"
THREAD = "channel string, id string, name string, message_count int, last_message_id string, url string, place long, error string"
PAGE = "id string, title string, last_edited string, url string, parent_type string, parent_id string, properties map<string, string>, place long"


def _fetched(keys: DataFrame, of: list[str], factory: Factory, pages: Callable[..., Iterator[Page]], schema: str, at_once: int, label: str, failing: bool = True) -> DataFrame:
    """The rows of pages(client, *key) for each key (columns `of`), in `at_once` tasks. A key that can't be read is, after what came, a row
    with an error and the values of the key; unless failing, where the job fails."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            for key in batch[of].itertuples(index=False, name=None):
                try:
                    for page in pages(client, *key):
                        yield pd.DataFrame([[r.get(n) for n in names] for r in page], columns=names, dtype=object)
                except FAILURES as e:
                    if failing:
                        raise
                    told = dict(zip(of, key, strict=True)) | {"error": str(e)[:500] or type(e).__name__}
                    yield pd.DataFrame([[told.get(n) for n in names]], columns=names, dtype=object)

    return written(keys.select(*of).distinct().repartition(at_once, *of).mapInPandas(run, schema), label)


def _table(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


class ChatMessages:
    """A fetcher for the chat provider: messages of channels and the replies of their threads, with names in the place of users.
    since(token) reads threads that began later; latest asks each channel for its newest message only."""

    def __init__(self, factory: Factory, min_replies: int = 2, at_once: int = 2, after: str | None = None):
        self.factory, self.min_replies, self.at_once, self.after = factory, min_replies, at_once, after

    def since(self, token: str | None) -> ChatMessages:
        return ChatMessages(self.factory, self.min_replies, self.at_once, token)

    def latest(self, spark: SparkSession, channels: list[str]) -> DataFrame:
        one = lambda client, channel: iter([[{"channel": channel, "ts": client.latest(channel)}]])
        return _fetched(_table(spark, channels, "channel"), ["channel"], self.factory, one, "channel string, ts string, error string", self.at_once, "latest", failing=False)

    def __call__(self, spark: SparkSession, channels: list[str]) -> DataFrame:
        after = self.after
        own = _fetched(_table(spark, channels, "channel"), ["channel"], self.factory, lambda client, c: client.messages(c, after), MESSAGE, self.at_once, "history", failing=False)
        threads = conversations.slack_threads(own.where("error IS NULL"), self.min_replies).select("channel", "ts")
        # a message without a thread is a thread of its own text; of threads that are read, the replies hold those shown in the channel too
        replies = _fetched(threads, ["channel", "ts"], self.factory, lambda client, c, t: client.replies(c, t), MESSAGE, self.at_once, "replies").where("ts <> thread_ts")
        rows = own.join(replies.select("channel", "ts"), ["channel", "ts"], "left_anti").unionByName(replies)
        return with_names(rows, self.factory, self.at_once).withColumn("timestamp", F.date_format(F.timestamp_millis((F.col("ts").try_cast("double") * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def with_names(rows: DataFrame, factory: Factory, at_once: int = 2) -> DataFrame:
    """rows with author, the name of the user and that of the team: each user and team is asked for once, whatever the number of messages. Unknown users keep their id."""
    user = lambda client, u: _known(client.user, u)
    users = _fetched(rows.where("user IS NOT NULL").select("user"), ["user"], factory, user, "id string, name string, team string", at_once, "users")
    teams = _fetched(users.where("team IS NOT NULL").select("team"), ["team"], factory, lambda client, t: iter([[client.team(t)]]), "id string, name string", at_once, "teams")
    return conversations.with_authors(rows, users, teams)


def _known(ask: Callable[[str], dict], key: str) -> Iterator[Page]:
    try:
        yield [ask(key)]
    except Refused:
        return


class ForumThreads:
    """A fetcher of threads for the forum provider; kinds tells which channels are of text, whose threads are distilled."""

    def __init__(self, factory: Factory, text: list[str] = [], at_once: int = 2):
        self.factory, self.text, self.at_once = factory, text, at_once

    def __call__(self, spark: SparkSession, channels: list[str]) -> DataFrame:
        found = _fetched(_table(spark, channels, "channel"), ["channel"], self.factory, lambda client, c: client.threads(c), THREAD, self.at_once, "threads", failing=False)
        return found.withColumn("kind", F.when(F.col("channel").isin(self.text), "text").otherwise("forum"))


class ForumMessages:
    """A fetcher of messages for the forum provider: of(threads) reads only those of the threads that are taken."""

    def __init__(self, factory: Factory, at_once: int = 2):
        self.factory, self.at_once = factory, at_once

    def of(self, threads: DataFrame) -> DataFrame:
        said = _fetched(threads.select(F.col("id").alias("channel")), ["channel"], self.factory, lambda client, c: client.messages(c), SAID, self.at_once, "said")
        return said.select(F.col("channel").alias("thread"), F.col("id").cast("decimal(20,0)").alias("position"), "author", "text", "timestamp", "reactions")


class WorkspaceSearch:
    """A fetcher of pages for the workspace provider: all pages, or the roots and then the entries of the databases, in this order."""

    def __init__(self, factory: Factory, roots: list[str] = [], databases: list[str] = []):
        self.factory, self.roots, self.databases = factory, roots, databases

    def __call__(self, spark: SparkSession, ids: list[str]) -> DataFrame:
        roots, databases = self.roots, self.databases

        def listed(client: Any, _: str) -> Iterator[Page]:
            place = 0
            parts = [client.search()] if not roots and not databases else [([client.page(r)] for r in roots), *(client.entries(d) for d in databases)]
            for part in parts:
                for page in part:
                    yield [p | {"properties": {k: json.dumps(v) for k, v in p["properties"].items()}, "place": place + i} for i, p in enumerate(page)]
                    place += len(page)

        rows = _fetched(_table(spark, ["all"], "list"), ["list"], self.factory, listed, PAGE, 1, "listed")
        front = F.map_filter(F.transform_values("properties", lambda _, v: notion.property_text(v)), lambda _, v: v.isNotNull())
        return rows.withColumn("frontmatter", F.when((F.col("parent_type") == "database_id") & (F.size(front) > 0), front)).drop("properties")


class WorkspaceBlocks:
    """A fetcher of blocks, as JSON. The service bounds requests a second for all tasks together, so `at_once` tasks of a factory whose clients pause
    `at_once` times as long keep it."""

    def __init__(self, factory: Factory, at_once: int = 1):
        self.factory, self.at_once = factory, at_once

    def __call__(self, spark: SparkSession, ids: DataFrame) -> DataFrame:
        one = lambda client, page: iter([[{"id": page, "blocks": json.dumps(client.blocks(page))}]])
        return _fetched(ids, ["id"], self.factory, one, "id string, blocks string", self.at_once, "blocks")


# ---- channels as a stream


class Span(InputPartition):
    """A channel's messages after one position up to another."""

    def __init__(self, channel: str, after: str | None, until: str):
        super().__init__((channel, after, until))


def client_of(options: dict[str, str]) -> Any:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class FeedReader(DataSourceStreamReader):
    """The offset is a map of channels to the last position that a batch covers, so a batch that is read again after a failure gives the same messages.

    The driver asks each channel for its newest position; a channel that can't be asked keeps its position and is behind until it can. When it starts,
    a stream needs every channel once, because a position that it left out would be lost from its checkpoint. If all fail, so does the stream.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = {k: options[k] for k in options}, schema.names
        self.channels, self.column = [c for c in options["channels"].split(",") if c], options.get("position", "ts")
        self.known: dict[str, str | None] = {}

    def initialOffset(self) -> dict:
        self.known = dict.fromkeys(self.channels, self.options.get("since"))
        return dict(self.known)

    def latestOffset(self) -> dict:
        client, failed = client_of(self.options), []
        for channel in self.channels:
            try:
                found = client.latest(channel)
            except FAILURES as e:
                failed.append((channel, e))
                continue
            old = self.known.get(channel)
            # an empty channel has no newest position, and one whose newest message was deleted has an older one
            self.known[channel] = found if found is not None and (old is None or client.position(found) > client.position(old)) else old
        unknown = [e for c, e in failed if c not in self.known]
        if failed and (unknown or len(failed) == len(self.channels)):
            raise (unknown or [failed[0][1]])[0]
        return {c: self.known[c] for c in self.channels}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        client = client_of(self.options)
        newer = lambda a, b: b is not None and (a is None or client.position(b) > client.position(a))
        return [Span(c, start.get(c, self.options.get("since")), end[c]) for c in sorted(end) if newer(start.get(c, self.options.get("since")), end[c])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        channel, after, until = partition.value
        client = client_of(self.options)
        bound = client.position(until)
        for page in client.messages(channel, after):
            yield from (tuple(m.get(n) for n in self.names) for m in page if client.position(m[self.column]) <= bound)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "channel-feed"

    def schema(self) -> str:
        return "channel string, ts string, thread_ts string, reply_count int, user string, text string"

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options, schema)
