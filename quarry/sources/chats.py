"""Providers of chat and workspace sources: what is fetched becomes items and a token of the state.

Fetchers are functions of (spark, channels or None) that return a DataFrame, as spark.read.format("paged-api") does; a
channel that can't be read is a row with the channel and an error. One such channel is left out; if all fail, so
does the read. These sources don't tell what is gone, so nothing is removed between full reads. Fetchers of feeds read less where they can: since(token)
leaves out older messages, latest asks for the newest ones only, of(threads) reads those of the threads that are taken.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import conversations, notion
from quarry.sources.registry import Acquired, register

Fetch = Callable[[SparkSession, list[str]], DataFrame]


def readable(rows: DataFrame, channels: list[str]) -> DataFrame:
    """The rows of channels without an error; an exception if every channel has one."""
    failed = {r.channel for r in rows.where("error IS NOT NULL").select("channel").distinct().collect()}  # at most as many as are configured
    if channels and failed >= set(channels):
        raise RuntimeError(f"all {len(channels)} channels failed")
    return rows.where(F.col("error").isNull() & ~F.col("channel").isin(sorted(failed))).drop("error")


def _last(token: DataFrame, before: str | None) -> str:
    return token.first().token or before or "0"


class SlackProvider:
    """Questions and answers that a distiller finds in threads. messages: channel, ts, thread_ts, reply_count, author, text, reactions, timestamp, error."""

    def __init__(self, spark: SparkSession, channels: list[str], messages: Fetch, distil: Callable[[str], str], min_replies: int = 2, min_confidence: float = 0.7, **_: Any):
        self.spark, self.channels, self.messages, self.distil, self.min_replies, self.min_confidence = spark, channels, messages, distil, min_replies, min_confidence

    def _acquired(self, since: str | None) -> Acquired:
        messages = self.messages.since(since) if hasattr(self.messages, "since") else self.messages
        rows = readable(messages(self.spark, self.channels), self.channels)
        threads = conversations.slack_threads(rows, self.min_replies, since).select("channel", F.col("ts").alias("parent"), "ts")
        said = rows.withColumnRenamed("thread_ts", "parent").join(threads.select("channel", "parent"), ["channel", "parent"])
        said = said.select(F.concat_ws(":", "channel", "parent").alias("thread"), F.col("ts").alias("position"), "author", "text", "reactions", "timestamp")
        pairs = conversations.distilled(conversations.for_distilling(said), self.distil, self.min_confidence)
        return Acquired(conversations.pair_items(pairs), None, _last(conversations.slack_token(threads), since))

    def full(self) -> Acquired:
        return self._acquired(None)

    def incremental(self, token: str) -> Acquired:
        return self._acquired(token)

    def current_token(self) -> str | None:
        newest = getattr(self.messages, "latest", self.messages)
        return readable(newest(self.spark, self.channels), self.channels).agg(F.max("ts").alias("token")).first().token


class DiscordProvider:
    """Forum threads as they are and text threads distilled. threads: channel, kind forum or text, id, name, message_count, last_message_id, url, error;
    messages: thread, position, author, text, timestamp, reactions."""

    def __init__(self, spark: SparkSession, channels: list[str], threads: Fetch, messages: Fetch, distil: Callable[[str], str], min_messages: int = 2, min_confidence: float = 0.7, **_: Any):
        self.spark, self.channels, self.threads, self.messages, self.distil = spark, channels, threads, messages, distil
        self.min_messages, self.min_confidence = min_messages, min_confidence

    def _acquired(self, since: str | None) -> Acquired:
        found = readable(self.threads(self.spark, self.channels), self.channels)
        rows = conversations.discord_threads(found, self.min_messages, since)
        said = self.messages.of(rows) if hasattr(self.messages, "of") else self.messages(self.spark, self.channels)
        forums = conversations.forum_items(rows.where("kind = 'forum'"), said.select("thread", "position", "author", "text"))
        text = rows.where("kind = 'text'").select(F.col("id").alias("of"), F.concat_ws(":", "channel", "id").alias("named"))
        talk = said.join(text, F.col("thread") == F.col("of")).select(F.col("named").alias("thread"), "position", "author", "text", "timestamp", "reactions")
        pairs = conversations.distilled(conversations.for_distilling(talk), self.distil, self.min_confidence)
        return Acquired(forums.unionByName(conversations.pair_items(pairs)), None, _last(conversations.discord_token(rows), since))

    def full(self) -> Acquired:
        return self._acquired(None)

    def incremental(self, token: str) -> Acquired:
        return self._acquired(token)

    def current_token(self) -> str | None:
        return conversations.discord_token(readable(self.threads(self.spark, self.channels), self.channels)).first().token


class NotionProvider:
    """Workspace pages. search: id, parent_type, parent_id, last_edited, title, url; blocks: id, blocks (JSON), frontmatter (map)."""

    def __init__(self, spark: SparkSession, search: Fetch, blocks: Callable[[SparkSession, DataFrame], DataFrame], roots: list[str] = [], databases: list[str] = [], **_: Any):
        self.spark, self.search, self.blocks, self.roots, self.databases = spark, search, blocks, roots, databases

    def _pages(self) -> DataFrame:
        return notion.discovered(self.search(self.spark, [*self.roots, *self.databases]), self.roots, self.databases)

    def _acquired(self, since: str | None, known: DataFrame | None = None) -> Acquired:
        pages = self._pages()
        changed = notion.edited_since(pages, since)
        items = notion.page_items(changed.join(self.blocks(self.spark, changed.select("id")), "id"))
        removed = None if known is None else known.join(pages.select("id"), "id", "left_anti")
        return Acquired(items, removed, _last(notion.token(pages), since))

    def full(self) -> Acquired:
        return self._acquired(None)

    def incremental(self, token: str, known: DataFrame | None = None) -> Acquired:
        """known: the ids that the index holds, of which those no longer found are removed."""
        return self._acquired(token, known)

    def current_token(self) -> str | None:
        return notion.token(self._pages()).first().token


register("slack", SlackProvider)
register("discord", DiscordProvider)
register("notion", NotionProvider)
