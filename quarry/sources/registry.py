"""Providers of items by source type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import files


@dataclass
class Acquired:
    """What a provider read: items, ids that are gone (None: unknown), and the token of this state."""

    items: DataFrame
    removed: DataFrame | None
    token: str


class Provider(Protocol):
    def full(self) -> Acquired: ...

    def incremental(self, token: str) -> Acquired: ...

    def current_token(self) -> str | None: ...


class FileProvider:
    """Files below a folder, which may be or lie in a git checkout (repository). With a remote, reads begin with a pull or a clone into it."""

    def __init__(self, spark: SparkSession, path: str, include: list[str] = ["**"], exclude: list[str] = [], repository: str | None = None, documents: bool = False, max_bytes: int | None = None, remote: str | None = None, branch: str | None = None, access: str | None = None, **_: Any):
        self.spark, self.path, self.include, self.exclude, self.repository, self.documents = spark, path, include, exclude, repository, documents
        self.remote, self.branch, self.access = remote, branch, access
        self.max_bytes = max_bytes or (files.MAX_DOCUMENT_BYTES if documents else files.MAX_BYTES)

    def _pull(self) -> None:
        if self.remote:
            files.checkout(self.remote, self.repository or self.path, self.branch, self.access)
            self.repository = self.repository or self.path

    def _scan(self) -> DataFrame:
        return files.scan(self.spark, self.path, self.include, self.exclude, self.max_bytes)

    def full(self) -> Acquired:
        self._pull()
        return Acquired(files.items(self._scan(), documents=self.documents), None, self.current_token() or "")

    def incremental(self, token: str) -> Acquired:
        """Of a checkout, the files that changed since the token, by the same rules as a full read; of other folders, all."""
        self._pull()
        found = self.repository and files.git_changes(self.repository, token)
        if not found:
            return self.full()
        changed, deleted = (self.spark.createDataFrame([(p,) for p in x], "path string") for x in found)
        return Acquired(files.items(self._scan().join(changed, "path", "left_semi"), documents=self.documents), deleted.withColumnRenamed("path", "id"), self.current_token() or token)

    def current_token(self) -> str | None:
        return files.git_token(self.repository) if self.repository else files.state_token(self._scan()).first().token


PROVIDERS: dict[str, Callable[..., Provider]] = {kind: FileProvider for kind in ("markdown", "code", "raw-text", "html")}
PROVIDERS["document"] = lambda spark, **o: FileProvider(spark, documents=True, **o)


def register(kind: str, factory: Callable[..., Provider]) -> None:
    PROVIDERS[kind] = factory


def provider(kind: str, spark: SparkSession, **options: Any) -> Provider:
    from quarry.sources import chats  # noqa: F401  adds its kinds

    if kind not in PROVIDERS:
        raise ValueError(f"no provider for {kind}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[kind](spark, **options)
