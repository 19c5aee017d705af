"""The indexing plan: items to chunks to vectors to the chunk table, and the states of sources."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import upkeep
from quarry.operators.chunking import Sizes, chunked

Embedder = Callable[[list[str]], list[list[float]]]
#: Characters of a text that an embedder sees; texts in a call, by kind of provider.
SEEN, TOGETHER = 30_000, {"hosted": 2048, "server": 512, "local": 32}
_EMBEDDED = T.StructType().add("vector", T.ArrayType(T.FloatType())).add("error", T.StringType()).add("attempts", T.IntegerType())


def hashed_embedder(dimensions: int = 64) -> Embedder:
    """A deterministic embedder without a model: signed counts of hashed words, scaled to length one."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def _called(embed: Embedder, texts: list[str], retries: int, pause: float) -> list[tuple[list[float] | None, str | None, int]]:
    """Vector, error and number of tries of each text of a call. A lost connection or a timeout is tried again after growing pauses. A call that is refused for any other reason, or answers with
    another number of vectors, is halved until the text at fault is alone."""
    for attempt in range(1, retries + 1):
        try:
            found = embed(texts)
            if len(found) == len(texts):
                return [(v, None, attempt) for v in found]
            error = f"{len(found)} vectors for {len(texts)} texts"
            break
        except (ConnectionError, TimeoutError) as e:
            if attempt == retries:
                return [(None, f"{type(e).__name__}: {e}", attempt)] * len(texts)
            time.sleep(pause * 2 ** (attempt - 1))
        except Exception as e:  # what a provider refuses is the text's error, not the job's end
            error = f"{type(e).__name__}: {e}"
            break
    if len(texts) == 1:
        return [(None, error, attempt)]
    half = len(texts) // 2
    return _called(embed, texts[:half], retries, pause) + _called(embed, texts[half:], retries, pause)


def embedded(text: Column, provider: Callable[[], Embedder], kind: str = "server", retries: int = 3, pause: float = 1.0) -> Column:
    """vector, error and attempts of texts. A task asks its provider, which is made once, for as many texts at a time as its kind takes, whatever the size of Arrow's batches.
    Null texts have no vector and no error."""
    size = TOGETHER[kind]

    @F.pandas_udf(_EMBEDDED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        embed, held = provider(), []

        def answered(part: list[str | None]) -> pd.DataFrame:
            texts = [t[:SEEN] for t in part if t is not None]
            found = iter(_called(embed, texts, retries, pause) if texts else ())
            return pd.DataFrame([(None, None, 0) if t is None else next(found) for t in part], columns=["vector", "error", "attempts"])

        for texts in batches:
            held += [None if pd.isna(t) else t for t in texts]
            while len(held) >= size:
                yield answered(held[:size])
                held = held[size:]
        if held:
            yield answered(held)

    return run(text)


def failures(rows: DataFrame, column: str = "embedded") -> DataFrame:
    """The ledger of rows whose text got no vector: their columns, error and attempts. Run these again once the cause is gone."""
    return rows.where(F.col(f"{column}.error").isNotNull()).select(*[c for c in rows.columns if c != column], f"{column}.error", f"{column}.attempts")


def embedding(text: Column, provider: Callable[[], Embedder], retries: int = 3, kind: str = "server") -> Column:
    """Vectors of texts; the job fails where one gets none."""
    found = embedded(text, provider, kind, retries)
    return F.when(found["error"].isNotNull(), F.raise_error(found["error"])).otherwise(found["vector"])


def chunk_rows(items: DataFrame, source: str, kind: str, provider: Callable[[], Embedder], sizes: Sizes = Sizes(), repo_url: str | None = None, token: str | None = None, version: str | None = None, base: Column | None = None) -> DataFrame:
    """Rows of the chunk table for items. A chunk's title goes before its item's, an item's url before the derived one, an item's metadata before the chunk's."""
    parts = chunked(items, kind, sizes).withColumnRenamed("title", "chunk_title")
    rows = parts.join(items.select("id", "title", "source_url", "metadata"), "id")
    own = F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,string>")
    path = F.when(F.size("heading_path") > 0, F.create_map(F.lit("headingPath"), F.to_json("heading_path"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(path, lambda k, v: ~F.map_contains_key(own, k)), own)
    url = F.col("source_url") if base is None else F.coalesce("source_url", base)
    text = lambda x: F.lit(x).cast("string")
    return rows.select(
        F.xxhash64(F.lit(source), "id", "chunk_index").alias("id"), F.lit(source).alias("source_name"), url.alias("source_url"), F.coalesce("chunk_title", "title").alias("title"), "content", embedding(F.col("content"), provider).alias("embedding"),
        text(repo_url).alias("repo_url"), F.col("id").alias("file_path"), "start_line", "end_line", "language", "chunk_index", F.to_json(merged).alias("metadata"), F.localtimestamp().alias("indexed_at"), text(token).alias("commit_sha"), text(version).alias("version"),
    )


def indexed(existing: DataFrame, new: DataFrame, items: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The chunk table of one source after a run: chunks of removed ids and of all items that were read go, also of items that now have none; new ones come."""
    gone = items.select(F.col("id").alias("file_path"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col("id").alias("file_path")))
    source = new.select("source_name").distinct()
    old = existing.join(source, "source_name", "left_semi").join(gone.distinct(), "file_path", "left_anti").select(*existing.columns)
    others = existing.join(source, "source_name", "left_anti").select(*existing.columns)
    return others.unionByName(old).unionByName(new.select(*existing.columns))


def state_row(spark, source_type: str, key: str, status: str, token: str | None = None, error: str | None = None) -> DataFrame:
    row = spark.createDataFrame([(source_type, key, token, status, error)], "source_type string, source_key string, last_commit_sha string, status string, error_message string")
    return row.withColumn("last_indexed_at", F.when(F.lit(status == "idle"), F.localtimestamp()))


def run_source(spark, states: DataFrame, source_type: str, key: str, work: Callable[[], str]) -> DataFrame:
    """States after a run of work, which returns the new token: idle with the token, or error with what went wrong and the old token."""
    states = upkeep.state_upserted(states, state_row(spark, source_type, key, "indexing"))
    try:
        after = state_row(spark, source_type, key, "idle", token=work())
    except Exception as e:  # the failure of one source is its state, not the run's end
        after = state_row(spark, source_type, key, "error", error=str(e)[:1000])
    return upkeep.state_upserted(states, after)
