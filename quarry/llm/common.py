"""What the training-data operators share: samples, grouped Arrow streams, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path, written

__all__ = ["MIX", "as_bytes", "fresh", "hash_sample", "row_key", "scratch_path", "session_parallelism", "slices", "starts_of", "table", "whole_groups", "written"]

#: Odd multipliers for linear hashes modulo 2**64.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> "F.Column":
    """Tells rows apart where doc_id is null or repeats; equal rows get equal keys."""
    return F.xxhash64("doc_id", "text")


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(rows: DataFrame, n: int, total: int, *by: str) -> DataFrame:
    """The n different rows with the smallest hash of the columns by (doc_id), of total rows. Only rows below a bound on
    the hash, about n of total, are sorted, however many tasks read the table; where rows repeat, fewer than n may lie below it."""
    share = min(1.0, (n + 6 * n**0.5 + 16) / max(1, total))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    key = F.xxhash64(*(by or ("doc_id",)))
    return rows.where(key <= bound).distinct().orderBy(key, *rows.columns).limit(n)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a string column holds about most bytes or one row; empty ones stay."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        lo = 0
        while True:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
            if lo >= batch.num_rows:
                break


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by an integer key, cut so that no key is in two of the tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if not held or cut or keys[0] == held[-1].column(key)[-1].as_py():
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        else:
            yield pa.Table.from_batches(held)
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the length at the end."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def session_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
