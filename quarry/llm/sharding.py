"""Reproducible shuffle and sharding by a permutation of global row numbers.

Rows are numbered from 0 in the order of the given columns. A Feistel network over the least power of two that holds
all numbers, walked on until it lands below the row count, permutes them; the permuted number's remainder by the shard
count is the shard and its quotient the slot. Where a row goes, and which row a shard and slot hold, can be computed
without the data. Shard sizes in rows differ by one at most, and slots have no gaps.

Equal rows get different numbers, in any order, so the result as a set of rows is the same each time. Null values sort
first. An empty table stays empty. Other columns are kept; columns named shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import MIX, fresh, session_parallelism, written

ROUNDS = 6


def _mixed(x: np.ndarray, seed: int, r: int) -> np.ndarray:
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xC2B2AE3D27D4EB4F) % (1 << 64))) * MIX[2]
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    return x ^ (x >> np.uint64(29))


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    """One pass over numbers of 2 * bits bits; back undoes it."""
    mask, b = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> b, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            left, right = right ^ (_mixed(left, seed, r) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, seed, r) & mask)
    return left << b | right


def permuted(numbers: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """A permutation of 0 to n - 1 (back: its inverse) at the given numbers."""
    bits = max(1, (int(max(n - 1, 1)).bit_length() + 1) // 2)
    x = _network(numbers.astype(np.uint64), bits, seed, back)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = _network(x[out], bits, seed, back)
    return x.astype(np.int64)


def place(numbers: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of rows by their numbers."""
    at = permuted(numbers, n, seed)
    return at % shards, at // shards


def number_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """Row numbers by shard and slot."""
    return permuted(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def assigned(rows: DataFrame, order: list[str], shards: int = 8, seed: int = 0) -> DataFrame:
    """rows with the columns shard and slot."""
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    part, row, number = (fresh(c, columns) for c in ("part", "row", "number"))
    ranged = rows.select(*columns).repartitionByRange(session_parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)
    # the low 33 bits count the rows of a partition
    ranged = written(ranged.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranged")
    parts = ranged.groupBy(part).agg(F.count("*").alias("n"))
    # one row per partition, so small whatever the table
    first = fresh("first", ranged.columns)
    before = parts.select(part, F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(first))
    n = ranged.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = place(batch.column(number).to_numpy(), n, shards, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(shard.astype(np.int32)), pa.array(slot)], [*columns, "shard", "slot"])

    numbered = ranged.join(F.broadcast(before), part).select(*columns, (F.col(row) + F.coalesce(first, F.lit(0))).alias(number))
    return numbered.mapInArrow(run, rows.select(*columns).schema.add("shard", T.IntegerType()).add("slot", "long"))


def write_shards(rows: DataFrame, path: str, order: list[str], shards: int = 8, seed: int = 0) -> None:
    """Write one folder per shard, in the order of the slots within ranges of slots."""
    n = session_parallelism(rows.sparkSession)
    assigned(rows, order, shards, seed).repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
