"""A stored vector index: lists around centroids, compact codes in front of full rows, and an exact or a probing search.

Unit vectors are dealt to the nearest of ``lists`` centroids (k-means on a bounded sample). Two tables are partitioned by list: codes
(a byte for each dimension, a scale, and the length of what the code leaves out), and rows, the chunks themselves. A search
scores the codes of the lists it reads. A code's error bounds how far the true cosine may lie from the scored one, so only rows that can be among
the best are read in full and ranked by their exact cosine.

Without ``probes`` a search is exact: after the nearest lists, which give a first bound for the k-th best, it reads every other list unless even a
vector on the edge of its cap would fall below that bound. With ``probes`` it reads so many nearest lists only.

The index grows by runs: add() writes new rows beside the old ones, remove() writes ids that earlier runs no longer hold; compacted() writes one
run again. Rows without a direction (null, empty, zero, not finite, or of another length than most) are in no list and are never found, as in a scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalar import cosine
from quarry.session import written

#: Rows for each centroid in the sample that k-means sees; its rounds; the largest number of lists.
FIT_ROWS, ROUNDS, MOST_LISTS = 64, 10, 4096
#: Slack for the rounding of cosines in double precision.
CLOSE = 1e-9


def directed(column: str = "embedding") -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e150))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def centroids(rows: DataFrame, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of the lists, by k-means with cosines on FIT_ROWS rows for each list; fewer where the sample has fewer different vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = rows.count()
    share = min(1.0, 2 * FIT_ROWS * lists / max(1, total))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    key = F.xxhash64("id", F.lit(seed))
    sample = rows.where(key <= bound).orderBy(key).limit(FIT_ROWS * lists).select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=max(2, lists), maxIter=ROUNDS, seed=seed, distanceMeasure="cosine").fit(sample)
    return _unit(np.array([c for c in model.clusterCenters() if np.any(c)]))


class VectorIndex:
    """An index under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r.centroid for r in found]).reshape(len(found), len(found[0].centroid) if found else 0)

    @classmethod
    def build(cls, chunks: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """An index over all chunks (id, embedding and any other columns); about as many lists as the square root of the rows by default."""
        spark, path = chunks.sparkSession, path.rstrip("/")
        sized = chunks.where(directed())
        common = sized.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        if common is None:
            spark.createDataFrame([], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
            return cls(spark, path)
        rows = sized.where(F.size("embedding") == common.size)
        found = centroids(rows, min(MOST_LISTS, lists or max(2, round(common["count"] ** 0.5))))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path)
        index._append(rows, 0)
        return index

    def _append(self, rows: DataFrame, run: int) -> None:
        found = self._listed(rows)
        # a list may hold a third of all rows, so partitions of it are split by size as they are written
        found.select("_list", *rows.columns).withColumnsRenamed({"_list": "list"}).hint("rebalance", "list").write.partitionBy("list").parquet(f"{self.path}/rows/run={run}")
        kept = [c for c in ("source_name", "version") if c in rows.columns]
        codes = found.select(F.col("_list").alias("list"), "id", *kept, "_code.*").hint("rebalance", "list")
        codes.write.partitionBy("list").parquet(f"{self.path}/codes/run={run}")
        caps = self.spark.read.parquet(f"{self.path}/codes/run={run}").groupBy("list").agg(F.min("near").alias("near"), F.count("*").alias("n"))
        caps.coalesce(1).write.parquet(f"{self.path}/caps/run={run}")

    def _listed(self, rows: DataFrame) -> DataFrame:
        """rows with their list and code."""
        found = self.spark.sparkContext.broadcast(self.centroids)
        size = self.centroids.shape[1]

        @F.pandas_udf("list int, code binary, scale float, error double, near double")
        def encoded(vectors):
            import pandas as pd

            x = _unit(np.array([*vectors], float).reshape(-1, size))
            near = x @ found.value.T
            at = near.argmax(1)
            scale = np.float32(1.000001) * (np.abs(x).max(1) / 127).astype(np.float32)
            code = np.rint(x / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(x - code * scale.astype(float)[:, None], axis=1)
            return pd.DataFrame({"list": at.astype(np.int32), "code": [c.tobytes() for c in code], "scale": scale, "error": error, "near": near[np.arange(len(x)), at]})

        return rows.withColumn("_c", encoded("embedding")).withColumn("_list", F.col("_c.list")).withColumn("_code", F.struct(*(F.col(f"_c.{k}").alias(k) for k in ("code", "scale", "error", "near")))).drop("_c")

    # changes

    def _runs(self) -> int:
        return self.spark.read.parquet(f"{self.path}/caps").agg(F.max("run").alias("run")).first().run + 1

    def add(self, chunks: DataFrame) -> None:
        """Add rows, in the place of earlier ones with their ids. Centroids stay as they are; an index of no rows has none and is built anew instead."""
        if not len(self.centroids):
            raise ValueError("an index without rows has no lists: build it again")
        run = self._runs()
        self._gone(chunks.select("id"), run)
        self._append(chunks.where(directed() & (F.size("embedding") == self.centroids.shape[1])), run)

    def remove(self, ids: DataFrame) -> None:
        """Forget the rows with these ids."""
        self._gone(ids.select("id"), self._runs())

    def _gone(self, ids: DataFrame, before: int) -> None:
        ids.distinct().withColumn("before", F.lit(before)).write.mode("append").parquet(f"{self.path}/gone")

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows without those that later runs replaced or removed."""
        try:
            gone = self.spark.read.parquet(f"{self.path}/gone")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return rows
        last = gone.groupBy("id").agg(F.max("before").alias("before"))
        return rows.join(last.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("run") < F.col("before")), "left_anti")

    def compacted(self, path: str) -> VectorIndex:
        """The same rows as an index of one run with centroids of its own."""
        return VectorIndex.build(self.rows().drop("list", "run"), path)

    # search

    def rows(self) -> DataFrame:
        return self._live(self.spark.read.parquet(f"{self.path}/rows"))

    def _codes(self) -> DataFrame:
        return self._live(self.spark.read.parquet(f"{self.path}/codes"))

    def bounds(self, unit: np.ndarray) -> list[tuple[int, float, float, int]]:
        """Of each list: its number, the cosine with its centroid, the greatest cosine that a vector in its cap can have, and its rows; nearest first."""
        caps = {r.list: r for r in self.spark.read.parquet(f"{self.path}/caps").groupBy("list").agg(F.min("near").alias("near"), F.sum("n").alias("n")).collect()}
        out = []
        for i, c in enumerate(self.centroids):
            if i in caps:
                cos = float(np.clip(c @ unit, -1, 1))
                apart = math.acos(cos) - math.acos(float(np.clip(caps[i].near, -1, 1)))
                out.append((i, cos, 1.0 if apart <= 0 else math.cos(apart), caps[i].n))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def _candidates(self, unit: np.ndarray, lists: list[int], k: int, source: str | None, version: str | None, over: float = -2.0) -> DataFrame:
        """Rows of these lists that may be among the k best and may reach a bound: list, id, run, low and high, between which their cosine lies. A task leaves out what k of its own surpass."""
        rows = self._codes().where(F.col("list").isin(lists))
        for column, value in (("source_name", source), ("version", version)):
            if value:
                rows = rows.where(F.col(column) == value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full(k, -2.0)
            for batch in batches:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, len(unit))
                near = (code @ unit) * batch.column("scale").to_numpy().astype(float)
                error = batch.column("error").to_numpy() + CLOSE
                best = np.sort(np.concatenate((best, near - error)))[len(near) :]
                keep = near + error >= max(over, best[0])
                kept = [batch.column(c).filter(pa.array(keep)) for c in ("list", "id", "run")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array((near - error)[keep]), pa.array((near + error)[keep])], ["list", "id", "run", "low", "high"])

        kind = rows.schema["id"].dataType.simpleString()
        return rows.select("list", "id", "run", "code", "scale", "error").mapInArrow(run, f"list int, id {kind}, run int, low double, high double")

    def search(self, query: list[float], limit: int, source: str | None = None, version: str | None = None, min_score: float | None = None, probes: int | None = None) -> DataFrame:
        """The nearest rows by cosine, as vector_search() finds them; exactly those, unless probes limits the lists that are read."""
        if not len(self.centroids):
            return self.spark.createDataFrame([], "id long, similarity double")
        columns = [c for c in self.rows().columns if c not in ("list", "run")]
        norm = math.sqrt(sum(float(x) ** 2 for x in query))
        if limit <= 0 or not norm or len(query) != self.centroids.shape[1]:
            return self.rows().select(*columns).drop("embedding").withColumn("similarity", F.lit(0.0)).where(F.lit(False))
        found = self.read(np.array(query, float) / norm, limit, source, version, probes)
        # few rows as a rule, but ties of copies may be many: a join, whose small side Spark broadcasts by its size, and whose lists prune partitions
        rows = self.rows().join(found.select("list", "run", "id"), ["list", "run", "id"], "left_semi").select(*columns)
        best = rows.withColumn("similarity", cosine(F.col("embedding"), query)).drop("embedding").orderBy(F.desc("similarity"), "id").limit(limit)
        return best if min_score is None else best.where(F.col("similarity") >= min_score)

    def read(self, unit: np.ndarray, limit: int, source: str | None = None, version: str | None = None, probes: int | None = None) -> DataFrame:
        """The rows that a search reads in full."""
        lists = self.bounds(unit)
        # the lists that hold several times the limit come first
        many = np.searchsorted(np.cumsum([x[3] for x in lists]), 4 * limit) + 1
        first = lists[: probes if probes else max(int(many), len(lists) // 16)]
        found = written(self._candidates(unit, [x[0] for x in first], limit, source, version), "candidates")
        over = self._kth(found, limit)
        rest = [] if probes else [x[0] for x in lists[len(first) :] if x[2] + CLOSE >= over]
        if rest:
            found = found.unionByName(written(self._candidates(unit, rest, limit, source, version, over), "candidates"))
            over = self._kth(found, limit)
        return found.where(F.col("high") >= over)

    @staticmethod
    def _kth(found: DataFrame, k: int) -> float:
        """What the k-th best reaches at least."""
        best = found.select("low").orderBy(F.desc("low")).limit(k).agg(F.count("*").alias("n"), F.min("low").alias("low")).first()
        return best.low if best.n == k else -2.0
