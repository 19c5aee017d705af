"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``window`` consecutive words. Each window is filed under its anchor: the least hash among its runs of
``gram`` words, which depends on the window's words alone, so equal windows have equal anchors. Neighbouring windows
with one anchor share a row (anchor, document, first window, number of windows).

The index is a list of immutable runs, tables bucketed and sorted by slot, which is the anchor itself for all but crowded anchors. append() writes a batch
of documents as a new run of level 0 and merge-joins it with the older ones, bucket by bucket without a shuffle, which tells the
anchors that are there more than once. Once a level has ``fan_in`` runs, compact() merges these into one of the next level, so a row is
rewritten as often as there are levels, a logarithm of the number of batches. Runs are tables in the shared folder; save() writes
the list of runs there, and FingerprintIndex.open() goes on from it, in another session too. Verification
digests the windows of repeated anchors from the texts and compares these digests within each anchor (128 bits
in all), so an anchor shared by different windows removes nothing.

Crowded anchors never meet in one task. An anchor that a batch of Arrow rows holds ``hot`` times or more is repeated
as it stands, so these rows take slots of their own in the run instead of the anchor's, and skip the merge-join. In
verification, anchors with over ``crowd`` rows are salted: parts are compared on their own, then the distinct windows
of the parts with each other. Slots and parts differ between the copies of one row, too.

Null and empty texts have no words; texts of fewer than ``window`` words lose nothing; very long texts are read whole, in strides. A window that starts twice in
one document counts as repeated, as do the windows of a repeated row, and of equal windows none is kept before another. Rows are told apart by a hash of doc_id and text, so
null and repeated doc_ids are fine. An empty table gives no rows. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import MIX, as_bytes, fresh, row_key, scratch_path, session_parallelism, whole_groups, written

#: Words that one step of the rolling hashes covers.
STRIDE = 1 << 16
_BASE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], dtype=np.uint64)
RUN = "slot long, anchor long, key long, first int, n int"


@lru_cache(maxsize=4)
def _powers(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the bases and of their inverses, from 0 on."""
    return tuple(np.stack([np.concatenate(([np.uint64(1)], np.cumprod(np.full(longest, b, dtype=np.uint64)))) for b in base]) for base in (_BASE, _INVERSE))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int, which: int) -> np.ndarray:
    """Hashes of all runs of k items."""
    n = len(hashes)
    powers, back = _powers(STRIDE + 256 if n <= STRIDE + 256 else 1 << n.bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers[which, :n])))
    out = (sums[k:] - sums[:-k]) * back[which, : n - k + 1]
    out ^= out >> np.uint64(32)
    out *= MIX[0]
    return out ^ (out >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each row of a text with these word hashes."""
    got = []
    for lo in range(0, len(hashes) - window + 1, STRIDE):
        part = rolling(hashes[lo : lo + STRIDE + window - 1], gram, 0)
        least = np.lib.stride_tricks.sliding_window_view(part, window - gram + 1).argmin(1) + np.arange(len(part) - window + gram)
        at = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        got.append((part[least[at]], at + lo, np.diff(np.concatenate((at, [len(least)])))))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def window_digests(hashes: np.ndarray, window: int) -> np.ndarray:
    parts = [rolling(hashes[lo : lo + STRIDE + window - 1], window, 1) for lo in range(0, len(hashes) - window + 1, STRIDE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class FingerprintIndex:
    """Runs of window fingerprints. Documents need the columns doc_id and text."""

    def __init__(self, spark: SparkSession, window: int = 35, gram: int = 8, fan_in: int = 2, crowd: int = 512, hot: int = 64):
        self.spark, self.window, self.gram, self.fan_in, self.crowd, self.hot = spark, window, gram, fan_in, crowd, hot
        self.buckets = session_parallelism(spark)
        #: Name, folder and level of each run; rows of runs that were written, merged ones counted again.
        self.runs: list[tuple[str, str, int]] = []
        self.rows_written = 0
        self._repeated: list[DataFrame] = []

    def _store(self, rows: DataFrame, level: int) -> str:
        name, folder = f"quarry_run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        rows.repartition(self.buckets, "slot").write.bucketBy(self.buckets, "slot").sortBy("slot").format("parquet").option("path", folder).saveAsTable(name)
        self.runs.append((name, folder, level))
        self.rows_written += self.spark.table(name).count()
        return name

    def _rows(self, runs: list[tuple[str, str, int]] | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.table(name) for name, _, _ in runs or self.runs))

    def append(self, docs: DataFrame) -> None:
        """Add a batch and note which anchors it repeats, of its own or of earlier batches."""
        window, gram, hot = self.window, self.gram, self.hot

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = (TaskContext.get().partitionId() + 1) << 40
            for batch in batches:
                keys, out = batch.column("key").to_numpy(), []
                for i, (key, text) in enumerate(zip(keys, as_bytes(batch.column("text")), strict=True)):
                    words = text.split()
                    if len(words) >= window:
                        a, first, n = anchors(word_hashes(words), window, gram)
                        out.append((a, np.full(len(a), key), first, n, np.full(len(a), task + i)))
                a, key, first, n, place = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
                a = a.view(np.int64)
                _, which, times = np.unique(a, return_inverse=True, return_counts=True)
                salted = (a ^ key).view(np.uint64) * MIX[1] + place.astype(np.uint64) * MIX[2]
                slot = np.where(times[which] >= hot, (salted ^ (salted >> np.uint64(29))).view(np.int64), a)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(a), pa.array(key), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["slot", "anchor", "key", "first", "n"])

        before = list(self.runs)
        rows = self.spark.table(self._store(docs.select(row_key().alias("key"), "text").mapInArrow(run, RUN), 0))
        found = rows.where("slot = anchor").groupBy("slot").agg(F.count("*").alias("rows"))
        if before:
            old = self._rows(before).where("slot = anchor").groupBy("slot").agg(F.count("*").alias("old"))
            found = found.join(old, "slot", "left").select("slot", (F.col("rows") + F.coalesce("old", F.lit(0))).alias("rows"))
        crowded = rows.where("slot != anchor").groupBy("anchor").agg(F.count("*").alias("rows"))
        found = found.where("rows > 1").select(F.col("slot").alias("anchor"), "rows", F.lit(False).alias("crowded"))
        self._repeated.append(written(found.unionByName(crowded.withColumn("crowded", F.lit(True))), "repeated"))
        self.compact()

    def compact(self) -> None:
        """Merge the runs of each level that has fan_in of them into one of the next level."""
        level = 0
        while level <= max((x[2] for x in self.runs), default=-1):
            full = [x for x in self.runs if x[2] == level]
            if len(full) >= self.fan_in:
                self._store(self._rows(full), level + 1)
                self._remove(full)
            level += 1

    def _remove(self, runs: list[tuple[str, str, int]]) -> None:
        for name, folder, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.runs = [x for x in self.runs if x not in runs]

    def drop(self) -> None:
        self._remove(list(self.runs))

    def save(self) -> str:
        """Write what the index consists of; returns the folder for open()."""
        folder = scratch_path(self.spark, "index")
        options = dict(window=self.window, gram=self.gram, fan_in=self.fan_in, crowd=self.crowd, hot=self.hot)
        told = {"options": options, "buckets": self.buckets, "runs": self.runs, "repeated": None}
        if self._repeated:
            told["repeated"] = scratch_path(self.spark, "repeated")
            reduce(DataFrame.unionByName, self._repeated).write.parquet(told["repeated"])
        self.spark.createDataFrame([(json.dumps(told),)], "manifest string").coalesce(1).write.parquet(folder)
        return folder

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        told = json.loads(spark.read.parquet(folder).first().manifest)
        index = cls(spark, **told["options"])
        index.buckets, index.runs = told["buckets"], [tuple(x) for x in told["runs"]]
        for name, path, _ in index.runs:
            columns = RUN.replace(" long", " BIGINT").replace(" int", " INT")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {index.buckets} BUCKETS LOCATION '{path}'")
        if told["repeated"]:
            index._repeated = [spark.read.schema("anchor long, rows long, crowded boolean").parquet(told["repeated"])]
        return index

    def repeated_rows(self) -> DataFrame:
        """The rows of repeated anchors, with the number of parts that an anchor's rows are dealt into."""
        if not self._repeated:
            return self.spark.createDataFrame([], "anchor long, key long, first int, n int, parts int")
        # an anchor may be noted with each batch, so its sum may be more than its rows
        hot = F.sum(F.when(F.col("crowded"), F.col("rows")).otherwise(0))
        totals = reduce(DataFrame.unionByName, self._repeated).groupBy("anchor").agg(F.ceil(F.sum("rows") / self.crowd).cast("int").alias("parts"), hot.alias("hot"))
        columns = ["anchor", "key", "first", "n", "parts"]
        rows = self._rows()
        lone = rows.where("slot = anchor").drop("anchor").join(totals.withColumnRenamed("anchor", "slot"), "slot").withColumnRenamed("slot", "anchor").select(*columns)
        crowded, every = rows.where("slot != anchor"), totals.agg(F.sum("hot")).first()[0] or 0
        if not every:
            return lone
        # anchors with a thousandth of the crowded rows each: a thousand at most, so they may be broadcast; no other one is many rows of a join
        heavy = totals.where(F.col("hot") * 1000 >= every).select("anchor", "parts")
        known = crowded.join(F.broadcast(heavy), "anchor").select(*columns)
        rest = crowded.join(F.broadcast(heavy.select("anchor")), "anchor", "left_anti").join(totals.select("anchor", "parts"), "anchor").select(*columns)
        return lone.unionByName(known).unionByName(rest)


def _verified(index: FingerprintIndex, docs: DataFrame) -> DataFrame:
    """(key, low, high): runs of words that windows with a second occurrence cover."""
    window, n = index.window, session_parallelism(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            for place, (key, text, rows) in enumerate(zip(batch.column("key").to_pylist(), as_bytes(batch.column("text")), batch.column("rows").to_pylist(), strict=True)):
                whole = window_digests(word_hashes(text.split()), window)
                out += [(r["anchor"], ((key ^ r["first"]) + task + place) % r["parts"], r["parts"], key, r["first"], whole[r["first"] : r["first"] + r["n"]].tobytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["anchor", "part", "parts", "key", "first", "digests"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "place"):
            raw = table["digests"].combine_chunks()
            raw = pa.concat_arrays(raw.chunks) if isinstance(raw, pa.ChunkedArray) else raw
            digests = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint64)
            sizes = np.array([len(x) for x in raw.to_pylist()]) // 8
            row = np.repeat(np.arange(len(sizes)), sizes)
            start = table["first"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key, anchor, parts = (table[c].to_numpy()[row] for c in ("key", "anchor", "parts"))
            order = np.lexsort((digests, anchor))
            same = (digests[order[1:]] == digests[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
            twice = np.zeros(len(row), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            # runs of windows with a second occurrence, as words
            hit = np.flatnonzero(twice)
            begins = np.concatenate(([True], (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]]))) if len(hit) else np.zeros(0, bool)
            ends = np.concatenate((begins[1:], [True])) if len(hit) else begins
            lo, hi = hit[begins], hit[ends]
            # of anchors in parts, one of each distinct window for the comparison of the parts
            firsts = np.concatenate(([True], ~same)) if len(order) else np.zeros(0, bool)
            of_parts = order[firsts & (parts[order] > 1)]
            alone = ~twice[of_parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((key[lo], key[of_parts]))),
                    pa.array(np.concatenate((start[lo], np.where(alone, start[of_parts], -1))).astype(np.int32)),
                    pa.array(np.concatenate((start[hi] + window, start[of_parts] + window)).astype(np.int32)),
                    pa.array(np.concatenate((np.zeros(len(lo), np.int64), anchor[of_parts]))),
                    pa.array(np.concatenate((np.zeros(len(lo), np.int64), digests[of_parts].view(np.int64))), mask=np.concatenate((np.ones(len(lo), bool), np.zeros(len(of_parts), bool)))),
                ],
                ["key", "low", "high", "anchor", "digest"],
            )

    flagged = index.repeated_rows().groupBy("key").agg(F.collect_set(F.struct("anchor", "first", "n", "parts")).alias("rows"))
    texts = docs.select(row_key().alias("key"), "text").join(flagged, "key")
    dealt = texts.mapInArrow(digest, "anchor long, part int, parts int, key long, first int, digests binary").withColumn("place", F.xxhash64("anchor", "part"))
    found = written(dealt.repartition(n, "place").sortWithinPartitions("place").mapInArrow(compare, "key long, low int, high int, anchor long, digest long"), "covered")
    covered = found.where("digest is null").select("key", "low", "high")
    parts = found.where("digest is not null")
    again = parts.groupBy("anchor", "digest").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "digest")
    return covered.unionByName(parts.where("low >= 0").join(again, ["anchor", "digest"]).select("key", "low", "high"))


def deduplicated(docs: DataFrame, window: int = 35, batches: int = 2, rejoin: bool = False, **options: int) -> DataFrame:
    """docs with text stripped of every word that a repeated window covers, and the longs n_words and n_removed of
    each row (in the place of columns with such names). Kept words are joined by one space; a text that loses nothing
    stays as it is unless rejoin is set. The documents go through the index in so many batches."""
    index = FingerprintIndex(docs.sparkSession, window, **options)
    for i in range(batches):
        index.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    covered = written(_verified(index, docs).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    index.drop()
    columns = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    own_key, own_spans = fresh("key", docs.columns), fresh("spans", docs.columns)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[bytes | None] = batch.column("text").cast(pa.binary()).to_pylist()
            counts = np.zeros((2, len(texts)), dtype=np.int64)
            for i, spans in enumerate(batch.column(own_spans).to_pylist()):
                words = (texts[i] or b"").split()
                counts[0, i] = len(words)
                if spans:
                    keep = np.ones(len(words), dtype=bool)
                    for s in spans:
                        keep[s["low"] : s["high"]] = False
                    counts[1, i] = len(words) - int(keep.sum())
                    words = [words[j] for j in np.flatnonzero(keep)]
                if spans or rejoin:
                    texts[i] = b" ".join(words)
            stripped = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(stripped if c == "text" else batch.column(c) for c in columns), pa.array(counts[0]), pa.array(counts[1])], [*columns, "n_words", "n_removed"])

    covered = covered.select(F.col("key").alias(own_key), F.col("spans").alias(own_spans))
    joined = docs.withColumn(own_key, row_key()).join(covered, own_key, "left").select(*columns, own_spans)
    return joined.mapInArrow(strip, docs.select(*columns).schema.add("n_words", "long").add("n_removed", "long"))


def recounted(found: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of deduplicated(), with n_chars, where there is one, brought in line with texts that lost words."""
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*columns)
