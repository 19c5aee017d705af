"""Quality rules: fixed rules, then an isolation forest on the rule statistics of whole texts.

A rule statistic is a measure of the whole text (symbols to a character, repeated lines to a line, and so on). A tree splits
the rows that pass the fixed rules on random measures at random values; the values are drawn between the
bounds that earlier splits leave of the range that the measure has over all rows of the corpus. Documents that random splits isolate after few steps are anomalous. No label is used in
growing. The threshold comes from all labelled rows: at most ``false_reject`` of the rows with label 1 that pass the
fixed rules may lie above it, and of those thresholds the one that separates the labels best is taken. With no rows of
either label the forest rejects nothing.

An isolation forest measures paths in trees of ``subsample`` rows each. No subsample is drawn here: as the splits hang on the ranges alone, Spark counts all rows at each node of each tree, and
the length of a path is its exact mean over all subsamples of that size (hypergeometric in the counts). Trees have log2(subsample) levels, so what reaches the driver, a count for each leaf,
has a size that ``trees`` and ``subsample`` fix. The threshold is found from the counts of labels by score: those of 16,384 cells of scores on the driver, those within a cell on executors.

Null and empty texts have no words and so fail the fixed rules. Very long texts are read whole. Repeated rows get equal
verdicts and count once in fitting, equal anomalies lie on the same side of the threshold, null doc_id is kept as it is, an empty table gives no rows, and extra
columns, whatever their names, are ignored by judge() and kept by accepted().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.features import COUNTS, MEASURES, counted, measures, with_counts

#: What the forest looks at; the length of a text and the make of its words are no fault.
USED = [MEASURES.index(m) for m in ("symbols", "dup_lines", "repeats", "upper", "exclaims", "distinct", "top_word", "adjacent")]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PASSES = "n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words"
#: Cells of scores whose counts of labels the driver sees.
CELLS = 1 << 14


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeated = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (n < 50) | (100 * repeated > 50 * n)


@dataclass
class Forest:
    """Complete trees as arrays in heap order: split measure and split value (infinite: nothing to split) of the inner nodes, path length of the leaves."""

    measure: np.ndarray
    value: np.ndarray
    length: np.ndarray
    normal: float = 1.0
    threshold: float = 2.0

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaf of each row."""
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for m, v in zip(self.measure, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(len(m).bit_length()):
                at = 2 * at + 1 + (flat[first + m[at]] > v[at])
            yield at - len(m)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1: 2 to the power of minus the mean path length over its expectation."""
        total = np.zeros(len(x))
        for at, length in zip(self.leaves(x), self.length, strict=True):
            total += length[at]
        return 2 ** (-total / max(1, len(self.measure)) / self.normal)

    def rows_by_leaf(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.bincount(at, minlength=self.length.shape[1]) for at in self.leaves(x)]).reshape(self.length.shape)

    def weigh(self, rows: np.ndarray, subsample: int) -> None:
        """Sets path lengths. rows: how many of all rows lie in each leaf."""
        n, depth = int(rows[0].sum()) if len(rows) else 0, self.measure.shape[1].bit_length()
        size = min(subsample, n)
        levels = [rows.reshape(len(rows), 1 << d, -1).sum(2) for d in range(depth + 1)]
        found, at = np.unique(np.concatenate(levels, 1), return_inverse=True)
        goes_on, rest = (a[at.reshape(len(rows), -1)] for a in _subsampled(found, n, size))
        goes_on = goes_on[:, : self.measure.shape[1]] * np.isfinite(self.value)
        self.length = rest[:, self.measure.shape[1] :]
        for d in range(depth):
            self.length = self.length + np.repeat(goes_on[:, (1 << d) - 1 : (2 << d) - 1], 1 << (depth - d), 1)
        self.normal = max(_expected(size), 1e-9)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _subsampled(rows: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of subsamples of so many of n rows, and nodes with so many rows: the chance that a node gets two rows or more, and the mean of _expected of what it gets."""
    k, past = np.arange(size + 1), np.array([_expected(i) for i in range(size + 1)])

    def falling(m: np.ndarray) -> np.ndarray:
        """Logarithms of m (m - 1) ... of 0 to size factors."""
        with np.errstate(divide="ignore"):
            return np.cumsum(np.column_stack((np.zeros(len(m)), np.log(np.maximum(m[:, None] - k[:-1], 0)))), 1)

    logs = np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    ways = logs[-1] - logs - logs[::-1]
    chances = []
    for at in range(0, len(rows), 4096):
        m = rows[at : at + 4096]
        p = np.exp(ways + falling(m) + falling(n - m)[:, ::-1] - falling(np.array([n]))[:, -1:])
        chances.append((p[:, 2:].sum(1), p @ past))
    return np.concatenate([c[0] for c in chances]), np.concatenate([c[1] for c in chances])


def planted(bounds: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
    """Trees with splits and no lengths. bounds: rows whose ranges the splits cover."""
    bounds = bounds if len(bounds) else np.zeros((1, len(USED)))
    rng, depth = np.random.default_rng(seed), max(1, math.ceil(math.log2(max(2, subsample))))
    low, high = (np.broadcast_to(b, (trees, 1, bounds.shape[1])) for b in (bounds.min(0), bounds.max(0)))
    measure, value = [], []
    for _ in range(depth):
        m = np.where(high > low, rng.random(low.shape), -1).argmax(2)[:, :, None]
        least, most = np.take_along_axis(low, m, 2), np.take_along_axis(high, m, 2)
        v = np.minimum(least + rng.random(m.shape) * (most - least), most)
        measure.append(m[:, :, 0].astype(np.int8))
        value.append(np.where(most > least, v, np.inf)[:, :, 0])
        below, above = high.copy(), low.copy()
        np.put_along_axis(below, m, v, 2)
        np.put_along_axis(above, m, v, 2)
        low, high = (np.stack(pair, 2).reshape(trees, -1, bounds.shape[1]) for pair in ((low, above), (below, high)))
    return Forest(np.concatenate(measure, 1), np.concatenate(value, 1), np.zeros((trees, 1 << depth)))


def grow(x: np.ndarray, more: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
    """The forest of rows in memory. x: measures of rows to split, in any order; more: of further rows that the ranges of the splits cover."""
    forest = planted(np.vstack((x, more)), trees, subsample, seed)
    forest.weigh(forest.rows_by_leaf(x), subsample)
    return forest


def _matrix(columns: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([columns.column(c).to_numpy() for c in names]).reshape(-1, len(names))


def ranges(counts: DataFrame) -> np.ndarray:
    """The least and the largest of each used measure over all rows, as two rows (none of an empty table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = measures(_matrix(batch, list(COUNTS)))[:, USED]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(USED)), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0))], ["m", "low", "high"])

    got = counts.select(*COUNTS).mapInArrow(run, "m int, low double, high double").groupBy("m").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("m").collect()
    return np.array([[r.low for r in got], [r.high for r in got]]).reshape(-1, len(USED))


def rows_by_leaf(counts: DataFrame, forest: Forest) -> np.ndarray:
    """How many different rows lie in each leaf of each tree. A task tells its counts in one row for each tree."""
    trees, leaves = forest.length.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((trees, leaves), dtype=np.int64)
        for batch in batches:
            rows += forest.rows_by_leaf(measures(_matrix(batch, list(COUNTS)))[:, USED])
        if rows.any():
            ends, at = np.concatenate(([0], np.count_nonzero(rows, 1).cumsum())).astype(np.int32), np.nonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), *(pa.ListArray.from_arrays(ends, x) for x in (at[1].astype(np.int32), rows[at]))], ["tree", "leaf", "n"])

    def add(told: pa.Table) -> pa.Table:
        rows = np.zeros(leaves, dtype=np.int64)
        np.add.at(rows, *(pa.compute.list_flatten(told[c]).to_numpy() for c in ("leaf", "n")))
        return pa.table({"tree": told["tree"][:1], "n": pa.array([rows], pa.list_(pa.int64()))})

    got = counts.select("doc_id", *COUNTS).distinct().mapInArrow(run, "tree int, leaf array<int>, n array<long>").groupBy("tree").applyInArrow(add, "tree int, n array<long>").toArrow()
    rows = np.zeros((trees, leaves), dtype=np.int64)
    rows[got["tree"].to_numpy()] = pa.compute.list_flatten(got["n"]).to_numpy().reshape(-1, leaves)
    return rows


def labelled_scores(counts: DataFrame, labels: DataFrame, forest: Forest) -> DataFrame:
    """score and label (0 or 1) of each different labelled row."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(measures(_matrix(batch, list(COUNTS)))[:, USED])), batch.column("label")], ["score", "label"])

    return counts.join(own, "doc_id").select("doc_id", *COUNTS, "label").distinct().mapInArrow(run, "score double, label int")


def calibrated(scored: DataFrame, false_reject: float) -> float:
    """Of the scores that at most so large a share of label 1 lies above, the one that has most of label 0 and least of label 1 above it, both as shares; the least of such."""
    steps = written(scored.groupBy("score").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).withColumn("cell", F.floor(F.col("score") * CELLS)), "rule-steps")
    cells = steps.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy(F.desc("cell")).toArrow()
    good, bad = (cells[c].to_numpy().astype(np.int64) for c in ("good", "bad"))
    n_good, n_bad = int(good.sum()), int(bad.sum())
    if not n_good or not n_bad:
        return 2.0
    spare = n_good - 1 - math.ceil((n_good - 1) * (1 - false_reject))
    over = np.column_stack((cells["cell"].to_numpy(), good.cumsum() - good, bad.cumsum() - bad))
    above = scored.sparkSession.createDataFrame([tuple(map(int, r)) for r in over[over[:, 1] <= spare]], "cell long, good_over long, bad_over long")
    before = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    summed = steps.join(F.broadcast(above), "cell").select("score", *(F.col(f"{c}_over") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("good", "bad"))).toDF("score", "good", "bad")
    return summed.where(F.col("good") <= spare).orderBy(F.desc(F.col("bad") * n_good - F.col("good") * n_bad), "score").first().score


def train(counts: DataFrame, labels: DataFrame, trees: int = 1000, subsample: int = 256, seed: int = 7, false_reject: float = 0.005) -> Forest:
    forest, passing = planted(ranges(counts), trees, subsample, seed), counts.where(PASSES)
    forest.weigh(rows_by_leaf(passing, forest), subsample)
    forest.threshold = calibrated(labelled_scores(passing, labels, forest), false_reject)
    return forest


def _verdicts(forest: Forest, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = base_failed(counts)
    anomaly = forest.score(measures(counts)[:, USED])
    return failed, anomaly, ~failed & (anomaly <= forest.threshold)


def judge(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """For each row: doc_id, the base statistics, base_failed, anomaly and kept."""
    counts = written(with_counts(docs), "rule-counts")
    forest = train(counts, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, anomaly, kept = _verdicts(forest, _matrix(batch, list(COUNTS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(x) for x in BASE), pa.array(failed), pa.array(anomaly), pa.array(kept)], ["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    return counts.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, anomaly double, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Texts are counted once and written with their counts."""
    columns, (with_own, names) = docs.columns, counted(docs)
    with_own = written(with_own, "rule-counted")
    forest = train(with_own.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(n).alias(c) for c, n in zip(COUNTS, names, strict=True))), labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(columns).filter(pa.array(_verdicts(forest, _matrix(batch, names))[2]))

    return with_own.mapInArrow(run, docs.schema)
