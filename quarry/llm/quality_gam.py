"""Quality classifier: an additive model with pairwise interactions, boosted cyclically from shallow trees.

Each tree sees one measure (or one pair of measures), cut into at most ``bins`` quantile bins, and adds its leaf
values to that measure's lookup table. A score is the sum of one table entry for each measure and each chosen pair.

Fitting sees at most ``fit_rows`` labelled rows (those with the smallest hash of doc_id) on the driver; everything
else runs on executors over all rows. Null and empty texts have all measures at zero and are scored like any text; very
long texts are measured whole. Null labels and labels without a document are ignored; rows that repeat a doc_id, its
measures and its label count once in fitting, and equal rows get equal scores. With no labels, or one class only, the
score is the smoothed share of label 1. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_sample, written
from quarry.llm.features import COUNTS, measures, with_counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), dtype=np.int64)

    def logit(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            out += g[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(self.binned(x)))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, rate: float, least: int, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree of at most so many leaves, grown best split first. g, h, n: sums by bin."""
    gain = lambda a, b: a * a / (b + 1.0)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            gl, hl, nl = (np.cumsum(a[lo:hi])[:-1] for a in (g, h, n))
            gt, ht, nt = g[lo:hi].sum(), h[lo:hi].sum(), n[lo:hi].sum()
            won = np.where((nl >= least) & (nt - nl >= least), gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht), 0)
            if won[k := int(won.argmax())] > best[0]:
                best = (won[k], lo + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = rate * g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut on each axis of a grid."""
    def four(a: np.ndarray) -> np.ndarray:
        c = a.cumsum(0).cumsum(1)
        ul = c[:-1, :-1]
        return np.stack([ul, c[:-1, -1:] - ul, c[-1:, :-1] - ul, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + ul])

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = four(g), four(h)
    won = (gs * gs / (hs + 1.0)).sum(0)
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    leaf = gs[:, i, j] / (hs[:, i, j] + 1.0)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(won[i, j] - g.sum() ** 2 / (h.sum() + 1.0)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, pairs: int = 8, rate: float = 0.2) -> AdditiveModel:
    """x: rows of measures; y: 0 or 1."""
    model = AdditiveModel(intercept=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, y, least = model.binned(x), y.astype(float), max(2, len(y) // 1000)
    f = np.full(len(y), model.intercept)
    counts = [np.bincount(b[:, j], minlength=len(t)) for j, t in enumerate(model.tables)]
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            p = _sigmoid(f)
            step = _tree(np.bincount(b[:, j], y - p, len(t)), np.bincount(b[:, j], p * (1 - p), len(t)), counts[j], rate, least)
            t += step
            f += step[b[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.tables[i]), len(model.tables[j])
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    p = _sigmoid(f)
    ranked = sorted(((_quadrants(*grid(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for won, i, j in ranked[:pairs] if won > 0]
    model.grids = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(rounds // 2):
        for (i, j), t in zip(model.pairs, model.grids, strict=True):
            p = _sigmoid(f)
            step = rate * _quadrants(*grid(i, j))[1]
            t += step
            f += step[b[:, i], b[:, j]]
    return model


def sample_of(counts: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Measures and labels of at most so many labelled rows; labels holds doc_id and the label only."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    joined = written(counts.join(own, "doc_id").select("doc_id", *COUNTS, "label"), "labelled-counts")
    got = hash_sample(joined, rows, joined.count(), "doc_id").select(*COUNTS, "label").toArrow()
    return measures(np.column_stack([got[c].to_numpy() for c in COUNTS]).reshape(-1, len(COUNTS))), got["label"].to_numpy().astype(int)


def classify(docs: DataFrame, train: DataFrame, fit_rows: int = 20_000, **options: float) -> DataFrame:
    """doc_id and the score of every row of docs. train: doc_id and quality of the rows to learn from."""
    counts = written(with_counts(docs), "gam-counts")
    model = fit(*sample_of(counts, train, "quality", fit_rows), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measures(np.column_stack([batch.column(c).to_numpy() for c in COUNTS]).reshape(-1, len(COUNTS)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return counts.mapInArrow(run, "doc_id long, score double")
