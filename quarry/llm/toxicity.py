"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words, in lower case and without outer punctuation, and their beginnings of ``PREFIX`` letters, so that an
inflected word shares a term with its kin. The vocabulary holds all terms of the examples. A term weighs its idf times its significance: how far its presence goes with the label among the examples, against what
chance would give any of the candidates (log-likelihood ratio over 2 ln(candidates) + ``MARGIN``, squared; 1 from
there on, ``FLOOR`` at least, so that no term is left out). Document frequencies cover all documents. Examples are at
most ``per_class`` labelled documents of each label; they are the index, so what is broadcast has a fixed bound. They
are the first of the ``DRAWN * per_class`` of each label with the smallest hash of doc_id; of copies and near copies
(equal least shingle hashes) one is drawn, else the words of a much-copied text would pass for signs of its label.
All drawn documents, examples or not, serve to calibrate.

The index holds a posting list for each term, in blocks of ``BLOCK`` neighbouring examples, with the largest weight of
each block. A query bounds each block by these maxima, adds up the postings of the ``EAGER`` best blocks, and then
those of all other blocks whose bound reaches the k-th best sum: the k neighbours are exact, ties going to the earlier
example. Their votes are weighted by 1 / (distance + 0.05) and by class, so that the sampling of examples does not
shift them, and the vote is mapped to a score by isotonic regression over the votes of the drawn documents, each without itself.

A text without any term of the vocabulary, such as a null or empty one, gets the share of label 1 among such
examples. Null labels and labels without a document are ignored, repeated labels count once; without labels every
score is 0.5. Very long texts are read whole, in batches of about ``SLICE`` bytes or of one text. Empty tables give no
rows. Repeated rows get equal scores, null doc_id is kept, extra columns, whatever their names, are ignored by scored()
and kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MIX, hash_sample, session_parallelism, slices, written

PREFIX, BLOCK, EAGER, MARGIN, FLOOR, LEAST_DOCS, DRAWN, SLICE = 5, 32, 8, 4.0, 0.02, 3, 4, 1 << 21
_OUTER = ".,;:!?\"'()[]{}<>-_*#$%&|…«»„“”"
#: Of the share of the bar that a term's ratio reaches: terms that chance could give weigh little.
POWER = 2
SCORED = "doc_id long, score double, evidence array<struct<doc_id: long, toxic: int, similarity: double>>"


def terms_of(word: str) -> tuple[str, ...]:
    """The one or two terms of a lower-case word; a prefix carries a mark that no word begins with."""
    bare = word.strip(_OUTER)
    return (bare, f"\x00{bare[:PREFIX]}") if len(bare) >= PREFIX else (bare,) if bare else ()


def term_counts(texts: pa.Array, ids: dict[str, int], grow: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts by text, and each text's ids in rising order with their numbers of occurrences. Terms without an id get one if grow is set, else they are left out."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    encoded = lists.flatten().dictionary_encode()
    of_word = np.full((max(1, len(encoded.dictionary)), 2), -1)
    for i, word in enumerate(encoded.dictionary.to_pylist()):
        for j, term in enumerate(terms_of(word)):
            of_word[i, j] = ids.setdefault(term, len(ids)) if grow else ids.get(term, -1)
    own, n = of_word[encoded.indices.to_numpy(zero_copy_only=False)], max(1, len(ids))
    rows = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    keys, counts = np.unique((rows[:, None] * n + own)[own >= 0], return_counts=True)
    return np.searchsorted(keys, np.arange(len(texts) + 1) * n), keys % n, counts


class Terms:
    """Vocabulary terms of texts."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {t: i for i, t in enumerate(vocabulary)}

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return term_counts(texts, self.ids)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@dataclass
class BlockMaxIndex:
    """rows: unit vectors of the examples, one row each, as (ids, weights)."""

    size: int
    rows: list[tuple[np.ndarray, np.ndarray]]
    n: int = 0
    _built: tuple[np.ndarray, ...] | None = None

    def __post_init__(self) -> None:
        self.n = len(self.rows)

    def __getstate__(self) -> dict:
        """Tasks get the lists only."""
        return {"size": self.size, "rows": [], "n": self.n, "_built": self._lists()}

    def _lists(self) -> tuple[np.ndarray, ...]:
        """Blocks of all posting lists, term after term: where a term's blocks start, each block's number, largest weight and first posting; examples and weights of the postings."""
        if self._built is None:
            terms, weights = (np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0, kind) for i, kind in ((0, np.int64), (1, np.float64)))
            examples = np.repeat(np.arange(len(self.rows)), [len(r[0]) for r in self.rows])
            order = np.lexsort((examples, terms))
            terms, examples, weights = terms[order], examples[order], weights[order]
            key = terms * (len(self.rows) // BLOCK + 1) + examples // BLOCK
            first = np.flatnonzero(np.diff(key, prepend=-1))
            most = np.maximum.reduceat(weights, first) if len(first) else weights
            starts = np.searchsorted(terms[first], np.arange(self.size + 1))
            self._built = starts.astype(np.int32), (examples[first] // BLOCK).astype(np.int32), most, np.append(first, len(key)).astype(np.int32), examples.astype(np.int32), weights
        return self._built

    def search(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine and these cosines, in falling order."""
        starts, blocks, most, first, examples, values = self._lists()
        n = self.n
        lengths = (starts[ids + 1] - starts[ids]).astype(np.int64)
        at, own = spread(starts[ids], lengths), np.repeat(weights, lengths)
        block = blocks[at]
        bound = np.bincount(block, most[at] * own, -(-n // BLOCK))
        turn = np.argsort(-bound)
        sums, done = np.zeros(n), np.zeros(len(bound), dtype=bool)

        def add(chosen: np.ndarray) -> None:
            mine = np.zeros(len(bound), dtype=bool)
            mine[chosen] = True
            hit = mine[block]
            lo = first[at[hit]].astype(np.int64)
            sizes = first[at[hit] + 1] - lo
            posting = spread(lo, sizes)
            np.add(sums, np.bincount(examples[posting], values[posting] * np.repeat(own[hit], sizes), n), out=sums)
            done[chosen] = True

        add(turn[:EAGER])
        least = np.partition(sums, n - k)[n - k] if n > k else 0.0
        rest = turn[EAGER:]
        rest = rest[(bound[rest] > 0) & (bound[rest] >= least - 1e-9)]
        if len(rest):
            add(rest)
        found = np.flatnonzero(sums >= max(least - 1e-9, 1e-300))
        keep = found[np.lexsort((found, -sums[found]))[:k]]
        return keep, sums[keep]


@dataclass
class Model:
    vocabulary: list[str] = field(default_factory=list)
    #: Of each term, idf times significance.
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: BlockMaxIndex | None = None
    doc_ids: list[int] = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    class_weights: np.ndarray = field(default_factory=lambda: np.ones(2))
    bare: float = 0.5
    steps: tuple[np.ndarray, np.ndarray] | None = None
    k: int = 15
    _terms: Terms | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_terms": None, "vocabulary": self.vocabulary or list(self._terms.ids if self._terms else [])}

    @property
    def terms(self) -> Terms:
        """Of a task: the list of terms is let go once they have numbers."""
        if self._terms is None:
            self._terms, self.vocabulary = Terms(self.vocabulary), []
        return self._terms

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weights[ids]
        return ids, w / max(np.sqrt((w * w).sum()), 1e-12)

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = self.class_weights[self.labels[found]] / (1 - np.minimum(cosine, 1) + 0.05)
        return float((w * self.labels[found]).sum() / w.sum())

    def judge(self, texts: pa.Array, most: int = 3) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of the texts, and of each the nearest examples, so many at most."""
        starts, ids, counts = self.terms.count(texts)
        scores, evidence = np.full(len(texts), self.bare), [[] for _ in range(len(texts))]
        for i in np.flatnonzero(np.diff(starts)):
            mine = slice(starts[i], starts[i + 1])
            found, cosine = self.index.search(*self.vector(ids[mine], counts[mine]), self.k)
            if len(found):
                scores[i] = np.interp(self.vote(found, cosine), *self.steps)
                evidence[i] = [{"doc_id": self.doc_ids[j], "toxic": int(self.labels[j]), "similarity": float(c)} for j, c in zip(found[:most], cosine, strict=False)]
        return scores, evidence


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising function fitted to weighted labels, each level smoothed by half a row of either label."""
    levels: list[list[float]] = []
    for v in np.unique(x):
        at = x == v
        levels.append([v, v, (w[at] * y[at]).sum(), w[at].sum(), at.sum()])
        while len(levels) > 1 and levels[-2][2] * levels[-1][3] >= levels[-1][2] * levels[-2][3]:
            b, a = levels.pop(), levels.pop()
            levels.append([a[0], b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4]])
    got = [(p, (s / t * n + 0.5) / (n + 1)) for lo, hi, s, t, n in levels for p in ((lo, hi) if hi > lo else (lo,))]
    return np.array([g[0] for g in got]), np.maximum.accumulate([g[1] for g in got])


def sketch(text: str) -> tuple[int, int]:
    """Two least hashes of the three-word shingles, which near copies mostly share."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    shingles = hashes[:-2] * MIX[0] + hashes[1:-1] * MIX[1] + hashes[2:] if len(hashes) > 2 else hashes[:1]
    if not len(shingles):
        return 0, 0
    return tuple(int((((shingles ^ (shingles >> np.uint64(29))) * m) >> np.uint64(1)).min()) for m in MIX[1:])


def distinct_rows(labelled: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic and two hashes, to sort by, of at most so many rows of each label, none a near copy of another by its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = zip(*(sketch(x or "") for x in batch.column("text").to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int64()), pa.array(b, pa.int64())], [*batch.schema.names, "s0", "s1"])

    rows = labelled.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, s0 long, s1 long").withColumn("h", F.xxhash64("doc_id")).withColumn("h2", F.xxhash64("text"))
    columns = ["doc_id", "text", "s0", "s1", "h", "h2"]
    for s in ("s0", "s1"):
        rows = rows.groupBy("toxic", s).agg(F.min_by(F.struct(*columns), F.struct("h", "h2")).alias("r")).select("toxic", *(f"r.{c}" for c in columns))
    by_class = [rows.where(F.col("toxic") == y).orderBy("h", "h2").limit(most) for y in (0, 1)]
    return by_class[0].unionByName(by_class[1]).select("doc_id", "text", "toxic", "h", "h2")


def _term_counts(examples: DataFrame) -> DataFrame:
    """term and the numbers of examples with label 0 and 1 that hold it; tasks add up what they read first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            terms: dict[str, int] = {}
            starts, ids, _ = term_counts(batch.column("text"), terms, grow=True)
            label = np.repeat(batch.column("toxic").to_numpy(), np.diff(starts))
            counts = [np.bincount(ids[label == y], minlength=len(terms)) for y in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["term", "n0", "n1"])

    return examples.mapInArrow(run, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _frequencies(docs: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """In how many of all documents each term of the vocabulary is."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(sent.value), np.zeros(len(sent.value), dtype=np.int64)
        for batch in slices(batches, "text", SLICE):
            n += np.bincount(terms.count(batch.column("text"))[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["term", "n"])

    out = np.zeros(len(vocabulary))
    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, k: int = 15) -> Model:
    """labels: doc_id and toxic of the rows to learn from."""
    own = written(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").distinct(), "toxic-labels")
    totals = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    chosen = [hash_sample(own.where(F.col("toxic") == y), DRAWN * per_class, totals.get(y, 0)) for y in (0, 1)]
    # at most 2 * DRAWN * per_class rows
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    distinct = written(distinct_rows(written(drawn, "drawn"), DRAWN * per_class), "distinct-drawn")
    order = sorted((r.toxic, r.h, r.h2) for r in distinct.select("toxic", "h", "h2").collect())
    last = [([x for x in order if x[0] == y][:per_class] or [(y, 0, 0)])[-1] for y in (0, 1)]
    sample = distinct.where(" or ".join(f"toxic = {y} and (h < {h} or h = {h} and h2 <= {h2})" for y, h, h2 in last))
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    model = Model(k=k, bare=totals.get(1, 0) / sum(totals.values()) if totals else 0.5)
    if not n0 or not n1:
        return model
    terms = written(_term_counts(sample), "terms")
    entropy = lambda *cells: sum(F.when(c > 0, c * F.log(c / t)).otherwise(0.0) for c, t in cells)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    with_, without = a + b, n0 + n1 - a - b
    g = 2 * entropy((a, with_ * n1 / (n0 + n1)), (b, with_ * n0 / (n0 + n1)), (n1 - a, without * n1 / (n0 + n1)), (n0 - b, without * n0 / (n0 + n1)))
    bar = 2 * float(np.log(max(terms.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).count(), 1))) + MARGIN
    ranked = terms.select("term", g.alias("g")).toArrow()  # of at most 2 * per_class texts
    ranked = ranked.take(pc.sort_indices(ranked, [("g", "descending"), ("term", "ascending")]))
    model.vocabulary = ranked["term"].to_pylist()
    df = _frequencies(docs, model.vocabulary)
    significance = np.clip(ranked["g"].to_numpy() / bar, 0, 1) ** POWER
    model.weights = (np.log((1 + docs.count()) / (1 + df)) + 1) * np.maximum(significance, FLOOR)
    sent = docs.sparkSession.sparkContext.broadcast(model.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(sent.value)
        for batch in slices(batches, "text", SLICE):
            starts, ids, counts = known.count(batch.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(x.astype(np.int64))) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "terms", "counts"])

    got = sample.mapInArrow(count, "doc_id long, toxic int, terms array<long>, counts array<long>").toArrow()
    doc_ids, toxic = got["doc_id"].to_pylist(), got["toxic"].to_numpy()
    flat = [got[c].combine_chunks() for c in ("terms", "counts")]
    at = np.concatenate(([0], np.cumsum(flat[0].value_lengths().to_numpy(zero_copy_only=False))))
    ids, counts = (x.flatten().to_numpy() for x in flat)
    bare = toxic[np.diff(at) == 0]
    share = np.array([totals[0] / n0, totals[1] / n1])
    ones, zeros = bare.sum() * share[1], (len(bare) - bare.sum()) * share[0]
    model.bare = float((ones + model.bare) / (ones + zeros + 1))
    model.class_weights = share / share.mean()
    # neighbours in the order share their most telling terms and meet in blocks, which makes their bounds tight
    order = sorted(np.flatnonzero(np.diff(at)), key=lambda i: (tuple(ids[at[i] : min(at[i] + 4, at[i + 1])]), doc_ids[i]))
    vectors = [model.vector(ids[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]) for i in order]
    model.index, model.doc_ids, model.labels = BlockMaxIndex(len(model.vocabulary), vectors), [doc_ids[i] for i in order], toxic[order].astype(int)
    model.steps = isotonic(*_votes(distinct, model, totals))
    return model


def _votes(drawn: DataFrame, model: Model, totals: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the drawn rows, the vote of their nearest examples but themselves, label and weight."""
    sent = drawn.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text", SLICE):
            starts, ids, counts = own.terms.count(batch.column("text"))
            votes = np.full(batch.num_rows, own.bare)
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                mine = slice(starts[i], starts[i + 1])
                found, cosine = own.index.search(*own.vector(ids[mine], counts[mine]), own.k + 1)
                others = [j for j, x in enumerate(found) if own.doc_ids[x] != doc][: own.k]
                if others:
                    votes[i] = own.vote(found[others], cosine[others])
            yield pa.RecordBatch.from_arrays([pa.array(votes), batch.column("toxic")], ["vote", "toxic"])

    got = drawn.select("doc_id", "text", "toxic").repartition(session_parallelism(drawn.sparkSession)).mapInArrow(run, "vote double, toxic int").toArrow()
    votes, labels = got["vote"].to_numpy(), got["toxic"].to_numpy()
    weights = np.array([totals[y] / max(1, (labels == y).sum()) for y in (0, 1)])
    order = np.lexsort((labels, votes))
    return votes[order], labels[order], weights[labels][order]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (the nearest examples) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            scores, evidence = sent.value.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def accepted(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below limit, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield batch.filter(pa.array(sent.value.judge(batch.column("text"), 0)[0] < limit))

    return docs.mapInArrow(run, docs.schema)
