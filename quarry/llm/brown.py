"""Language-model scores by Brown's class-based bigrams: log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class).

1. A task reads its documents in blocks of about ``BLOCK`` bytes and numbers each block's words, so that shuffles carry a block's distinct words, not tokens.
   Counts of all words are summed over the whole corpus and brought back to the blocks.
2. Words are units: the ``CORE`` most frequent ones each, others by one of ``BUCKETS`` hash buckets, so a table of classes by unit has a fixed size.
   Words seen once make a class of their own, which stands for words never seen too.
3. Exchange clustering moves core words between classes, one by one, as long as the likelihood of class bigrams grows, on the counts of core
   bigrams (at most CORE * CORE numbers). Then each bucket goes to the class that gains most by the neighbours of all its occurrences.
4. Transitions between classes are counted over all training documents and smoothed with the classes' own frequencies. A word's share of its class is its
   count plus ``ADD``, so that for any class before, the probabilities of all known words and of one unknown word sum to one.

Before a text's first word stands its end token. Null and empty texts are their end token alone. Texts are read whole; a null doc_id is learned from. Repeated rows count each. Ties of counts go by the
bucket, ties of classes to the first. Without training documents all words are unknown. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, session_parallelism, slices, starts_of, written

#: Bytes of text in a block, and of text or of units that are worked on together; words in a row of a block's dictionary.
BLOCK, SLICE, WORDS = 16 << 20, 2 << 20, 4096
#: Neighbours of bucket words that a task sums before it sends them on.
EVENTS = 1 << 22
CORE, BUCKETS, CLASSES, SWEEPS = 1024, 1 << 20, 64, 12
#: What is added to each word's count; the weight, in tokens, of a class's own frequency in a transition.
ADD, PRIOR = 0.1, 10.0
#: The end token: no word holds a space.
END = b" "
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: bytes) -> list[bytes]:
    """The tokens of a text."""
    return [*text.translate(_LOWER).split(), END]


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes for each number, four more for those from 65535 on."""
    large = ids >= 0xFFFF
    return np.uint32(len(ids)).tobytes() + np.where(large, 0xFFFF, ids).astype("<u2").tobytes() + ids[large].astype("<u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ids = np.frombuffer(raw, "<u2", n, 4).astype(np.int64)
    ids[ids == 0xFFFF] = np.frombuffer(raw, "<u4", offset=4 + 2 * n)
    return ids


def _planes(units: np.ndarray) -> bytes:
    """Numbers below 2**24 as three planes of bytes."""
    return units.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _from_planes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, and where each row's begin."""
    rows = [np.frombuffer(raw, np.uint8).reshape(3, -1) for raw in column.to_pylist()]
    planes = np.concatenate([np.zeros((3, 0), np.uint8), *rows], 1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16, np.append(0, np.cumsum([r.shape[1] for r in rows], dtype=np.int64))


class _Block:
    """Documents of a block in the numbers of its words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows: list[tuple[int | None, bool, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int | None, held_out: bool, text: bytes) -> None:
        known = self.known
        self.rows.append((doc, held_out, np.array([known.setdefault(w, len(known)) for w in words_of(text)], np.int32)))
        self.size += len(text) + 1

    def batches(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents, and the words with their counts in training documents; frequent words get low numbers."""
        n = np.bincount(np.concatenate([r[2] for r in self.rows]), minlength=len(self.known))
        order = np.argsort(-n, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        learned = np.bincount(np.concatenate([np.zeros(0, np.int32), *(r[2] for r in self.rows if not r[1])]), minlength=len(self.known))[order]
        words = [*self.known]
        words = [words[i] for i in order.tolist()]
        for lo in range(0, len(self.rows), 1024):
            part = self.rows[lo : lo + 1024]
            yield pa.RecordBatch.from_pylist([{"block": number, "doc_id": d, "held_out": h, "tokens": _packed(place[ids])} for d, h, ids in part], schema)
        for lo in range(0, len(words), WORDS):
            yield pa.RecordBatch.from_pylist([{"block": number, "first": lo, "words": words[lo : lo + WORDS], "counts": learned[lo : lo + WORDS].tolist()}], schema)


_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))])


def blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of two kinds: documents (block, doc_id, held_out, tokens) and pieces of each block's dictionary (block, first, words, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in slices(batches, "text", SLICE):
            for doc, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), as_bytes(batch.column("text")), strict=True):
                block.add(doc, held, text)
                if block.size >= BLOCK:
                    yield from block.batches(number, _BLOCKS)
                    number, block = number + 1, _Block()
        if block.rows:
            yield from block.batches(number, _BLOCKS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "block long, doc_id long, held_out boolean, tokens binary, first int, words array<binary>, counts array<int>")


def counted(rows: DataFrame) -> DataFrame:
    """Of each word of each block: block, at (its number), c (its count in the training documents of the corpus), bucket, and once for each word, first."""
    pieces = rows.where("words IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w"))
    each = pieces.select("block", (F.col("first") + F.col("k")).alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    same = Window.partitionBy("word")
    bucket = (F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1))).cast("int")
    return each.select("block", "at", F.sum("n").over(same).alias("c"), bucket.alias("bucket"), (F.row_number().over(same.orderBy("block", "at")) == 1).alias("first"))


@dataclass
class Model:
    """N, V, words seen once, the core's counts and buckets, classes by unit, and log10 weights of class after class."""

    n: int
    v: int
    once: int
    core: list[tuple[int, int]]
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    masses: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def total(self) -> float:
        return self.n + ADD * (self.v + 1)

    def unit_of(self, word: bytes, c: int) -> int:
        """0 for words seen at most once, then the core, then buckets."""
        bucket = xxhash.xxh64_intdigest(word, seed=42) & (BUCKETS - 1)
        return 0 if c <= 1 else 1 + self.core.index((c, bucket)) if (c, bucket) in self.core else 1 + CORE + bucket

    def weights(self) -> np.ndarray:
        """log10 of P(class | class before) over the mass of the class, to which log10 of (count + ADD) adds up."""
        own = self.masses / self.masses.sum()
        p = (self.transitions + PRIOR * own) / (self.transitions.sum(1, keepdims=True) + PRIOR)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log10(p) - np.log10(self.masses)


def vocabulary(words: DataFrame) -> Model:
    """Totals and core of a table of counted words."""
    once = words.where("first AND c > 0")
    total = once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    top = once.where("c > 1").select("c", "bucket").orderBy(F.desc("c"), "bucket").limit(CORE).collect()
    return Model(total.n, total.v, total.once, [*dict.fromkeys((r.c, r.bucket) for r in top)])


def with_units(words: DataFrame, model: Model) -> DataFrame:
    """words with their units. The core is a table of at most CORE rows."""
    core = words.sparkSession.createDataFrame([(c, b, i + 1) for i, (c, b) in enumerate(model.core)], "c long, bucket int, core int")
    unit = F.when(F.col("c") <= 1, 0).when(F.col("core").isNotNull(), F.col("core")).otherwise(F.col("bucket") + 1 + CORE)
    return words.join(F.broadcast(core), ["c", "bucket"], "left").withColumn("unit", unit.cast("int"))


def coded(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Each document in units: doc_id, held_out, n_tokens, n_known, mass (the sum of log10(c + ADD)) and units. A block's dictionary and documents meet in one task, which holds
    the dictionary and streams the documents."""
    none = lambda kind: F.lit(None).cast(kind)
    left = words.select("block", "at", "unit", "c", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("binary").alias("tokens"))
    right = rows.where("tokens IS NOT NULL").select("block", F.lit(1 << 30).alias("at"), none("int").alias("unit"), none("long").alias("c"), "doc_id", "held_out", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        unit = count = np.zeros(0, np.int64)
        for batch in batches:
            keys = batch.column("block").to_numpy()
            bounds = starts_of(keys)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if keys[lo] != block:
                    block, parts = keys[lo], []
                part = batch.slice(lo, hi - lo)
                known = int(part.column("tokens").is_null().to_numpy(zero_copy_only=False).sum())
                if known:
                    parts.append([part.column(c).slice(0, known).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("unit", "c")])
                if known < len(part):
                    if parts:
                        unit, count = (np.concatenate(x) for x in zip(*parts, strict=True))
                        logs, parts = np.log10(count + ADD), []
                    docs = part.slice(known)
                    out = []
                    for raw in docs.column("tokens").to_pylist():
                        ids = _unpacked(raw)
                        out.append((len(ids), int((count[ids] > 0).sum()), float(logs[ids].sum()), _planes(unit[ids])))
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("held_out"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True))], ["doc_id", "held_out", "n_tokens", "n_known", "mass", "units"])

    n = session_parallelism(rows.sparkSession)
    met = left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", "at")
    return met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, mass double, units binary")


def _neighbours(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The units of texts, and the units before them; an end token comes before a text."""
    units, starts = _from_planes(column)
    before = np.roll(units, 1)
    full = starts[:-1] < starts[1:]
    before[starts[:-1][full]] = units[starts[1:][full] - 1]
    return before, units


def _summed(docs: DataFrame, size: int, keys) -> np.ndarray:
    """Counts of keys (a function of units before and units, to numbers below size) in the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in slices(batches, "units", SLICE):
            n += np.bincount(keys(*_neighbours(batch.column("units"))), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["key", "n"])

    found = docs.where("NOT held_out").select("units").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out


def core_bigrams(docs: DataFrame) -> np.ndarray:
    """How often a core word (row) comes before another (column)."""

    def keys(before: np.ndarray, units: np.ndarray) -> np.ndarray:
        both = (before > 0) & (before <= CORE) & (units > 0) & (units <= CORE)
        return (before[both] - 1) * CORE + units[both] - 1

    return _summed(docs, CORE * CORE, keys).reshape(CORE, CORE)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the log-likelihood of class bigrams that hangs on the classes."""
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def class_table(bigrams: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    member = np.eye(k)[classes]
    return member.T @ bigrams @ member


def exchange(bigrams: np.ndarray, k: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words by exchange: each word in turn goes where the likelihood gains most, until a sweep moves none or sweeps end. Words are
    in the order of their frequency; at first the most frequent k have a class each, others follow in turn."""
    size = len(bigrams)
    k = min(k, max(1, size))
    classes = np.arange(size) % k
    member = np.eye(k)[classes]
    right, left, table = bigrams @ member, bigrams.T @ member, class_table(bigrams, classes, k)
    every = np.arange(k)
    for _ in range(sweeps):
        moved = 0
        for w in range(size):
            after, before, own = right[w].copy(), left[w].copy(), bigrams[w, w]
            if not after.any() and not before.any():
                continue
            a = classes[w]
            after[a] -= own
            before[a] -= own
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= own
            rows, columns = table.sum(1) + before, table.sum(0) + after  # as they will be, but for the class that gets the word
            gain = (_f(table + after) - _f(table)).sum(1) + (_f(table + before[:, None]) - _f(table)).sum(0)
            corner = table[every, every]
            gain += _f(corner + after + before + own) - _f(corner + after) - _f(corner + before) + _f(corner)
            gain -= _f(rows + after.sum() + own) - _f(rows) + _f(columns + before.sum() + own) - _f(columns)
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 * (1 + abs(gain[a])) else a
            table[b] += after
            table[:, b] += before
            table[b, b] += own
            if b != a:
                moved += 1
                classes[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return classes


def bucket_classes(docs: DataFrame, core: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each bucket that occurs beside core words: the one whose bigrams with the core's classes gain most by its own. Others go by their number."""
    k = len(table)
    wide = 2 * k  # classes before, then classes after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [np.zeros(0, np.int64)], 0
        is_core = lambda x: (x > 0) & (x <= CORE)
        for batch in slices(batches, "units", SLICE):
            before, units = _neighbours(batch.column("units"))
            one, two = (units > CORE) & is_core(before), (before > CORE) & is_core(units)
            found += [(units[one] - 1 - CORE) * wide + core[before[one] - 1], (before[two] - 1 - CORE) * wide + k + core[units[two] - 1]]
            held += len(found[-1]) + len(found[-2])
            if held >= EVENTS:
                yield from _by_bucket(np.concatenate(found), wide)
                found, held = [np.zeros(0, np.int64)], 0
        yield from _by_bucket(np.concatenate(found), wide)

    def best(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of rising keys bucket * wide + slot and their counts."""
        rows, columns, corner = table.sum(1), table.sum(0), np.diag(table)
        bounds = starts_of(key // wide)
        for lo in range(0, len(bounds) - 1, 512):
            edge = bounds[lo : lo + 513]
            slot, count, at = key[edge[0] : edge[-1]] % wide, n[edge[0] : edge[-1]], edge[:-1] - edge[0]
            dense = np.zeros((len(at), wide))
            dense[np.repeat(np.arange(len(at)), np.diff(edge)), slot] = count
            before, after = dense[:, :k], dense[:, k:]
            was = np.where((slot < k)[:, None], table[slot % k], table.T[slot % k])
            gain = np.add.reduceat(_f(was + count[:, None]) - _f(was), at)
            gain += _f(corner + after + before) - _f(corner + after) - _f(corner + before) + _f(corner)
            gain -= _f(rows + before + after.sum(1, keepdims=True)) - _f(rows + before) + _f(columns + after + before.sum(1, keepdims=True)) - _f(columns + after)
            yield pa.RecordBatch.from_arrays([pa.array((key[edge[:-1]] // wide).astype(np.int32)), pa.array(gain.argmax(1).astype(np.int32))], ["bucket", "class"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            slots = batch.column("slots").to_pylist()
            bucket = np.repeat(batch.column("bucket").to_numpy().astype(np.int64), np.array([*map(len, slots)], np.int64))
            new = bucket * wide + np.frombuffer(b"".join(slots), np.uint8)
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4")
            key, at = np.unique(np.concatenate((key, new)), return_inverse=True)
            n = np.bincount(at, np.concatenate((n, counts)))
            cut = int(np.searchsorted(key, key[-1] // wide * wide)) if len(key) else 0  # the last bucket may go on
            yield from best(key[:cut], n[:cut])
            key, n = key[cut:], n[cut:]
        yield from best(key, n)

    n = session_parallelism(docs.sparkSession)
    seen = docs.where("NOT held_out").select("units").mapInArrow(run, "bucket int, slots binary, counts binary")
    chosen = seen.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(choose, "bucket int, class int").toArrow()
    out = np.arange(BUCKETS) % k
    out[chosen["bucket"].to_numpy()] = chosen["class"].to_numpy()
    return out


def _by_bucket(keys: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """Numbers bucket * wide + slot as a row for each bucket: its slots (a byte each) and how often they occur (four bytes each)."""
    key, n = np.unique(keys, return_counts=True)
    bounds = starts_of(key // wide)
    slots, counts = (key % wide).astype(np.uint8).tobytes(), n.astype("<u4").tobytes()
    cut = lambda raw, step: pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * step).astype(np.int32).tobytes()), pa.py_buffer(raw)])
    for lo in range(0, len(bounds) - 1, 10_000):
        at = slice(lo, min(lo + 10_000, len(bounds) - 1))
        yield pa.RecordBatch.from_arrays([pa.array((key[bounds[:-1]] // wide).astype(np.int32))[at], cut(slots, 1)[at], cut(counts, 4)[at]], ["bucket", "slots", "counts"])


def _class_masses(words: DataFrame, model: Model, k: int) -> np.ndarray:
    """Of each class, the sum of c + ADD over its words; an unknown word counts as one of the last."""
    classes = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k)
        for batch in batches:
            out += np.bincount(classes[batch.column("unit").to_numpy()], batch.column("c").to_numpy() + ADD, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(out)], ["class", "mass"])

    rows = words.where("first AND c > 1").select("unit", "c").mapInArrow(run, "class long, mass double").groupBy("class").agg(F.sum("mass").alias("mass")).collect()
    out = np.zeros(k)
    out[[r["class"] for r in rows]] = [r.mass for r in rows]
    out[k - 1] = model.once * (1 + ADD) + ADD
    return out


def fit(docs: DataFrame, held_out: Column) -> tuple[Model, DataFrame]:
    """The model of the documents that are not held out, and all documents in units."""
    rows = written(blocks(docs, held_out), "blocks")
    words = written(counted(rows), "words")
    model = vocabulary(words)
    words = with_units(words, model)
    texts = written(coded(rows, words), "coded")
    bigrams = core_bigrams(texts)[: len(model.core), : len(model.core)]
    core = exchange(bigrams)
    k = CLASSES
    own = bucket_classes(texts, np.append(core, np.zeros(CORE - len(core), np.int64)), class_table(bigrams, core, k) if len(core) else np.zeros((k, k)))
    model.classes = np.concatenate(([k], core, np.zeros(CORE - len(core), np.int64), own)).astype(np.uint8)
    classes = model.classes
    model.transitions = _summed(texts, (k + 1) ** 2, lambda before, units: classes[before].astype(np.int64) * (k + 1) + classes[units]).reshape(k + 1, k + 1)
    model.masses = _class_masses(words, model, k + 1)
    return model, texts


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, ADD added to each count) and score of documents in units."""
    classes, weights, k = model.classes, model.weights().ravel(), len(model.masses)
    each = math.log10(model.total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "units", SLICE):
            if not batch.num_rows:
                continue
            before, units = _neighbours(batch.column("units"))
            sums = np.append(0, np.cumsum(weights[classes[before].astype(np.int64) * k + classes[units]]))
            n = batch.column("n_tokens").to_numpy()
            ends = np.append(0, np.cumsum(n))
            mass = batch.column("mass").to_numpy()
            score = np.array([sums[hi] - sums[lo] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]) + mass
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(n), model.n)), pa.array(mass - n * each), pa.array(score)], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """By fold: documents, tokens, and the perplexities of the model and of unigrams."""
    by = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), by("score").alias("perplexity"), by("base_score").alias("base_perplexity"))
