"""Embedding near-duplicates by cross-polytope hashing, exact links and their components.

A vector is rotated three times by random signs and a fast Hadamard transform; its hash is the coordinate of largest magnitude with
its sign. A table hashes with ``hashes`` rotations and probes, for each, the ``probes`` best coordinates, so a vector lies in
``probes ** hashes`` buckets of each of ``tables`` tables. Vectors that share a bucket and a label are candidates.

Equal vectors of a label are merged first and counted with their number. A bucket verifies its candidates by their cosines in double
precision, and yields the edges of a spanning forest of the links, never all pairs. Linked vectors are in one component, so
links are then counted within components, each pair once, which also finds links between vectors that share no bucket. Buckets and
components of over ``block`` vectors are split into blocks, each pair of blocks being a group of its own, and compared by matrix products.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing and are components
of their own. Vectors of other lengths than a label's others never link with them. A null vec_id gets no component and is not kept;
rows that repeat a vec_id are vectors of their own for n_links and one node for components. Of ties (equal vectors) the
smallest vec_id stands for all. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MIX, session_parallelism, starts_of, whole_groups, written
from quarry.llm.components import components

#: Rows of a matrix product; groups of so few vectors are compared pair by pair; cosines so near the limit are computed again.
TILE, FEW, CLOSE = 512, 8, 1e-9


@lru_cache(maxsize=64)
def _signs(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([size, count, seed]).choice([-1.0, 1.0], (count, 3, size))


@lru_cache(maxsize=16)
def _hadamard(size: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(size)


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x, whose length is a power of two, after three rounds of signs and fast Hadamard transform: along both axes of a near-square
    arrangement of the coordinates, which stays turned over."""
    n, d = x.shape
    high = 1 << (d.bit_length() - 1) // 2
    for s in signs:
        half = (x * s).reshape(-1, d // high) @ _hadamard(d // high)
        x = (half.reshape(n, high, d // high).transpose(0, 2, 1).reshape(-1, high) @ _hadamard(high)).reshape(n, d)
    return x


def _largest(y: np.ndarray, k: int) -> np.ndarray:
    """Of each row, the places of its k largest magnitudes, in falling order."""
    size, rows, out = np.abs(y), np.arange(len(y)), []
    for _ in range(k):
        out.append(size.argmax(1))
        size[rows, out[-1]] = -1
    return np.stack(out, 1)


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 11) -> np.ndarray:
    """Bucket numbers of unit rows, tables * probes ** hashes for each; equal numbers only within a table."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs, probes = _signs(d, tables * hashes, seed), min(probes, d)
    out = []
    for t in range(tables):
        best = []
        for h in range(hashes):
            y = rotated(x, signs[t * hashes + h])
            top = _largest(y, probes)
            best.append(2 * top + (np.take_along_axis(y, top, 1) > 0))
        for choice in product(range(probes), repeat=hashes):
            number = np.full(len(x), t, dtype=np.int64)
            for h, c in enumerate(choice):
                number = number * (2 * d) + best[h][:, c]
            out.append(number)
    return np.stack(out, 1) if out else np.zeros((len(x), 0), np.int64)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length: their places and, as a matrix, their values (null: not a number)."""
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), 0)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, np.asarray(flat, dtype=float).reshape(-1, d)


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length that hold a direction: their places and unit vectors."""
    for at, x in _by_length(vectors):
        top = np.abs(x).max(1)
        good = np.isfinite(x).all(1) & (top > 0)
        x = x[good] / top[good, None]
        yield at[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def _dots(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[i], x[j])


def _tiles(n: int) -> Iterator[tuple[slice, slice]]:
    for lo in range(0, n, TILE):
        for lo2 in range(lo, n, TILE):
            yield slice(lo, lo + TILE), slice(lo2, lo2 + TILE)


def _forest(x: np.ndarray, limit: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among unit rows."""
    root, a, b = np.arange(len(x)), [], []
    for rows, columns in _tiles(len(x)):
        i, j = np.nonzero((x[rows] @ x[columns].T >= limit - CLOSE) & (root[rows, None] != root[None, columns]))
        i, j = i + rows.start, j + columns.start
        exact = (i < j) & (_dots(x, i, j) >= limit) if len(i) else i < j
        i, j = i[exact], j[exact]
        while len(i):  # union of the trees that these links join, a few edges at a time
            u, v = root[i], root[j]
            apart = u != v
            i, j, u, v = i[apart], j[apart], u[apart], v[apart]
            if not len(i):
                break
            high, low = np.maximum(u, v), np.minimum(u, v)
            _, at = np.unique(high, return_index=True)
            a += i[at].tolist()
            b += j[at].tolist()
            root[high[at]] = low[at]
            while (root[root] != root).any():
                root = root[root]
    return a, b


def _counts(x: np.ndarray, copies: np.ndarray, block: np.ndarray, cross: bool, limit: float) -> np.ndarray:
    """Of each unit row, the copies of the other rows that it links with; in a group of two blocks (cross), of those of the other block."""
    out = np.zeros(len(x), dtype=np.int64)
    for rows, columns in _tiles(len(x)):
        cosine = x[rows] @ x[columns].T
        hit = cosine >= limit
        near = np.nonzero(np.abs(cosine - limit) < CLOSE)
        if len(near[0]):
            hit[near] = _dots(x, near[0] + rows.start, near[1] + columns.start) >= limit
        if cross:
            hit &= block[rows, None] != block[None, columns]
        if rows == columns:
            np.fill_diagonal(hit, False)
        else:
            out[columns] += copies[rows] @ hit
        out[rows] += hit @ copies[columns]
    return out


def _blocked(rows: DataFrame, place: str, size: str, block: int) -> DataFrame:
    """rows (rep, place and the size of the place) with the columns block and cross; places of over block rows become one for each pair of their blocks."""
    dealt = rows.withColumn("blocks", F.ceil(F.col(size) / block).cast("int"))
    split = dealt.where("blocks > 1").withColumn("block", F.pmod("rep", "blocks").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    split = split.withColumn(place, F.xxhash64(place, F.least("block", "other"), F.greatest("block", "other"))).withColumn("cross", F.col("block") != F.col("other"))
    whole = dealt.where("blocks = 1").withColumn("block", F.lit(0)).withColumn("cross", F.lit(False))
    return whole.select("rep", place, "block", "cross").unionByName(split.select("rep", place, "block", "cross"))


def near_duplicates(rows: DataFrame, limit: float = 0.98, tables: int = 4, hashes: int = 3, probes: int = 2, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    n = session_parallelism(rows.sparkSession)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """rep: a hash of label and direction; null for vectors that link with nothing."""
        for batch in batches:
            labels, reps = batch.column("label").to_pylist(), [None] * batch.num_rows
            for at, x in _units(batch.column("embedding")):
                for i, v in zip(at.tolist(), x + 0.0, strict=True):
                    if labels[i] is not None:
                        reps[i] = xxhash.xxh3_64_intdigest(v.tobytes() + labels[i].encode()) - (1 << 63)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("embedding"), pa.array(reps, pa.int64())], ["vec_id", "label", "embedding", "rep"])

    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = rows.schema["embedding"].dataType.simpleString()
    own = written(kept.mapInArrow(told, "vec_id long, label string, embedding array<double>, rep long").withColumn("embedding", F.when(F.col("rep").isNotNull(), F.col("embedding").cast(kind))), "vectors")
    # one row for each different vector of a label
    texts = own.where("rep IS NOT NULL").groupBy("rep").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    texts = written(texts, "distinct-vectors")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, label = (batch.column(c).to_numpy() for c in ("rep", "label"))
            reps, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, x in _units(batch.column("embedding")):
                numbers = buckets(x, tables, hashes, probes)
                reps.append(np.repeat(rep[at], numbers.shape[1]))
                places.append(((numbers ^ (label[at, None] * 31 + x.shape[1])).view(np.uint64) * MIX[0]).view(np.int64).reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(places))], ["rep", "place"])

    places = texts.select("rep", F.xxhash64("label").alias("label"), "embedding").mapInArrow(deal, "rep long, place long")
    full = written(places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1"), "places")
    vectors = texts.select("rep", "copies", "embedding")

    def groups(batches: Iterator[pa.RecordBatch], place: str) -> Iterator[tuple]:
        """Unit vectors of whole groups, with the starts of the groups and their rows in order."""
        for table in whole_groups(batches, place):
            vectors = table["embedding"].combine_chunks()
            columns = {c: table[c].to_numpy() for c in ("rep", place, "copies", "block", "cross") if c in table.column_names}
            for at, x in _units(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors):
                yield x, {c: v[at] for c, v in columns.items()}

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, own in groups(batches, "place"):
            rep, place = own["rep"], own["place"]
            starts = starts_of(place)
            sizes = np.diff(starts)
            few = np.repeat(sizes <= FEW, sizes)
            a, b = [], []
            for d in range(1, FEW):
                i = np.flatnonzero((place[d:] == place[:-d]) & few[d:])
                if not len(i):
                    break
                i = i[_dots(x, i, i + d) >= limit]
                a.append(i)
                b.append(i + d)
            for k in np.flatnonzero(sizes > FEW):
                i, j = _forest(x[starts[k] : starts[k + 1]], limit)
                a.append(np.array(i, np.int64) + starts[k])
                b.append(np.array(j, np.int64) + starts[k])
            a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, own in groups(batches, "group"):
            starts, links = starts_of(own["group"]), np.zeros(len(x), dtype=np.int64)
            for lo, hi in zip(starts, starts[1:]):
                links[lo:hi] = _counts(x[lo:hi], own["copies"][lo:hi], own["block"][lo:hi], bool(own["cross"][lo]), limit)
            yield pa.RecordBatch.from_arrays([pa.array(own["rep"]), pa.array(links)], ["rep", "links"])

    shared = _blocked(places.join(full, "place"), "place", "n", block).select("rep", "place").join(vectors, "rep")
    linked = written(shared.repartition(n, "place").sortWithinPartitions("place").mapInArrow(link, "a long, b long").distinct(), "links")
    # rows that repeat a vec_id are one node
    repeated = own.where("vec_id IS NOT NULL AND rep IS NOT NULL").groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b != last").select("vec_id", "b")
    same = own.where("rep IS NOT NULL").join(repeated, "vec_id").select(F.col("rep").alias("a"), "b")
    parts = components(linked.unionByName(same)).withColumnRenamed("node", "rep")
    # a component may span labels through repeated vec_ids
    members = parts.join(texts.select("rep", "label"), "rep").select("rep", F.xxhash64("component", "label").alias("group"))
    sizes = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    counted = _blocked(members.join(sizes, "group"), "group", "n", block).join(vectors, "rep").repartition(n, "group").sortWithinPartitions("group").mapInArrow(count, "rep long, links long")
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    least = texts.select("rep", "first").join(parts, "rep").groupBy("component").agg(F.min("first").alias("least"))
    by_text = texts.select("rep", "first", "copies").join(parts.join(least, "component").select("rep", "least"), "rep", "left").join(links, "rep", "left")
    by_text = by_text.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component"))
    got = own.select("vec_id", "rep").join(by_text, "rep", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
