"""SimHash near-duplicates: exact links at a few differing bits, found by a grid join of popcount embeddings.

A fingerprint is embedded as the vector of bit counts of its 2-bit segments. The Manhattan distance of two such
vectors is a lower bound of their Hamming distance. The segments are dealt into ``groups`` runs; if two vectors lie
within distance r, at least ``groups - r`` runs of theirs are equal, so both fall into the same unit cell of the grid
over some ``groups - r`` runs (how many runs there are hangs on the number of fingerprints). Each fingerprint enters one cell for each such choice of runs, cells are joined, pairs
beyond Manhattan distance r are dropped, and the rest are verified by their exact Hamming distance.

Equal fingerprints are merged first. A cell yields the edges of a spanning forest of its links, never all pairs, and
cells of over ``block`` fingerprints are split into blocks, each pair of blocks being a cell of its own.

Null and empty texts, and texts without words, have fingerprint zero and link like any other. Null doc_ids get a
fingerprint but no component; repeated doc_ids are one node, linked to all that any of their rows links to. Very long
texts are hashed whole; an empty table gives no rows; of ties the smallest doc_id names the component; extra columns,
whatever their names, are ignored by near_duplicates() and kept by one_of_each() and one_of_alike().

one_of_alike() looks for texts that are alike rather than for near fingerprints: its links are pairs whose sets of shingles have
a Jaccard similarity of at least ``similarity``. Texts get several fingerprints, whose cells, Manhattan bounds and Hamming
distances yield groups of candidates; each group is then verified exactly, all its pairs, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import MIX, as_bytes, fresh, row_key, session_parallelism, starts_of, whole_groups, written
from quarry.llm.components import components, spanning, stars


def fingerprint(text: bytes, k: int = 4) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes (seed 42) of the lower-cased text's k-word shingles."""
    return int(majority(shingles(text, k)))


def shingles(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a lower-cased text, repeats included; of fewer words, of all of them; of none, none."""
    joined = text.lower().split()
    n = max(min(len(joined), 1), len(joined) - k + 1)
    if n < 2:
        return np.array([xxhash.xxh64_intdigest(b" ".join(joined), 42)] * n, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    whole, digest = b" ".join(joined), xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], 42) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes set."""
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """docs with a long column fp (the fingerprint's bits, signed) in the place of text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, k) for x in as_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps.view(np.int64))], [*rest, "fp"])

    schema = docs.select(*rest).schema.add("fp", "long")
    return docs.select(*rest, "text").mapInArrow(run, schema)


def embedded(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, each in its own two bits of a word."""
    odd = np.uint64(0x5555555555555555)
    return (fps & odd) + ((fps >> np.uint64(1)) & odd)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of embeddings: 2-bit lanes differ by 0, 1 or 2."""
    odd = np.uint64(0x5555555555555555)
    low, high = (a ^ b) & odd, ((a ^ b) >> np.uint64(1)) & odd
    # lanes hold 0, 1 or 2: 0-1 and 1-2 differ in the low bit (distance 1), 0-2 in the high bit only (distance 2)
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low).astype(np.int64)


def _cells(fps: np.ndarray, radius: int, groups: int) -> np.ndarray:
    """One cell for each choice of groups - radius runs of segments; rows are choices."""
    lanes = embedded(fps)
    edges = np.linspace(0, 32, groups + 1).astype(int)
    masks = [sum(3 << (2 * s) for s in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    out = []
    for n, runs in enumerate(combinations(range(groups), groups - radius)):
        x = lanes & np.uint64(sum(masks[g] for g in runs))
        x = (x ^ (x >> np.uint64(31)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27)) ^ np.uint64(n << 32)) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    ok = manhattan(embedded(a), embedded(b)) <= radius
    ok[ok] = np.bitwise_count(np.broadcast_to(a, ok.shape)[ok] ^ np.broadcast_to(b, ok.shape)[ok]) <= radius
    return ok


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints: breadth first, each step against all that are not reached."""
    left, a, b = fps, [], []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        hit = _near(np.array([x]), left, radius)
        if hit.any():
            found, left = left[hit], left[~hit]
            a.append(np.full(len(found), x))
            b.append(found)
            queue += list(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def runs_for(fingerprints: int, radius: int) -> int:
    """Into how many runs to deal the segments. More runs make more cells for each fingerprint, but smaller ones; any number above the radius finds all links."""
    groups = radius + 2
    # a segment's bit count is worth about a bit and a half
    while groups < 2 * radius + 2 and 48 * (groups - radius) / groups < np.log2(max(1, fingerprints)) - 6:
        groups += 2
    return groups


def links(distinct: DataFrame, radius: int = 4, groups: int | None = None, block: int = 4096) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp): they connect what links of at most radius bits connect."""
    n = session_parallelism(distinct.sparkSession)
    groups = groups or runs_for(distinct.count(), radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            cells = _cells(fps, radius, groups)
            yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).view(np.int64)), pa.array(np.tile(fps.view(np.int64), len(cells)))], ["cell", "fp"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cell, fps = table["cell"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            at = starts_of(cell)
            sizes = np.diff(at)
            small = np.repeat(sizes <= 64, sizes)
            a, b = [], []
            for d in range(1, min(64, len(fps))):
                i = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:])
                if not len(i):
                    break
                i = i[_near(fps[i], fps[i + d], radius)]
                a.append(fps[i])
                b.append(fps[i + d])
            for k in np.flatnonzero(sizes > 64):
                x, y = _forest(np.unique(fps[at[k] : at[k + 1]]), radius)
                a.append(x)
                b.append(y)
            a, b = stars(*(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = written(distinct.select("fp").mapInArrow(deal, "cell long, fp long"), "cells")
    crowded = written(dealt.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "crowded")
    cells = dealt
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        split = dealt.join(crowded, "cell").select("cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        split = split.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
        cells = dealt.join(crowded, "cell", "left_anti").unionByName(split)
    return cells.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, k: int = 4, **options: int) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    own = written(fingerprints(docs.select("doc_id", "text"), k), "fingerprints")
    least = written(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    edges = links(least, radius, **options)
    by_doc = edges.join(least.select(F.col("fp").alias("a"), F.col("first").alias("a_doc")), "a").join(least.select(F.col("fp").alias("b"), F.col("first").alias("b_doc")), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    repeated = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("doc_id")
    same = own.join(repeated, "doc_id").join(least, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(by_doc.unionByName(same))
    by_fp = least.join(found.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("component", "first").alias("component"))
    rows = own.join(by_fp, "fp", "left")
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs that no other row of their component precedes by doc_id (equal rows: one of them), with all columns."""
    marks = near_duplicates(docs, **options)
    kept = marks.where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rank = fresh("rank", docs.columns)
    first = docs.join(kept, "doc_id").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)
    return first.unionByName(docs.where("doc_id is null"))


#: Odd multipliers that make further fingerprints of the same shingles; how many fingerprints are compared, and in how many of their bits near texts may differ.
PRINTS = np.array([1, 0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
COMPARED, FAR = 2, 34


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Of each row its doc_id, a key, the hash of its lower-cased words, and the fingerprints f0, f1 and so on."""
    names = [f"f{i}" for i in range(len(PRINTS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, same = np.zeros((len(PRINTS), batch.num_rows), np.uint64), np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(as_bytes(batch.column("text"))):
                hashes = shingles(text, k)
                same[i] = xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))
                for j, m in enumerate(PRINTS):
                    mixed = hashes * m
                    prints[j, i] = majority(mixed ^ (mixed >> np.uint64(31)) if j else hashes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c.view(np.int64)) for c in (same, *prints))], ["doc_id", "key", "words", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, words long, " + ", ".join(f"{c} long" for c in names))


def candidates(texts: DataFrame, radius: int = 4, groups: int = 6, block: int = 4096) -> DataFrame:
    """Edges (a, b) among texts (words, f0, f1 and so on) that share a cell of one of their fingerprints and differ in at most FAR bits of the first COMPARED;
    of each task, no more than connect what they connect."""
    n, every = session_parallelism(texts.sparkSession), [c for c in texts.columns if c != "words"]
    names = every[:COMPARED]

    def deal(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [batch.column(c).to_numpy().view(np.uint64) for c in every]
            cells = np.concatenate([_cells(f, radius, groups) * MIX[0] + np.uint64(j) for j, f in enumerate(prints)])
            rest = {c: pa.array(np.tile(batch.column(c).to_numpy(), len(cells))) for c in (["words", *names] if wide else [])}
            yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).view(np.int64)), *rest.values()], ["cell", *rest])

    def near(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows of fingerprints, those within reach: by the Manhattan bound, then exactly."""
        ok = sum(manhattan(embedded(f[i]), embedded(f[j])) for f in fps) <= FAR
        ok[ok] = sum(np.bitwise_count(f[np.broadcast_to(i, ok.shape)[ok]] ^ f[np.broadcast_to(j, ok.shape)[ok]]).astype(np.int64) for f in fps) <= FAR
        return ok

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "cell"):
            cell, words = table["cell"].to_numpy(), table["words"].to_numpy()
            fps = [table[c].to_numpy().view(np.uint64) for c in names]
            at = starts_of(cell)
            sizes = np.diff(at)
            small = np.repeat(sizes <= 64, sizes)
            a, b = [], []
            for d in range(1, min(64, len(cell))):
                i = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:])
                if not len(i):
                    break
                i = i[near(fps, i, i + d)]
                a.append(i)
                b.append(i + d)
            for k in np.flatnonzero(sizes > 64):
                left, queue = np.arange(at[k], at[k + 1]), []
                while len(left):  # breadth first, each step against all that are not reached
                    if not queue:
                        queue, left = [left[0]], left[1:]
                    x = queue.pop()
                    hit = near(fps, np.array([x]), left)
                    found, left = left[hit], left[~hit]
                    a.append(np.full(len(found), x))
                    b.append(found)
                    queue += found.tolist()
            a, b = stars(*(words[np.concatenate(e)] if e else np.zeros(0, np.int64) for e in (a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    schema = "cell long, words long, " + ", ".join(f"{c} long" for c in names)
    dealt = texts.mapInArrow(lambda b: deal(b, True), schema)
    crowded = texts.mapInArrow(lambda b: deal(b, False), "cell long").groupBy("cell").count().where(F.col("count") > block)
    crowded = written(crowded.select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "crowded")
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int")
        split = dealt.join(crowded, "cell").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.withColumn("cell", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).select("cell", "words", *names)
        dealt = dealt.join(crowded, "cell", "left_anti").select("cell", "words", *names).unionByName(split)
    return dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(pairs, "a long, b long").distinct()


def _alike(sets: list[np.ndarray], similarity: float, cross: np.ndarray | None) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the pairs of sets (sorted, without repeats) whose Jaccard similarity is at least so much; of two blocks, pairs across."""
    size, n = np.array([len(x) for x in sets]), len(sets)
    if n <= 4:
        common = np.array([[len(np.intersect1d(x, y, True)) if j > i else 0 for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    else:
        every = np.concatenate(sets)
        _, at, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        _, column = np.unique(at[shared], return_inverse=True)
        row, common = np.repeat(np.arange(n), size)[shared], np.zeros((n, n))
        for lo in range(0, int(column.max(initial=-1)) + 1, 4096):
            here = (column >= lo) & (column < lo + 4096)
            held = np.zeros((n, 4096), dtype=np.float32)
            held[row[here], column[here] - lo] = 1
            common += held @ held.T
    union = size[:, None] + size[None] - common
    i, j = np.nonzero(np.triu((common >= similarity * union - 1e-9) & (union > 0), 1))
    if cross is not None:
        i, j = i[cross[i] != cross[j]], j[cross[i] != cross[j]]
    return spanning(n, i, j)


def alike(docs: DataFrame, rows: DataFrame, k: int, similarity: float, block: int = 512) -> DataFrame:
    """Edges (a, b) that connect what pairs of texts with the given similarity connect. docs: key and text, each key once; rows: key, words and group of a
    row for each text that has candidates."""
    n = session_parallelism(docs.sparkSession)
    sizes = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    dealt = rows.join(sizes, "group").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("words"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("group", F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")))
    texts = docs.select("key", "text").join(rows.select("key"), "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(x, k)).view(np.int64) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            group, words, own = (table[c].to_numpy() for c in ("group", "words", "own"))
            lists = table["shingles"].combine_chunks()
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            flat, a, b = lists.flatten().to_numpy(), [], []
            at = starts_of(group)
            for lo, hi in zip(at, at[1:]):
                x, y = _alike([flat[ends[i] : ends[i + 1]] for i in range(lo, hi)], similarity, own[lo:hi] if len(np.unique(own[lo:hi])) > 1 else None)
                a.append(words[lo:hi][x])
                b.append(words[lo:hi][y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)) if e else pa.array([], pa.int64()) for e in (a, b)], ["a", "b"])

    sets = dealt.select("key", "words", "group", "own").join(texts.mapInArrow(cut, "key long, shingles array<long>"), "key")
    return sets.repartition(n, "group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long").distinct()


def one_of_alike(docs: DataFrame, k: int = 5, similarity: float = 0.8, **options: int) -> DataFrame:
    """One row, with all columns, of each group of texts that are equal in words or linked by similarity: that with the smallest doc_id (null last), then
    the smallest hash. Of equal rows one stays."""
    columns = docs.columns
    key, rank = fresh("key", columns), fresh("rank", columns)
    # of equal rows the first, by each task before rows are moved
    first = docs.withColumn(key, row_key()).withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*columns)))).where(F.col(rank) == 1)
    own = written(signatures(docs, k), "signatures")
    prints = [c for c in own.columns if c not in ("doc_id", "key", "words")]
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    texts = written(own.groupBy("words").agg(F.min(order).alias("best"), *(F.first(c).alias(c) for c in prints)), "different-texts")
    groups = components(candidates(texts.select("words", *prints), **options)).select(F.col("node").alias("words"), F.col("component").alias("group"))
    rows = written(texts.select("words", F.col("best.key").alias("key")).join(groups, "words"), "candidate-texts")
    linked = components(alike(first.select(F.col(key).alias("key"), "text"), rows, k, similarity))
    by_text = texts.select("words", "best").join(linked.withColumnRenamed("node", "words"), "words", "left")
    kept = by_text.groupBy(F.coalesce("component", "words").alias("c")).agg(F.min("best").alias("best")).select("best.key")
    return first.join(kept.withColumnRenamed("key", key), key, "left_semi").select(*columns)
