"""A stored inverted index: stems with positions, block maxima, BM25 and cover density, kept up by runs.

A posting row holds the documents of one term in one block: (bucket, term, block, n, max_tf, min_length, entries). Blocks group documents of like length, by the
hash of their id within it, and hold about ``BLOCK`` documents or ``WORDS`` words, so a row is bounded however common its term. Documents are dealt by block, so a
task inverts one block after the other; a row is stored as arrays over its documents. Postings are partitioned by
a hash of the term, so a query reads the buckets of its terms; it looks at n, max_tf and min_length first. From these come document frequencies and, for
each block, the most that BM25 can reach there. The most promising blocks are scored first, then only those that can still reach the best.

Documents match that hold all terms of a query. Lengths and positions count all words, also stop words. Changes write runs: add() a run with the new
documents, and both add() and remove() the ids that earlier runs no longer hold, with the terms that they take away, so frequencies stay exact.
Null contents are documents without words. Equal ids of one run are separate documents. Ties go by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.stemming import stem
from quarry.operators.search import B, K1, _split, stop_words

#: Buckets of terms and of documents; documents and words of a block; blocks that are scored first.
BUCKETS, BLOCK, WORDS, FIRST = 64, 4096, 1_000_000, 16
#: Different words whose stems a task keeps.
KEPT = 200_000


def analyzed(text: str, simple: bool = False) -> list[str]:
    """The different terms of a query, in order."""
    return sorted({w if simple else stem(w) for w in _split(text) if simple or w not in stop_words()})


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_of(value: str) -> int:
    """The same for one term, without a job (BUCKETS is a power of two)."""
    return xxhash.xxh64_intdigest(value.encode(), seed=42) % BUCKETS


def _worded(docs: DataFrame) -> DataFrame:
    """docs (id, content and other columns) with their words, as tokens() has them, joined by spaces in the place of content, and length, their number."""
    rest = [c for c in docs.columns if c != "content"]
    words = F.btrim(F.regexp_replace(F.lower(F.coalesce("content", F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    length = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    return docs.select(*rest, words.alias("words")).withColumn("length", length)


def inverted(docs: DataFrame, simple: bool = False) -> DataFrame:
    """Posting rows of docs (id, block, length, words and other columns), whose blocks must come together: term, block, n, max_tf, min_length, and of its documents ids, the other
    columns, lengths, ends (occurrences up to each, itself included) and positions. A block of over twice its words or four times its documents is cut; block numbers must leave room for it."""
    stops = frozenset() if simple else stop_words()
    rest = {f.name: f.dataType.simpleString() for f in docs.schema if f.name not in ("block", "length", "words")}
    most_docs, most_words = 4 * BLOCK, 2 * WORDS

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        held, block, cut, n, words = [], None, 0, 0, 0
        for batch in batches:
            begin = 0
            for i, (own, length) in enumerate(zip(batch.column("block").to_pylist(), batch.column("length").to_pylist(), strict=True)):
                if own != block or n == most_docs or words + length > most_words:
                    held.append(batch.slice(begin, i - begin))
                    if n:
                        yield block + cut, pa.Table.from_batches(held)
                    held, begin, cut, block, n, words = [], i, cut + 1 if own == block else 0, own, 0, 0
                n, words = n + 1, words + length
            held.append(batch.slice(begin))
        if n:
            yield block + cut, pa.Table.from_batches(held)

    def numbered(words: list[str], known: dict[str, str | None]) -> tuple[np.ndarray, list[str]]:
        """For each word the number of its term, -1 for none; the terms."""
        if simple:
            return np.arange(len(words)), words
        numbers: dict[str, int] = {}
        out = np.full(len(words), -1)
        for i, w in enumerate(words):
            if w not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[w] = None if w in stops else stem(w)
            if (t := known[w]) is not None:
                out[i] = numbers.setdefault(t, len(numbers))
        return out, [*numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for block, piece in pieces(batches):
            lengths = piece["length"].to_numpy()
            words = pc.list_flatten(pc.split_pattern(piece["words"].combine_chunks(), " ")).dictionary_encode()
            numbers, terms = numbered(words.dictionary.to_pylist(), known)
            term = numbers[words.indices.to_numpy()]
            place = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            key = term * len(lengths) + np.repeat(np.arange(len(lengths)), lengths)
            place, key = place[term >= 0], key[term >= 0]
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key = key[order]
            # an entry begins with each new term and document, a row with each new term
            entries = np.flatnonzero(np.diff(key, prepend=-1))
            term, doc = np.divmod(key[entries], len(lengths))
            rows = np.flatnonzero(np.diff(term, prepend=-1))
            upto, first = np.append(rows, len(entries)).astype(np.int32), np.append(entries, len(key))
            tf, begun = np.diff(first), np.repeat(entries[rows], np.diff(upto))
            of = lambda values, at=upto: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            own = [of(piece[c].combine_chunks().take(pa.array(doc))) for c in rest]
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()).take(pa.array(term[rows])), pa.array(np.full(len(rows), block), pa.int64()), pa.array(np.diff(upto), pa.int32()), pa.array(np.maximum.reduceat(tf, rows), pa.int32()), pa.array(np.minimum.reduceat(lengths[doc], rows), pa.int32()),
                 *own, of(pa.array(lengths[doc], pa.int32())), of(pa.array(first[1:] - begun, pa.int32())), of(pa.array(place[order], pa.int32()), first[upto])],
                ["term", "block", "n", "max_tf", "min_length", *rest, "lengths", "ends", "positions"],
            )

    return docs.mapInArrow(run, "term string, block long, n int, max_tf int, min_length int, " + "".join(f"`{c}` array<{kind}>, " for c, kind in rest.items()) + "lengths array<int>, ends array<int>, positions array<int>")


def _entries(rest: list[str]) -> Column:
    """The documents of a posting row as structs."""
    def entry(x: Column, i: Column) -> Column:
        begin = F.coalesce(F.get("ends", i - 1), F.lit(0))
        tf = F.get("ends", i) - begin
        return F.struct(x.alias("id"), tf.alias("tf"), F.get("lengths", i).alias("length"), F.slice("positions", begin + 1, tf).alias("positions"), *(F.get(F.col(c), i).alias(c) for c in rest))

    return F.transform("id", entry)


def share(tf: Column, length: Column, average: float) -> Column:
    """What a term adds to BM25, but its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class KeywordIndex:
    """An index under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, simple: bool = False):
        self.spark, self.path, self.simple = spark, path.rstrip("/"), simple
        self._tables: dict[str, DataFrame | None] = {}

    @classmethod
    def build(cls, chunks: DataFrame, path: str, simple: bool = False) -> KeywordIndex:
        """An index of chunks (id, content and any other columns), by stems without stop words, or by words as they stand if simple."""
        index = cls(chunks.sparkSession, path, simple)
        index._append(chunks, 0)
        return index

    def _append(self, chunks: DataFrame, run: int) -> None:
        chunks = chunks.drop("embedding")
        narrow = [c for c in ("source_name", "version") if c in chunks.columns]
        docs = _worded(chunks.select("id", *narrow, "content")).withColumn("kind", F.floor(4 * F.log2(F.col("length") + 1)).cast("long"))
        kinds = docs.groupBy("kind").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect()
        words = sum(k.length for k in kinds)
        self.spark.createDataFrame([(sum(k.n for k in kinds), words)], "n long, length long").coalesce(1).write.parquet(f"{self.path}/totals/run={run}")
        parts = F.create_map(*[F.lit(x) for k in kinds for x in (k.kind, 1 + max(k.n // BLOCK, k.length // WORDS))]) if kinds else F.create_map().cast("map<long, long>")
        block = F.col("kind") * (1 << 40) + F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(parts, "kind"), F.lit(1))) * (1 << 20)
        docs = docs.where("length > 0").withColumn("block", block).drop("kind")
        # all of a block in one task, in an order that a second attempt repeats, as cuts hang on it
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1 + words // (4 * WORDS))
        rows = inverted(docs.repartition(tasks, "block").sortWithinPartitions("block", "id", "words"), self.simple).withColumn("bucket", _bucket(F.col("term")))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/postings/run={run}")
        stored = chunks.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
        stored.hint("rebalance", "part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{self.path}/rows/run={run}")

    # changes

    def _read(self, table: str) -> DataFrame | None:
        """A table as it was when this index first read or last changed it."""
        if table not in self._tables:
            try:
                self._tables[table] = self.spark.read.parquet(f"{self.path}/{table}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):  # a partitioned table without rows has no files
                    raise
                self._tables[table] = None
        return self._tables[table]

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (id, run) without those that later runs replaced or removed."""
        gone = self._read("gone")
        if gone is None:
            return rows
        last = gone.groupBy("id").agg(F.max("run").alias("last")).withColumnRenamed("id", "_id")
        return rows.join(last, (F.col("id") == F.col("_id")) & (F.col("run") < F.col("last")), "left_anti")

    def _forget(self, ids: DataFrame, run: int) -> None:
        ids = ids.select("id").distinct()
        lost = self.rows().join(ids, "id", "left_semi")
        docs = _worded(lost.select("id", "content"))
        docs.agg((-F.count("*")).alias("n"), F.coalesce(-F.sum("length"), F.lit(0)).alias("length")).write.mode("append").parquet(f"{self.path}/totals/run={run}")
        terms = inverted(docs.where("length > 0").withColumn("block", F.lit(0).cast("long")), self.simple).groupBy("term").agg(F.sum("n").alias("n")).withColumn("bucket", _bucket(F.col("term")))
        terms.write.partitionBy("bucket").mode("append").parquet(f"{self.path}/lost/run={run}")
        ids.write.mode("append").parquet(f"{self.path}/gone/run={run}")

    def _next_run(self) -> int:
        return self._read("totals").agg(F.max("run").alias("run")).first().run + 1

    def add(self, chunks: DataFrame) -> None:
        """Add chunks, in the place of earlier ones with their ids."""
        run = self._next_run()
        self._forget(chunks, run)
        chunks = chunks.drop("embedding")
        self._append(chunks, run + 1)
        self._tables.clear()

    def remove(self, ids: DataFrame) -> None:
        self._forget(ids, self._next_run())
        self._tables.clear()

    def compacted(self, path: str) -> KeywordIndex:
        """The same documents as an index of one run."""
        return KeywordIndex.build(self.rows().drop("run", "part"), path, self.simple)

    # search

    def rows(self) -> DataFrame:
        rows = self._read("rows")
        return self.spark.createDataFrame([], "id long, content string, run int, part int") if rows is None else self._live(rows)

    def rows_of_terms(self) -> DataFrame:
        """Each term of an index of one run: in how many documents it occurs, and how often at most in one of them. Reads no entries."""
        return self._read("postings").groupBy("term").agg(F.sum("n").alias("documents"), F.max("max_tf").cast("long").alias("most"))

    def postings(self, terms: list[str]) -> DataFrame:
        """The posting rows of terms: partitions of their buckets only, and of these the row groups that may hold the terms."""
        rows = self._read("postings").where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms))
        rest = [c for c in ("source_name", "version") if c in rows.columns]
        return rows.withColumn("entries", _entries(rest)).drop("id", "lengths", "ends", "positions", *rest)

    def frequencies(self, terms: list[str]) -> tuple[int, float, dict[str, int]]:
        """The number of documents, their average length, and in how many each term occurs."""
        found = self.postings(terms).select("term", "n", F.lit(0).alias("length"))
        lost = self._read("lost")
        if lost is not None:
            found = found.unionByName(lost.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms)).select("term", (-F.col("n")).alias("n"), F.lit(0).alias("length")))
        found = found.unionByName(self._read("totals").select(F.lit(None).cast("string").alias("term"), "n", "length"))
        sums = {r.term: r for r in found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()}
        return sums[None].n, sums[None].length / max(1, sums[None].n), {t: sums[t].n if t in sums else 0 for t in terms}

    def _matched(self, terms: list[str], blocks: DataFrame | Column | None, source: str | None, version: str | None) -> DataFrame:
        """Documents with all terms, of all blocks or of some (a table of run and block, or a condition): id, run, length, and tf and positions by term."""
        rows = self.postings(terms).select("run", "block", "term", "entries")
        if isinstance(blocks, DataFrame):
            rows = rows.join(blocks.select("run", "block"), ["run", "block"], "left_semi")
        elif blocks is not None:
            rows = rows.where(blocks)
        each = rows.select("run", "term", F.inline("entries"))
        for column, value in (("source_name", source), ("version", version)):
            if value:
                each = each.where(F.col(column) == value)
        each = self._live(each)
        # equal ids of a run keep apart by their positions only, which differ by document; they count as one here
        found = each.groupBy("id", "run").agg(F.max("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("positions"))
        return found.where(F.size("tf") == len(terms))

    def ranked(self, query: str, limit: int, source: str | None = None, version: str | None = None) -> DataFrame:
        """id, run and similarity, the BM25 score, of the best documents with all terms of the query. At most limit rows come to the driver from either round."""
        terms = analyzed(query, self.simple) if self._read("postings") is not None else []
        n, average, counts = self.frequencies(terms) if terms else (0, 1.0, {})
        if not terms or not all(counts.values()) or limit <= 0:
            return self._nothing()
        weight = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in counts.items()}
        weighed = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in weight.items()])
        most = self.postings(terms).groupBy("run", "block").agg(F.count("*").alias("terms"), F.sum(weighed * share(F.col("max_tf").cast("double"), F.col("min_length"), average)).alias("most"))
        most = most.where(F.col("terms") == len(terms)).select("run", "block", "most")
        score = sum((weight[t] * share(F.col("tf")[t].cast("double"), F.col("length"), average) for t in terms), F.lit(0.0))

        def best(blocks: Column | DataFrame) -> list[tuple]:
            rows = self._matched(terms, blocks, source, version).select("id", "run", score.alias("similarity"))
            return [tuple(r) for r in rows.orderBy(F.desc("similarity"), "id").limit(limit).collect()]

        first = most.orderBy(F.desc("most"), "run", "block").limit(FIRST + 1).collect()
        chosen = F.struct("run", "block").isin([F.struct(F.lit(r.run), F.lit(r.block)) for r in first[:FIRST]]) if first else F.lit(False)
        found = best(chosen)
        if len(first) > FIRST and not (len(found) == limit and first[FIRST].most < found[-1][2] - 1e-9):
            floor = found[-1][2] - 1e-9 if len(found) == limit else 0.0
            found = sorted(found + best(most.where(~chosen & (F.col("most") >= floor))), key=lambda r: (-r[2], r[0]))[:limit]
        return self.spark.createDataFrame(found, self._nothing().schema)

    def proximate(self, query: str, limit: int, source: str | None = None, version: str | None = None) -> DataFrame:
        """id, run and similarity of the best documents by cover density. A cover is a shortest stretch of words with all terms; it adds 1 / (1 + the number of other words in it)."""
        terms = analyzed(query, self.simple) if self._read("postings") is not None else []
        if not terms or limit <= 0:
            return self._nothing()
        places = self._matched(terms, None, source, version).select("id", "run", F.explode("positions").alias("term", "at")).select("id", "run", "term", F.explode("at").alias("at"))
        upto = Window.partitionBy("id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = [F.max(F.when(F.col("term") == t, F.col("at"))).over(upto) for t in terms]
        begins = F.when(sum((x.isNull().cast("int") for x in last), F.lit(0)) == 0, F.least(*last) if len(last) > 1 else last[0])
        covers = places.select("id", "run", "at", begins.alias("begin")).where("begin IS NOT NULL").groupBy("id", "run", "begin").agg(F.min("at").alias("end"))
        one = 1 / (1 + F.col("end") - F.col("begin") + 1 - len(terms)).cast("double")
        return covers.groupBy("id", "run").agg(F.sum(one).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)

    def _nothing(self) -> DataFrame:
        return self.rows().select("id", "run", F.lit(0.0).alias("similarity")).where(F.lit(False))

    def search(self, query: str, limit: int, source: str | None = None, version: str | None = None, near: bool = False) -> DataFrame:
        """The best chunks by BM25, or by cover density if near, with similarity. At most limit rows are looked up, in the parts of their ids."""
        found = {(r.id, r.run): r.similarity for r in (self.proximate if near else self.ranked)(query, limit, source, version).collect()}
        rows = self.rows()
        if not found or limit <= 0:
            return rows.drop("run", "part").withColumn("similarity", F.lit(0.0)).where(F.lit(False))
        kind = rows.schema["id"].dataType.simpleString()
        hits = self.spark.createDataFrame([(i, r, s) for (i, r), s in found.items()], f"id {kind}, run int, similarity double")
        parts = {r.p for r in hits.select(F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("p")).collect()}
        rows = rows.where(F.col("part").isin([*parts]) & F.col("id").isin([i for i, _ in found]))
        return rows.join(F.broadcast(hits), ["id", "run"]).drop("run", "part").orderBy(F.desc("similarity"), "id")
