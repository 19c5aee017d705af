"""Retrieval: vector, keyword and hybrid top-k, fused by reciprocal rank; FAQ browsing and search; grep and related files.

Every result has the columns of its chunks but the embedding, and similarity: the cosine, the keyword score or the
fused score. Ties go by id. Top-k is a limit after a sort, which Spark runs as a bounded heap per task.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import cosine, tokens
from quarry.functions.stemming import stem

RRF_K = 60
#: Parameters of the BM25 score.
K1, B = 1.2, 0.75


def narrowed(chunks: DataFrame, source: str | None = None, version: str | None = None) -> DataFrame:
    for column, value in (("source_name", source), ("version", version)):
        if value:
            chunks = chunks.where(F.col(column) == value)
    return chunks


def _best(scored: DataFrame, limit: int) -> DataFrame:
    return scored.drop("embedding").orderBy(F.desc("similarity"), "id").limit(limit)


def vector_search(chunks: DataFrame, query: list[float], limit: int, source: str | None = None, version: str | None = None, min_score: float | None = None) -> DataFrame:
    """The nearest chunks by cosine; the floor applies to what the limit let through."""
    found = _best(narrowed(chunks, source, version).withColumn("similarity", cosine(F.col("embedding"), query)).where("similarity IS NOT NULL"), limit)
    return found if min_score is None else found.where(F.col("similarity") >= min_score)


def _nothing(chunks: DataFrame) -> DataFrame:
    return chunks.drop("embedding").withColumn("similarity", F.lit(0.0)).where(F.lit(False))


def simple_keyword_search(chunks: DataFrame, query: str, limit: int, source: str | None = None, version: str | None = None) -> DataFrame:
    """Chunks that hold all words of the query, as they stand, by the number of their occurrences."""
    words = sorted(set(_split(query)))
    if not words:
        return _nothing(chunks)
    rows = narrowed(chunks, source, version).withColumn("_tokens", tokens(F.col("content")))
    rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, words)), "_tokens")) == 0)
    count = F.size(F.filter("_tokens", lambda t: t.isin(words))).cast("double")
    return _best(rows.withColumn("similarity", count).drop("_tokens"), limit)


def _split(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


@lru_cache(maxsize=1)
def stop_words() -> frozenset[str]:
    """Spark's English stop words."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def _surface_forms(chunks: DataFrame, stems: list[str]) -> dict[str, str]:
    """The words of the chunks with one of these stems. Stemming keeps the first two letters of a word, so only distinct words that begin
    like a stem are stemmed; what comes back is the inflections of a few words."""
    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem)

    begins = lambda t: F.substring(t, 1, 2).isin(sorted({s[:2] for s in stems}))
    words = chunks.select(F.explode(F.array_distinct(F.filter(tokens(F.col("content")), begins))).alias("word")).distinct()
    return {r.word: r.stem for r in words.withColumn("stem", stemmed("word")).where(F.col("stem").isin(stems)).collect()}


def keyword_search(chunks: DataFrame, query: str, limit: int, source: str | None = None, version: str | None = None) -> DataFrame:
    """Chunks that hold a form of every word of the query but stop words, by BM25 over the narrowed chunks."""
    stems = sorted({stem(w) for w in _split(query) if w not in stop_words()})
    if not stems:
        return _nothing(chunks)
    rows = narrowed(chunks, source, version)
    forms = _surface_forms(rows, stems)
    if {*forms.values()} != {*stems}:
        return _nothing(chunks)
    rows = rows.withColumn("_tokens", tokens(F.col("content")))
    frequency = lambda s: F.size(F.filter("_tokens", lambda t: t.isin([w for w, x in forms.items() if x == s])))
    rows = rows.select("*", F.size("_tokens").alias("_length"), F.array(*map(frequency, stems)).alias("_tf")).drop("_tokens")
    stats = rows.agg(F.count("*").alias("n"), F.avg("_length").alias("length"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(stems))]).first()
    score = F.lit(0.0)
    for i in range(len(stems)):
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col("_tf")[i].cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / stats["length"]))
    rows = rows.where(F.forall("_tf", lambda t: t > 0)).withColumn("similarity", score)
    return _best(rows.drop("_tf", "_length"), limit)


def postings(chunks: DataFrame, buckets: int = 64) -> DataFrame:
    """The inverted index of chunks: term, id, tf, length and the bucket to partition a written table by, so that a query reads the buckets of its terms only."""
    words = chunks.select("id", tokens(F.col("content")).alias("t")).select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def postings_search(index: DataFrame, query: str, limit: int, buckets: int = 64) -> DataFrame:
    """id and similarity (number of occurrences) of chunks that hold all words of the query, from postings; the same result as simple_keyword_search."""
    words = sorted(set(_split(query)))
    where = F.array(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets)).cast("int") for w in words]) if words else None
    if not words:
        return index.select("id", F.lit(0.0).alias("similarity")).where(F.lit(False))
    numbers = index.sparkSession.range(1).select(where.alias("b")).first().b
    rows = index.where(F.col("bucket").isin(numbers) & F.col("term").isin(words)).groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").cast("double").alias("similarity"))
    return rows.where(F.col("n") == len(words)).select("id", "similarity").orderBy(F.desc("similarity"), "id").limit(limit)


def fused(vector_hits: DataFrame, keyword_hits: DataFrame, limit: int) -> DataFrame:
    """Hits of two ranked lists by the sum of 1 / (60 + rank). An id's first place in a list counts; the row is the vector hit's where there is one, and ties keep
    the order of the vector hits, then of the keyword hits."""
    place = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))
    lists = [hits.withColumn("_rank", place).withColumn("_list", F.lit(i)) for i, hits in enumerate((vector_hits, keyword_hits))]
    rows = lists[0].unionByName(lists[1])
    columns = [c for c in vector_hits.columns if c != "similarity"]
    by_list = rows.groupBy("id", "_list").agg(F.min("_rank").alias("_rank"), F.min_by(F.struct(*columns), "_rank").alias("_row"))
    merged = by_list.groupBy("id").agg(F.sum(1 / (RRF_K + F.col("_rank"))).alias("similarity"), F.min(F.struct("_list", "_rank")).alias("_first"), F.min_by("_row", "_list").alias("_row"))
    return merged.orderBy(F.desc("similarity"), "_first._list", "_first._rank").limit(limit).select("_row.*", "similarity")


def hybrid_search(chunks: DataFrame, query: list[float], words: str, limit: int, min_score: float | None = None, simple: bool = False, **narrow: str | None) -> DataFrame:
    """Twice the limit from either side; the floor holds for the vector side only."""
    by_words = (simple_keyword_search if simple else keyword_search)(chunks, words, 2 * limit, **narrow)
    return fused(vector_search(chunks, query, 2 * limit, min_score=min_score, **narrow), by_words, limit)


# FAQ


def confidence() -> Column:
    return F.get_json_object("metadata", "$.confidence").try_cast("double")


def faq_rows(chunks: DataFrame, sources: list[str], min_confidence: float) -> DataFrame:
    return chunks.where(F.col("source_name").isin(sources)).withColumn("confidence", confidence()).where(F.col("confidence") >= min_confidence)


def faq_browse(chunks: DataFrame, sources: list[str], min_confidence: float = 0.7, limit: int | None = None) -> DataFrame:
    """FAQ chunks of the sources by source and latest indexing; no sources, no rows."""
    rows = faq_rows(chunks, sources, min_confidence).drop("embedding").withColumn("similarity", F.lit(0.0)).orderBy("source_name", F.desc("indexed_at"), "id")
    return rows if limit is None else rows.limit(limit)


def knowledge_search(chunks: DataFrame, query: list[float], sources: list[str], limit: int = 20, min_confidence: float = 0.7, per_source: int | None = None) -> DataFrame:
    """The best hits of each source, of these the best over all, of these the ones of enough confidence (so there may be fewer)."""
    rows = chunks.where(F.col("source_name").isin(sources)).withColumn("similarity", cosine(F.col("embedding"), query)).drop("embedding")
    rank = F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("similarity"), "id"))
    best = _best(rows.withColumn("_rank", rank).where(F.col("_rank") <= (per_source or limit)).drop("_rank"), limit)
    return best.withColumn("confidence", confidence()).where(F.col("confidence") >= min_confidence)


# files


def virtual_path(several_sources: bool = True) -> Column:
    return F.concat(F.lit("/"), F.when(F.lit(several_sources), F.concat("source_name", F.lit("/"))).otherwise(""), F.col("file_path"))


def grep(chunks: DataFrame, literal: str) -> DataFrame:
    """path, line and text of every line that holds the literal, whatever its case."""
    lines = chunks.where(F.contains(F.lower("content"), F.lit(literal.lower()))).select("id", virtual_path().alias("path"), F.coalesce("start_line", F.lit(1)).alias("first"), F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return lines.where(F.contains(F.lower("text"), F.lit(literal.lower()))).select("path", (F.col("first") + F.col("i")).alias("line"), "text", "id")


def semantic_grep(chunks: DataFrame, query: list[float], literal: str, limit: int = 20) -> DataFrame:
    """grep over the hits of vector and keyword search for the literal."""
    hits = vector_search(chunks, query, limit).unionByName(simple_keyword_search(chunks, literal, limit)).dropDuplicates(["id"])
    return grep(hits, literal)


def related_files(chunks: DataFrame, query: list[float], own_path: str | None = None, limit: int = 10) -> DataFrame:
    """Files of the nearest chunks but the file itself, each with its best similarity."""
    hits = vector_search(chunks, query, limit).withColumn("path", virtual_path())
    if own_path:
        hits = hits.where(F.col("path") != own_path)
    return hits.groupBy("path").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "path")


def listing(chunks: DataFrame, folder: str) -> DataFrame:
    """Names, kinds, sizes and lines below a folder of the virtual file tree."""
    base = folder.rstrip("/") + "/"
    files = chunks.select(virtual_path().alias("path"), F.octet_length("content").alias("size"), F.regexp_count("content", F.lit("\n")).alias("lines")).where(F.startswith("path", F.lit(base)))
    rest = F.substring("path", len(base) + 1, 1 << 30)
    rows = files.select(F.substring_index(rest, "/", 1).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir"), "size", "lines")
    return rows.groupBy("name", "is_dir").agg(F.sum("size").alias("size"), F.sum("lines").alias("lines")).orderBy(F.desc("is_dir"), "name")
