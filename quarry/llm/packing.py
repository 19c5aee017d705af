"""Packing along a space-filling curve.

Each document's ids are hashed into a vector whose random signed projection has ``DIMENSIONS`` coordinates; its
direction is quantised and mapped to a Hilbert key. Documents, in parts of at most ``PART`` ids so that no row is much
larger than others, are sorted into ranges of keys, and each range is one
stream of ids, cut every ``size`` ids: neighbours along the curve share sequences, every sequence but the last of a
range is full, and no id is lost or doubled.

Null texts count as empty; an empty text still has its end id, so every row yields at least one piece. Very long texts are encoded
whole, then dealt in parts. Ties of the key go by doc_id, then by the text's hash, then by the part; equal rows are packed one after the other.
An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MIX, session_parallelism, written

DIMENSIONS, BITS, PART = 4, 8, 4096
#: How byte-level BPE splits texts (fixed by its vocabularies).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """Ids of texts by a tokenizers file with a byte-level BPE model.

    Where the file's merges are in the order of their results' ids, as they are in byte-level vocabularies numbered as
    they were learned, merging by id is merging by rank, and tiktoken, given this file's vocabulary and special
    tokens, yields the same ids several times faster. Any other file goes through tokenizers itself.
    """

    def __init__(self, path: str, fast: bool = True):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ranks = self._by_rank() if fast else None

    def _by_rank(self):
        import tiktoken

        told = json.loads(self.tokenizer.to_str())
        model, before = told["model"], told.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not told.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        results = [model["vocab"].get("".join(m), -1) for m in merges]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if -1 in results or any(b <= a for a, b in zip(results, results[1:])) or len(results) + 256 + len(special) < len(model["vocab"]) or not all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"]):
            return None
        letters = {c: i for i, c in byte_letters().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self.ranks.encode_to_numpy(t, allowed_special="all").astype(self.kind).tobytes() for t in texts]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    """One for each Python worker."""
    return ByteEncoder(path)


@lru_cache(maxsize=2)
def projection(vocabulary: int) -> np.ndarray:
    """A signed weight for each id and dimension; rare ids, which have high numbers, weigh more."""
    x = (np.arange(vocabulary, dtype=np.uint64)[:, None] + 1) * MIX[0] + np.arange(DIMENSIONS, dtype=np.uint64) * MIX[1]
    x = (x ^ (x >> np.uint64(31))) * MIX[2]
    return np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0) * np.log2(2 + np.arange(vocabulary))[:, None]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys along the Hilbert curve of rows of unsigned coordinates of so many bits (Skilling's transform)."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & (q - 1))
            x[:, 0] = np.where(on, x[:, 0] ^ (q - 1), x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Rows of at most PART ids of a document with its end id: doc_id, the Hilbert key, a hash of the text, where the part starts, the document's
    number of ids, and the part's (little-endian, two bytes each where they fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        weights, last = projection(max(words.size, end + 1)), np.array([end], words.kind).tobytes()
        for batch in batches:
            ids = [x + last for x in words.encode([x or "" for x in batch.column("text").to_pylist()])]
            vectors = np.array([weights[np.frombuffer(x, words.kind)].sum(0) for x in ids]).reshape(-1, DIMENSIONS)
            unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            key = hilbert(np.clip((unit + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))
            step = words.kind.itemsize * PART
            counts = np.array([-(-len(x) // step) for x in ids], np.int64)
            row = np.repeat(np.arange(len(ids)), counts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            parts = pa.array([ids[i][p * step : (p + 1) * step] for i, p in zip(row.tolist(), part.tolist())], pa.binary())
            whole = np.array([len(x) // words.kind.itemsize for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(key[row]), batch.column("hash").take(pa.array(row)), pa.array(part * PART), pa.array(whole[row]), parts], ["doc_id", "key", "hash", "first", "whole", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "doc_id long, key long, hash long, first long, whole long, ids binary")


def packed(docs: DataFrame, path: str, end: int = 1, size: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids is set, ids (array of int)."""
    n = session_parallelism(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at, base = encoder(path).kind, 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            out, pieces = [], []
            for doc, first, whole, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "whole", "ids")), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                start = 0
                while start < len(ids):
                    take = min(len(ids) - start, size - at % size)
                    piece = ids[start : start + take]
                    out.append((doc, first + start, take, zlib.crc32(piece), whole, base + at // size, at % size))
                    pieces.append(piece)
                    start += take
                    at += take
            columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 7)]
            if with_ids:
                flat = np.concatenate(pieces) if pieces else np.zeros(0, "<u4")
                ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    order = ["key", "doc_id", "hash", "first"]
    ranged = written(encoded(docs, path, end), "encoded").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "first", "whole", "ids").mapInArrow(run, ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names))


def padding(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """sequences, tokens and the share of padding in them."""
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    return by.agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / (F.count("*") * size)).alias("padding"))
