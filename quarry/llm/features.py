"""Rule statistics of whole texts, shared by the quality classifier and the quality rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import MIX, as_bytes, fresh

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaims", "n_stops", "n_bytes", "n_distinct", "max_count", "n_adjacent", "max_word")
_UPPER, _DIGIT, _STOP, _SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b" \t\n\r\x0b\x0c"


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    if len(hashes) < 4:
        return 0
    windows = hashes[:-2] * MIX[0] + hashes[1:-1] * MIX[1] + hashes[2:] * MIX[2]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.isin(windows, twice)
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[k : k + len(at)] |= at
    return int(covered.sum())


def count_of(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text, in their order."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * 5 + (text.count(b"\n") + bool(text), 0, 0, 0, 0, len(text), 0, 0, 0, 0)
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    runs = np.flatnonzero(np.diff(np.sort(hashes)))
    sizes = np.diff(np.concatenate(([-1], runs, [n - 1])))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    chars = len(text.decode("utf-8", "replace")) - without(_SPACE)
    return (
        n, chars, without(SYMBOLS.encode()), len(lines) - len(set(lines)), repeated_words(hashes), len(lines), without(_UPPER), without(_DIGIT), text.count(b"!"), without(_STOP), len(text),
        len(sizes), int(sizes.max()), int((hashes[1:] == hashes[:-1]).sum()), max(map(len, words)),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of each document's whole text, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([count_of(x) for x in as_bytes(batch.column("text"))], dtype=np.int64).reshape(batch.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], ["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def counted(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the COUNTS of each row as longs in columns of fresh names, and these names."""
    names = [fresh(c, docs.columns) for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([count_of(x) for x in as_bytes(batch.column("text"))], dtype=np.int64).reshape(batch.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], [*batch.schema.names, *names])

    schema = reduce(lambda s, n: s.add(n, "long"), names, T.StructType([*docs.schema.fields]))
    return docs.mapInArrow(run, schema), names


#: Names of the columns of measures().
MEASURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "exclaims", "stops", "bytes_per_char", "distinct", "top_word", "adjacent", "words_per_line", "longest")


def measures(counts: np.ndarray) -> np.ndarray:
    """Ratios from rows of COUNTS; each is finite, also for empty texts."""
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_exclaims"] / words, c["n_stops"] / words,
        c["n_bytes"] / chars, c["n_distinct"] / words, c["max_count"] / words, c["n_adjacent"] / words, np.log1p(c["n_words"] / lines), np.log1p(c["max_word"]),
    ])
