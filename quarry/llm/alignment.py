"""Cross-tokenizer alignment: token groups of a byte-level vocabulary (A) and a SentencePiece model (B) over the same bytes.

Texts are cut before each space between two characters that are no white space: neither tokenizer merges across such a place (B's pieces
hold a space mark in front only, which is checked). Each unit is encoded by both libraries. Coarse cuts are the spans they report:
character offsets of A, byte spans of B. Tokens that share a character (parts of one of several bytes, byte-fallback pieces) are told
apart by the lengths of their decoded bytes. Both are then held against the text's bytes. Units repeat, so a task keeps those it has aligned.

A link joins an A token and a B token that end at the same byte, so the shorter one's bytes end the longer one's: the vocabularies alone tell all
pairs that can ever be linked, some hundred thousand. Counts by pair are an array of that length.

Null and empty texts, and those that the tokens' bytes do not give back (texts with U+2581, which B reads as a space), have no tokens. Texts are read whole,
whatever their length; strings of special tokens are plain text. Repeated rows count each; ties for an id's best partner all
count as best. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, starts_of, written
from quarry.llm.packing import byte_letters

#: Bytes of text that are aligned together; units that the libraries see in one call, whose spans are Python objects;
#: units and characters of them that a task keeps before it begins anew.
SLICE, CALL, KEPT, KEPT_CHARS = 2 << 20, 4096, 400_000, 12 << 20
#: Rows of links that are summed together.
ROWS = 512
#: A space that begins a unit: white space is on neither side.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_NEAR = re.compile(r" \s|\s ")


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the pairs of ids that can end together."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: i for i, c in byte_letters().items()}
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if i not in special:
                self.a_bytes[i] = bytes(letters[c] for c in token)
        count = self.b.get_piece_size()
        fallback = [self.b.is_byte(i) for i in range(count)]
        pieces = [self.b.id_to_piece(i) for i in range(count)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a space mark inside are not supported")
        plain = lambda i: not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() if plain(i) else b"" for i, (p, byte) in enumerate(zip(pieces, fallback, strict=True))]
        self.a_lengths, self.b_lengths = (np.array([*map(len, t)], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.names = [np.array([f"{i}{end}" for end in ",|;" for i in range(n)], object) for n in (len(self.a_bytes), count)]
        self.pairs = self._pairs()

    def _pairs(self) -> np.ndarray:
        """a * (B's size) + b for all ids one of whose bytes end the other's, rising."""
        by: list[dict[bytes, list[int]]] = [{}, {}]
        for ids, table in zip(by, (self.a_bytes, self.b_bytes), strict=True):
            for i, t in enumerate(table):
                if t:
                    ids.setdefault(t, []).append(i)
        size, found = len(self.b_bytes), set()
        for t, ids in by[0].items():
            for k in range(len(t)):
                found.update(a * size + b for b in by[1].get(t[k:], ()) for a in ids)
        for t, ids in by[1].items():
            for k in range(1, len(t)):
                found.update(a * size + b for a in by[0].get(t[k:], ()) for b in ids)
        return np.array(sorted(found), np.int64)


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One for each process."""
    return Vocabularies(a_path, b_path)


def units(text: str) -> list[str]:
    """The units of a text that is not empty, each without the space in front of it (the first one's is added)."""
    whole = " " + text
    return [u[1:] for u in _CUT.split(whole)] if text[-1] == " " or _NEAR.search(whole) else text.split(" ")


def refined(first: np.ndarray, last: np.ndarray, unit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where tokens end, from coarse spans: a token that the next one of its unit overlaps, or whose span is empty, shares a run with it, and ends
    within the run go by the lengths of decoded bytes."""
    if not len(first):
        return last
    shared = np.zeros(len(first), bool)
    shared[:-1] = (unit[1:] == unit[:-1]) & ((first[1:] < last[:-1]) | (last[:-1] <= first[:-1]))
    begins = np.flatnonzero(np.concatenate(([True], ~shared[:-1])))
    sums = np.cumsum(lengths)
    size = np.diff(np.append(begins, len(first)))
    before = np.repeat(sums[begins] - lengths[begins], size)
    inside = shared.copy()
    inside[1:] |= shared[:-1]
    return np.where(inside, np.repeat(first[begins], size) + sums - before, last)


def _flat(ids: list[list[int]], spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids and spans of several texts one after another, and the number of the text of each."""
    flat = np.array([*chain.from_iterable(chain.from_iterable(spans))], np.int64).reshape(-1, 2)
    return np.array([*chain.from_iterable(ids)], np.int64), flat, np.repeat(np.arange(len(ids)), [*map(len, ids)])


class Aligned:
    """Units aligned so far: their numbers of tokens and groups, their groups as text, the places of their linked pairs."""

    def __init__(self, words: Vocabularies):
        self.words = words
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.chars = 0
        self.counts = np.zeros((0, 3), np.int64)  # of A tokens, of B tokens, of groups; no tokens where bytes differ
        self.starts = np.zeros(1, np.int64)
        self.linked = np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.int64)  # how often each was asked for

    def forget(self) -> None:
        """Drop the units that were asked for once, as most are; all, if that is not the most."""
        keep = np.flatnonzero(self.seen > 1)
        if 2 * len(keep) > len(self.seen):
            return self.clear()
        names, texts = [*self.known], self.texts
        linked, sizes, counts, seen = self.pairs_of(keep), self.counts[keep, 2], self.counts[keep], self.seen[keep]
        self.clear()
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.texts = [texts[i] for i in keep.tolist()]
        self.chars = sum(map(len, self.known))
        self.counts, self.linked, self.starts, self.seen = counts, linked, np.append(0, np.cumsum(sizes)), seen // 2

    def add(self, new: list[str]) -> None:
        """Align new units. Those that may stand beside each other in a text are encoded as one text."""
        w = self.words
        alone = [u for u in new if "▁" in u or u[0].isspace() or u[-1].isspace()]
        new = [u for u in new if u not in {*alone}] + alone
        plain = len(new) - len(alone)
        texts = [*([" ".join(new[:plain])] if plain else []), *alone]
        raw = [b" " + u.encode() for u in new]
        base = np.cumsum([0, *map(len, raw)])
        every = b"".join(raw)
        chars = np.append(np.flatnonzero((np.frombuffer(every, np.uint8) & 0xC0) != 0x80), len(every))
        first_char = np.cumsum([0, *(len(t) + 1 for t in texts)])

        found = w.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        a_ids, spans, part = _flat([e.ids for e in found], [e.offsets for e in found])
        spans = chars[spans + first_char[part, None]]
        a_ends = refined(spans[:, 0], spans[:, 1], part, w.a_lengths[a_ids])

        found = w.b.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)  # the spans of its proto
        b_ids, spans, part = _flat([m["ids"] for m in found], [m["offsets"] for m in found])
        spans += chars[first_char[part], None] + 1  # B's spans leave out the space in front, which is its first piece's
        spans[starts_of(part)[:-1], 0] -= 1
        b_ends = refined(spans[:, 0], spans[:, 1], part, w.b_lengths[b_ids])

        a_unit, b_unit = (np.searchsorted(base[1:], ends) for ends in (a_ends, b_ends))
        good = self._same(a_ids, a_unit, w.a_bytes, a_ends, w.a_lengths, raw, base) & self._same(b_ids, b_unit, w.b_bytes, b_ends, w.b_lengths, raw, base)
        if not good.all():
            a_ids, a_ends, a_unit = (x[good[a_unit]] for x in (a_ids, a_ends, a_unit))
            b_ids, b_ends, b_unit = (x[good[b_unit]] for x in (b_ids, b_ends, b_unit))
        self._keep(new, a_ids, a_ends, a_unit, b_ids, b_ends, b_unit)

    def _same(self, ids: np.ndarray, unit: np.ndarray, table: list[bytes], ends: np.ndarray, lengths: np.ndarray, raw: list[bytes], base: np.ndarray) -> np.ndarray:
        """Of each unit, whether its tokens' bytes are its own and end where the tokens are said to."""
        joined = b"".join([table[i] for i in ids.tolist()])
        sums = np.bincount(unit, lengths[ids], len(raw)).astype(np.int64)
        if (sums == np.diff(base)).all() and joined == b"".join(raw):
            good = np.ones(len(raw), bool)
        else:
            at = np.append(0, np.cumsum(sums))
            good = np.array([joined[at[i] : at[i + 1]] == raw[i] for i in range(len(raw))], bool)
        shift = (base[:-1] - np.append(0, np.cumsum(sums))[:-1])[unit]
        wrong = (np.cumsum(lengths[ids]) + shift != ends) & good[unit]
        if wrong.any():
            raise ArithmeticError(f"spans and bytes of tokens disagree in {raw[unit[np.flatnonzero(wrong)[0]]][:80]!r}")
        return good

    def _keep(self, new: list[str], a_ids: np.ndarray, a_ends: np.ndarray, a_unit: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, b_unit: np.ndarray) -> None:
        w = self.words
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_at, b_at = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        pairs = np.searchsorted(w.pairs, a_ids[a_at] * len(w.b_bytes) + b_ids[b_at]).astype(np.int32)
        counts = np.stack([np.bincount(u, minlength=len(new)) for u in (a_unit, b_unit, a_unit[a_at])], 1).astype(np.int64)
        # A tokens of a group, then its B tokens; the last of them end in a bar and a semicolon
        names = []
        for ids, at, mark, table in ((a_ids, a_at, 1, w.names[0]), (b_ids, b_at, 2, w.names[1])):
            kind = np.zeros(len(ids), np.int64)
            kind[at] = mark
            names.append(table[ids + kind * (len(table) // 3)])
        order = np.concatenate((2 * np.searchsorted(cuts, a_ends), 2 * np.searchsorted(cuts, b_ends) + 1)).argsort(kind="stable")
        flat = np.concatenate(names)[order].tolist()
        ends = np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        self.texts += ["".join(flat[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        self.known.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts[:, 2])))
        self.counts, self.linked = np.concatenate((self.counts, counts)), np.concatenate((self.linked, pairs))

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """For each text, the numbers of its units, or None where it has no tokens."""
        if len(self.known) > KEPT or self.chars > KEPT_CHARS:
            self.forget()
        parts = [units(t) if t else [] for t in texts]
        places = [np.fromiter(map(self.known.get, p, repeat(-1)), np.int64, len(p)) for p in parts]
        missed = [np.flatnonzero(at < 0).tolist() for at in places]
        new = [*dict.fromkeys(p[i] for p, at in zip(parts, missed, strict=True) for i in at)]
        for lo in range(0, len(new), CALL):
            self.add(new[lo : lo + CALL])
        self.seen = np.append(self.seen, np.zeros(len(self.counts) - len(self.seen), np.int64))
        for p, at, miss in zip(parts, places, missed, strict=True):
            at[miss] = [self.known[p[i]] for i in miss]
        self.seen += np.bincount(np.concatenate([np.zeros(0, np.int64), *places]), minlength=len(self.seen))
        for at in places:
            yield at if len(at) and self.counts[at, 0].all() else None

    def pairs_of(self, at: np.ndarray) -> np.ndarray:
        """Places of the linked pairs of a row of units."""
        sizes = self.counts[at, 2]
        return self.linked[np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def groups_of(self, at: np.ndarray) -> str:
        """Groups of a row of units: a1,a2|b1;a3|b2,b3."""
        return "".join([self.texts[i] for i in at.tolist()])[:-1]


_KIND = pa.list_(pa.int32())


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and the places of the linked pairs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = _kept(a_path, b_path)
        for batch in slices(batches, "text", SLICE):
            counts, digests, links = [], [], []
            for at in done.of(batch.column("text").to_pylist()):
                counts.append((0, 0, 0) if at is None else done.counts[at].sum(0))
                digests.append("" if at is None else hashlib.sha256(done.groups_of(at).encode()).hexdigest())
                links.append(np.zeros(0, np.int32) if at is None else done.pairs_of(at))
            columns = np.array(counts, np.int64).reshape(-1, 3)
            ends = pa.array(np.append(0, np.cumsum([*map(len, links)])).astype(np.int32))
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *links]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in columns.T), pa.array(digests, pa.string()), pa.ListArray.from_arrays(ends, values)], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>")


@lru_cache(maxsize=1)
def _kept(a_path: str, b_path: str) -> Aligned:
    """What a Python worker has aligned, also in earlier tasks."""
    return Aligned(vocabularies(a_path, b_path))


def pair_counts(links: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """How many links of the corpus (rows of links) hold each pair: place, a_id, b_id, n. At most as many rows as the vocabularies have pairs."""
    words = vocabularies(a_path, b_path)
    total, size = len(words.pairs), len(words.b_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(total, np.int64)
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=total)
        at = np.flatnonzero(n)
        pairs = vocabularies(a_path, b_path).pairs[at]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pairs // size), pa.array(pairs % size), pa.array(n[at])], ["place", "a_id", "b_id", "n"])

    rows = links.select("links").mapInArrow(run, "place long, a_id long, b_id long, n long")
    return rows.groupBy("place", "a_id", "b_id").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each document: doc_id, n_a, n_b, n_groups, n_links, n_best (links that are as frequent as any of their B id), count_sum (the counts of the links' pairs) and groups_sha256."""
    rows = written(encoded(docs, a_path, b_path), "alignment")
    words = vocabularies(a_path, b_path)
    n = np.zeros(len(words.pairs), np.int64)
    found = pair_counts(rows, a_path, b_path).select("place", "n").toArrow()
    n[found["place"].to_numpy()] = found["n"].to_numpy()
    b_of = words.pairs % len(words.b_bytes)
    top = np.zeros(len(words.b_bytes), np.int64)
    np.maximum.at(top, b_of, n)
    counts = docs.sparkSession.sparkContext.broadcast((n, (n == top[b_of]).astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = counts.value
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, max(1, b.num_rows), ROWS)):
            links = batch.column("links")
            at, ends = links.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False)))
            sums = [np.append(0, np.cumsum(x[at]))[ends] for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), batch.column("n_groups"), *(pa.array(np.diff(s)) for s in sums), batch.column("groups_sha256")], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each group: doc_id, number (from 0), first and past, the bytes of space + text that it covers, and its a_ids and b_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = _kept(a_path, b_path)
        lengths = done.words.a_lengths
        for batch in slices(batches, "text", SLICE // 8):
            out = []
            for doc, at in zip(batch.column("doc_id").to_pylist(), done.of(batch.column("text").to_pylist()), strict=True):
                first = 0
                for k, group in enumerate(done.groups_of(at).split(";") if at is not None else ()):
                    a, b = ([*map(int, side.split(","))] for side in group.split("|"))
                    past = first + int(lengths[a].sum())
                    out.append((doc, k, first, past, a, b))
                    first = past
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), _KIND, _KIND)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], ["doc_id", "number", "first", "past", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, number long, first long, past long, a_ids array<int>, b_ids array<int>")
