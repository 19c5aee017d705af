"""SentencePiece encoding and decoding by a streaming Viterbi over piece boundaries.

A lattice position is a boundary between characters; its backpointer is the last piece of the encoding of the text up
to there. For a unigram model that is the piece of the best total score. For a BPE model it is the one piece that the
piece before it admits: two neighbours are admitted if undoing their merges, latest first, never meets an earlier merge
across their boundary, and a segmentation whose neighbours are all admitted is the one that merging yields. Only the
boundaries of the last ``longest piece`` characters can be extended, so only their paths survive: a window of that size
is kept, and ids are committed up to the boundary where the surviving paths meet.

Where no piece has a space mark after another character, all paths meet before each space mark. Such units, mostly
words, are encoded once for as long as a cache of two generations holds them, and many new ones are encoded side by
side as rows of a matrix.

Text is normalised as the model says for identity normalisation: a space mark goes in front (where the model has that),
spaces become space marks. Unknown characters become byte pieces, or the unknown id. Null and empty texts have no ids. Decoding undoes this; a
literal space mark in a text decodes as a space. Repeated rows and null doc_ids are encoded like any others, and extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import MIX

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: The piece before the first boundary. An unknown character c is the piece _UNKNOWN - ord(c).
_START, _UNKNOWN = -1, -2


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in proto.pieces):
            raise ValueError("only identity normalisation without user-defined pieces is covered")
        self.bpe, self.prefix = proto.trainer_spec.model_type == 2, proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.score = np.array([p.score for p in proto.pieces])
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.longest = max(map(len, self.ids))
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.plain = [p.piece.encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else " ⁇ ".encode() if p.type == 2 else b"" for p in proto.pieces]
        if self.bpe:
            self._learn_merges()

    # how BPE came to each piece

    def _learn_merges(self) -> None:
        n, ids = len(self.pieces), self.ids
        merged = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: -self.score[i])
        #: 0 for characters, else the place of a piece in the order of merging
        self.rank = np.zeros(n, dtype=np.int64)
        self.rank[merged] = np.arange(1, len(merged) + 1)
        pairs = {}
        for i in merged:
            p = self.pieces[i]
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = int(self.rank[i])
        order = sorted(pairs)
        self.pair_keys, self.pair_ranks = np.array(order or [-1], dtype=np.int64), np.array([pairs[k] for k in order] or [0], dtype=np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        by_rank = [0, *merged]
        self.reached = np.zeros(n, dtype=bool)
        for p, i in ids.items():
            parts = [ids.get(c, _UNKNOWN) for c in p]
            while len(parts) > 1:
                rank, at = min(((pairs.get(a * n + b, n + 1) if a >= 0 and b >= 0 else n + 1), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank > n:
                    break
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                parts[at : at + 2] = [by_rank[rank]]
            self.reached[i] = parts == [i]
        self._seen = np.full(1 << 20, -1, dtype=np.int64)
        self._said = np.zeros(1 << 20, dtype=bool)

    def _undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces b may follow pieces a."""
        n, out, at = len(self.pieces), np.ones(len(a), dtype=bool), np.arange(len(a))
        bound = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            key = a * n + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            early = (self.pair_keys[k] == key) & (self.pair_ranks[k] < bound)
            out[at[early]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~early & ((ra > 0) | (rb > 0))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            # of equal merges the left one comes first
            later = ra > rb
            bound = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def admits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces b may follow a (or the start, or an unknown character), with a table of pairs asked before."""
        out = np.ones(len(a), dtype=bool)
        ask = np.flatnonzero(a >= 0)
        key = a[ask] * len(self.pieces) + b[ask]
        slot = ((key.astype(np.uint64) * MIX[0]) >> np.uint64(44)).astype(np.int64)
        known = self._seen[slot] == key
        out[ask[known]] = self._said[slot[known]]
        if not known.all():
            new, first = np.unique(key[~known], return_index=True)
            said, into = self._undo(new // len(self.pieces), new % len(self.pieces)), slot[~known][first]
            out[ask[~known]] = said[np.searchsorted(new, key[~known])]
            self._seen[into], self._said[into] = new, said
        return out

    # characters

    def spelt(self, piece: int) -> list[int]:
        """Ids of a lattice piece."""
        return [piece] if piece >= 0 else [self.bytes[x] for x in chr(_UNKNOWN - piece).encode()] if self.bytes else [self.unknown]

    def normal(self, text: str) -> str:
        return (SPACE * self.prefix + text.replace(" ", SPACE)) if text else ""

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.plain.__getitem__, ids.tolist())).replace(SPACE.encode(), b" ")
        return raw[1 if self.prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace")


class Stream:
    """Encodes characters as they come; feed() and close() return ids as soon as they are certain."""

    def __init__(self, model: PieceModel):
        self.model, self.text = model, ""
        # of each boundary of the window: last piece, its length, total score
        self.last, self.size, self.total = [_START], [0], [0.0]

    def _step(self, char: str) -> None:
        m = self.model
        self.text += char
        i = len(self.text)
        best = None
        for n in range(min(m.longest, i), 0, -1):
            piece = m.ids.get(self.text[i - n :])
            if piece is None or i - n >= len(self.last):
                continue
            if m.bpe:
                if m.reached[piece] and m.admits(np.array([self.last[i - n]]), np.array([piece]))[0]:
                    best = (0.0, piece, n)
                    break
            elif best is None or self.total[i - n] + m.score[piece] > best[0]:
                best = (self.total[i - n] + m.score[piece], piece, n)
        if best is None:
            best = (self.total[i - 1] + m.score.min() - 10, _UNKNOWN - ord(char), 1)
        self.total.append(best[0])
        self.last.append(best[1])
        self.size.append(best[2])

    def _take(self, end: int) -> list[int]:
        """Ids up to a boundary, which becomes the first of the window."""
        parts, i = [], end
        while i > 0:
            parts.append(self.model.spelt(self.last[i]))
            i -= self.size[i]
        self.text, self.last, self.size, self.total = self.text[end:], self.last[end:], self.size[end:], self.total[end:]
        return [x for p in reversed(parts) for x in p]

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        for c in chars:
            self._step(c)
            if len(self.text) >= 4 * self.model.longest:
                # follow the surviving paths back to where they meet
                ends = set(range(len(self.text) - self.model.longest + 1, len(self.text) + 1))
                while len(ends) > 1:
                    i = max(ends)
                    ends.remove(i)
                    ends.add(i - self.size[i])
                if (meet := ends.pop()) > 0:
                    out += self._take(meet)
        return out

    def close(self) -> list[int]:
        return self._take(len(self.text))


class Matrix:
    """The same lattice for many short units of a BPE model, one row each; pieces are found by a hashed trie."""

    def __init__(self, model: PieceModel):
        self.model, nodes, edges = model, {"": 0}, {}
        chars = sorted({c for p in model.ids for c in p})
        self.letter = np.zeros(0x110000, dtype=np.int64)
        self.letter[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.letters = len(chars) + 1
        ends = {}
        for p, i in model.ids.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges[nodes[p[: k - 1]] * self.letters + int(self.letter[ord(p[k - 1])])] = nodes[p[:k]]
            if model.reached[i]:
                ends[nodes[p]] = i
        self.piece = np.full(len(nodes), -1, dtype=np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.bits = max(10, len(edges).bit_length() + 2)
        self.keys, self.child = np.full((1 << self.bits) + 64, -1, dtype=np.int64), np.zeros((1 << self.bits) + 64, dtype=np.int64)
        self.probes = 0
        for key, child in edges.items():
            at = first = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.child[at] = key, child
            self.probes = max(self.probes, at - first + 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Children, -1 where there is none."""
        key = node * self.letters + letter
        slot, out, at = self._slot(key), np.full(len(key), -1, dtype=np.int64), np.arange(len(key))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            out[at[hit]] = self.child[slot[hit]]
            on = ~hit & (there >= 0)
            if not on.any():
                break
            at, key, slot = at[on], key[on], slot[on] + 1
        return out

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all units one after the other, and how many each has."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        n, width = len(units), int(sizes.max(initial=0))
        chars = np.zeros((n, width), dtype=np.int64)
        chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        letters = self.letter[chars]
        found = np.full((min(self.model.longest, width) + 1, n, width), -1, dtype=np.int32)
        row, start = np.nonzero(letters > 0)
        node = np.zeros(len(row), dtype=np.int64)
        for k in range(1, len(found)):
            on = start + k <= sizes[row]
            row, start, node = row[on], start[on], node[on]
            node = self._next(node, letters[row, start + k - 1])
            on = node >= 0
            row, start, node = row[on], start[on], node[on]
            found[k, row, start] = self.piece[node]
        last, size = np.concatenate((np.zeros((n, 1), np.int64), _UNKNOWN - chars), 1), np.ones((n, width + 1), dtype=np.int64)
        last[:, 0] = _START
        for i in range(1, width + 1):
            todo = np.flatnonzero(sizes >= i)
            for k in range(min(len(found) - 1, i), 0, -1):
                piece = found[k, todo, i - k]
                some = np.flatnonzero(piece >= 0)
                if not len(some):
                    continue
                at, p = todo[some], piece[some].astype(np.int64)
                good = self.model.admits(last[at, i - k], p)
                last[at[good], i], size[at[good], i] = p[good], k
                rest = np.ones(len(todo), dtype=bool)
                rest[some[good]] = False
                todo = todo[rest]
                if not len(todo):
                    break
        out, pos, count = [], sizes.copy(), np.zeros(n, dtype=np.int64)
        rows = np.arange(n)
        while (on := pos > 0).any():
            out.append(np.where(on, last[rows, pos], _START))
            count += on
            pos = np.where(on, pos - size[rows, pos], 0)
        back = np.stack(out[::-1], 1) if out else np.zeros((n, 0), np.int64)
        return back[back != _START], count


class Encoder:
    def __init__(self, path: str, most: int = 250_000, widest: int = 40, together: int = 20_000):
        self.model = PieceModel(path)
        self.matrix = Matrix(self.model) if self.model.bpe else None
        self.kind = np.dtype("<u2" if len(self.model.pieces) <= 1 << 16 else "<u4")
        self.most, self.widest, self.together = most, widest, together
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _one(self, unit: str) -> bytes:
        stream = Stream(self.model)
        return np.array(stream.feed(unit) + stream.close(), self.kind).tobytes()

    def _units(self, units: list[str]) -> dict[str, bytes]:
        out = {}
        short = sorted((u for u in units if len(u) <= self.widest), key=len) if self.matrix else []
        for lo in range(0, len(short), self.together):
            part = short[lo : lo + self.together]
            pieces, count = self.matrix.encode(part)
            ends = np.cumsum(count)
            raw, size = pieces.astype(self.kind).tobytes(), self.kind.itemsize
            odd = set(np.searchsorted(ends, np.flatnonzero(pieces < 0), "right").tolist())
            at = 0
            for k, (u, end) in enumerate(zip(part, (ends * size).tolist(), strict=True)):
                out[u] = raw[at:end] if k not in odd else np.array([x for p in pieces[at // size : end // size].tolist() for x in self.model.spelt(p)], self.kind).tobytes()
                at = end
        for u in units:
            if u not in out:
                out[u] = self._one(u)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        m = self.model
        if not m.apart:
            return [np.frombuffer(self._one(m.normal(t)), self.kind) for t in texts]
        split = []
        for t in texts:
            words = t.split(" ") if t else []
            if words and (not m.prefix or SPACE in t or "" in words):
                words = _UNITS.findall(m.normal(t))
            else:
                words = [SPACE + w for w in words]
            split.append(words)
        units = set().union(*split)
        if len(self.young) + len(units) > self.most:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for u in units.difference(young):
            ids = old.get(u)
            if ids is None:
                new.append(u)
            else:
                young[u] = ids
        young.update(self._units(new))
        out = [np.frombuffer(b"".join(map(young.__getitem__, w)), self.kind) for w in split]
        for u in new:
            if len(u) > self.widest:
                del young[u]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


#: Texts that are encoded at a time.
STEP = 1000


def _stepwise(path: str, texts: list[str | None]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    for lo in range(0, len(texts), STEP):
        part = [t or "" for t in texts[lo : lo + STEP]]
        yield part, encoder(path).encode(part)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x for _, part in _stepwise(path, batch.column("text").to_pylist()) for x in part]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(path).model.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """For every row: doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), text_crc32 of the decoded text and round_trip, whether
    that is the text with each literal space mark as a space. Encoding and decoding happen in one pass, so ids need not leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts, ids in _stepwise(path, batch.column("text").to_pylist()):
                for text, x in zip(texts, ids, strict=True):
                    back = encoder(path).model.decode(x)
                    out.append((len(x), zlib.crc32(x.astype("<u4").tobytes()), zlib.crc32(back.encode()), back == text.replace(SPACE, " ")))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, [pa.int64()] * 3 + [pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_ids", "ids_crc32", "text_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean")
