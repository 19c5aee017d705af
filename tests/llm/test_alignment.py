"""Alignment against whole texts encoded by both libraries and cut by brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import alignment
from quarry.llm.queries import QUERIES, tokenizer_file

A, B = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")


def brute(text):
    """Groups of a text as (A ids, B ids), None without tokens."""
    words = alignment.vocabularies(A, B)
    if not text:
        return None
    sides = [(words.a.encode(" " + text, add_special_tokens=False).ids, words.a_bytes), (words.b.encode(text), words.b_bytes)]
    ends = []
    for ids, table in sides:
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        ends.append(np.cumsum([len(table[i]) for i in ids]).tolist())
    out, at = [], [0, 0]
    for cut in sorted({*ends[0]} & {*ends[1]}):
        group = []
        for k in (0, 1):
            past = ends[k].index(cut, at[k]) + 1
            group.append(tuple(sides[k][0][at[k] : past]))
            at[k] = past
        out.append(tuple(group))
    return out


def expected(texts):
    found = [brute(t) for t in texts]
    count = Counter((a[-1], b[-1]) for g in found if g for a, b in g)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for g in found:
        links = [(a[-1], b[-1]) for a, b in g or ()]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        digest = hashlib.sha256(told.encode()).hexdigest() if g else ""
        out.append((sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "日本", "𠮷", "<|endoftext|>", "</s>", "<s>", "<0x41>", "12", "...", " ", "\x1c", "　", "Ａ", "\x00", "▁", "ing", "\r\n", "é", "👍🏽", " ", "|", " x", "\x85"]


def some_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_units_keep_the_groups_of_whole_texts():
    texts = [*some_texts(3000, 4), "日" * 3000, "a" * 20_000, " " * 50, "\n" * 9, " a", " a ", "a  b", "x" * 200 + " " + "y" * 200]
    done = alignment.Aligned(alignment.vocabularies(A, B))
    for lo in range(0, len(texts), 500):
        for text, at in zip(texts[lo : lo + 500], done.of(texts[lo : lo + 500]), strict=True):
            want = brute(text)
            assert (at is None) == (want is None)
            if want:
                assert done.groups_of(at) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
                assert done.words.pairs[done.pairs_of(at)].tolist() == [a[-1] * len(done.words.b_bytes) + b[-1] for a, b in want]


def test_kept_units_are_dropped_and_found_again(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 2)
    done = alignment.Aligned(alignment.vocabularies(A, B))
    for text in ("one two three one", "four five", "one two three", "six seven", "one six"):
        (at,) = done.of([text])
        assert done.groups_of(at) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute(text))
        assert done.words.pairs[done.pairs_of(at)].tolist() == [a[-1] * len(done.words.b_bytes) + b[-1] for a, b in brute(text)]
    assert "one" in done.known and "four" not in done.known  # what came once was dropped


def test_query_equals_brute_force(spark, sf):
    df = QUERIES["op12_alignment"](spark, sf)
    assert dict(df.dtypes) == {c: "bigint" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups_sha256": "string"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == sorted((d.doc_id, *w) for d, w in zip(docs, expected([d.text for d in docs]), strict=True))


def test_edge_cases(spark):
    texts = [None, "", "a▁b", "plain words", "plain words", "日本 語", *some_texts(200, 9)]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, links string, n_a int")
    got = sorted((tuple(r) for r in alignment.aligned(docs, A, B).collect()), key=lambda r: (r[0] is not None, r[0]))
    want = sorted(((None if i == 3 else i, *w) for i, w in enumerate(expected(texts))), key=lambda r: (r[0] is not None, r[0]))
    assert got == want
    assert got[1] == (0, 0, 0, 0, 0, 0, 0, "")
    assert alignment.aligned(docs.limit(0), A, B).collect() == []


def test_groups_cover_the_bytes(spark):
    texts = ["héllo 日本 words", "two  spaces", None, "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, text in enumerate(texts):
        rows = sorted((r for r in alignment.groups(docs, A, B).collect() if r.doc_id == i), key=lambda r: r.number)
        assert [(tuple(r.a_ids), tuple(r.b_ids)) for r in rows] == (brute(text) or [])
        if rows:
            raw, table = (" " + text).encode(), alignment.vocabularies(A, B).b_bytes
            assert [raw[r.first : r.past] for r in rows] == [b"".join(table[b] for b in r.b_ids) for r in rows] and rows[-1].past == len(raw)


def test_pair_counts(spark):
    docs = spark.createDataFrame(list(enumerate(["the cat", "the dog", "the the"])), "doc_id long, text string")
    got = {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(alignment.encoded(docs, A, B), A, B).collect()}
    want = Counter((a[-1], b[-1]) for t in ("the cat", "the dog", "the the") for a, b in brute(t))
    assert got == want and max(want.values()) == 4


@pytest.mark.parametrize("text, count", [("a b", 2), ("a  b", 1), (" a", 1), ("a ", 1), ("a\nb c", 2), ("a  b", 1), ("a 　b", 1)])
def test_units(text, count):
    found = alignment.units(text)
    assert len(found) == count and " ".join(found) == text
