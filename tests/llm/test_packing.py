import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, key string"
TEXTS = ["", None, "a", " a", "a ", "a  b", "a   b", "  ", "foo\n \nbar", "foo\n bar", "x \n y", "été  b", "it's  <|endoftext|> done ", "word " * 5000, "w" * 30_000, "\ttab", "a  b c", "ab\r\n cd"]


def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}


@pytest.fixture
def pieces(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)]
    return packing.packed(spark.createDataFrame(rows, SCHEMA), PATH, size=64).collect()


def test_every_id_once(pieces):
    want = reference()
    for doc, ids in want.items():
        own = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids
        assert np.cumsum([0, *(p.length for p in own)])[:-1].tolist() == [p.start for p in own]
        assert {p.doc_tokens for p in own} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in own)


def test_sequences_have_no_gaps_and_are_full(pieces):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    sizes = []
    for own in by.values():
        own.sort(key=lambda p: p.offset)
        assert np.cumsum([0, *(p.length for p in own)])[:-1].tolist() == [p.offset for p in own]
        sizes.append(sum(p.length for p in own))
    assert max(sizes) <= 64 and sum(s < 64 for s in sizes) <= 4


def test_hilbert_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_empty_table_nulls_and_repeats(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    got = packing.packed(spark.createDataFrame([(None, None, "", ""), (None, None, "", ""), (3, "a", "", ""), (3, "a", "", "")], SCHEMA), PATH)
    assert got.count() == 4


def test_fast_ids_are_the_tokenizers_ids(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for t in TEXTS]
    texts += ["\u00a0x \u2003 y\u0085z\u3000", "١٢٣ ４５ Ⅷ ²", "a\u0301e\u0301 \u200b \ufeff", "日本語 テキスト", "🙂🙃 x", "\x1c \x00 \x7f", "don't DON'T we'll"]
    quick, plain = packing.ByteEncoder(PATH), packing.ByteEncoder(PATH, fast=False)
    assert quick.ranks is not None and plain.ranks is None
    assert quick.encode(texts) == plain.encode(texts)
