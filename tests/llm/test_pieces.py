import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from quarry.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_ids string"
TEXTS = ["", "a", " a", "a ", "a  b", "   x   y  ", "a▁b", "▁", "日本語 龘龘x", "🙂 x\u0000y", "été", "\n\n  \t a", "a" * 200 + " bbbb", "w" * 3000, "Hello  world\n été", "internationalisation antidisestablishmentarianism"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [*TEXTS, *(r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect())]


def test_ids_and_texts_are_the_librarys(library, texts):
    encoder = pieces.Encoder(PATH, most=3000)
    for lo in range(0, len(texts), 50):
        for text, ids in zip(texts[lo : lo + 50], encoder.encode(texts[lo : lo + 50])):
            assert ids.tolist() == library.encode(text)
            assert encoder.model.decode(ids) == library.decode(ids.tolist())


def test_stream_commits_early_and_keeps_a_window(library):
    model = pieces.PieceModel(PATH)
    text = "thereforeunbelievably" * 200 + " and so on " * 50
    stream, out, widest, first = pieces.Stream(model), [], 0, None
    for i, c in enumerate(model.normal(text)):
        out += stream.feed(c)
        widest = max(widest, len(stream.text))
        first = first or (i if out else None)
    assert out + stream.close() == library.encode(text)
    assert first < 200 and widest <= 8 * model.longest


def test_unigram_scores(tmp_path, texts):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    rng = np.random.default_rng(0)
    for p in proto.pieces:
        if p.type == 1:
            p.score = float(-2 - 9 * rng.random())  # no ties
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(proto.SerializeToString())
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    for text in [*TEXTS[:12], *(t[:400] for t in texts[-20:])]:
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_tables(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, None, "x", "y"), (3, TEXTS[3], "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = {r.doc_id: r.ids for r in pieces.encoded(df, PATH).collect()}
    assert ids == {i: library.encode(t) for i, t in enumerate(TEXTS)} | {None: []}
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(df, PATH), PATH).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(TEXTS)} | {None: ""}
    for r in pieces.digests(df, PATH).collect():
        want = np.array(ids[r.doc_id], "<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip, r.text_crc32) == (len(want), zlib.crc32(want.tobytes()), True, zlib.crc32(back[r.doc_id].encode()))
    assert pieces.digests(spark.createDataFrame([], SCHEMA), PATH).count() == 0
