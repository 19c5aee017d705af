"""The queries of the training-data operators over the small tables: columns, folds, digests, and their SQL."""

import shutil
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quarry.llm.packing import ByteEncoder
from quarry.llm.queries import ORACLES, QUERIES, tokenizer_file
from test_quality import brute as brute_counts
from test_simhash import brute as brute_simhash

COLUMNS = {
    "op1_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op11_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_brown_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.fixture(scope="module")
def results(spark, sf):
    found = {}

    def get(name):
        if name not in found:
            df = QUERIES[name](spark, sf)
            found[name] = {f.name: f.dataType.simpleString() for f in df.schema}, df.collect()
        return found[name]

    return get


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(results, texts, name):
    kinds, rows = results(name)
    assert rows
    for c in COLUMNS.get(name, "").split(", ") if name in COLUMNS else []:
        column, kind = c.split(" ")
        assert kinds[column] == kind
    if "doc_id" in kinds and name != "op7_packing":
        assert sorted(r.doc_id for r in rows) == sorted(texts)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(results, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in results(name)[1]), key=str)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name, modulus, remainder, limit", [("op1_quality_classifier", 4, 2, 0.7), ("op5_toxicity", 5, 0, 0.5)])
def test_folds_and_predictions(results, name, modulus, remainder, limit):
    for r in results(name)[1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)


@pytest.mark.parametrize("name, label", [("op1_quality_classifier", "quality"), ("op5_toxicity", "toxic")])
def test_held_out_labels_and_other_columns_leave_scores_alone(spark, sf, tmp_path, results, name, label):
    modulus, remainder = (4, 2) if label == "quality" else (5, 0)
    held = f"crc32(CAST(doc_id AS STRING)) % {modulus} = {remainder}"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels.selectExpr("doc_id", *(f"CAST(CASE WHEN {held} THEN 1 - {c} ELSE {c} END AS INT) AS {c}" if c == label else f"CAST(1 - {c} AS INT) AS {c}" for c in ("quality", "toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.selectExpr("doc_id", "text", "'xx' AS lang", "concat('other', doc_id) AS source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({r.doc_id: r.score for r in results(name)[1]}, abs=1e-9)
    shutil.rmtree(tmp_path)


def test_fingerprints_and_components(results, texts):
    want = {(d, f, c) for d, f, c in brute_simhash([(i, t) for i, t in texts.items()])}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in results("op6_simhash")[1]} == want


def test_pieces_hold_the_ids_of_each_text(results, texts):
    encoder = ByteEncoder(tokenizer_file(), fast=False)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in results("op7_packing")[1]:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_shards_are_a_law_of_rows(results, texts):
    rows, by = results("op8_sharding")[1], defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None) and 0 <= r.shard < 8
        by[r.shard].append(r.slot)
    assert len(by) == 8 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_base_rules(results, texts):
    for r in results("op10_quality_rules")[1]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == tuple(brute_counts(texts[r.doc_id]))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
