import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quarry.llm import toxicity
from quarry.llm.common import hash_sample, slices
from test_toxicity import SCHEMA, corpus


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    return rows, docs, toxicity.fit(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))


def test_every_text_with_a_known_term_gets_its_exact_neighbours(fitted):
    rows, docs, model = fitted
    assert set(model.vocabulary) == {t for i in model.doc_ids for w in rows[i][1].lower().split() for t in toxicity.terms_of(w)}
    assert (model.weights > 0).all()
    dense = np.zeros((len(model.doc_ids), len(model.vocabulary)))
    for i, (ids, weights) in enumerate(model.index.rows):
        dense[i, ids] = weights
    at, terms = {d: i for i, d in enumerate(model.doc_ids)}, toxicity.Terms(model.vocabulary)
    for r in toxicity.scored(docs, model).where("doc_id >= 400").collect():
        _, ids, counts = terms.count(pa.array([rows[r.doc_id][1]]))
        ids, weights = model.vector(ids, counts)
        full = dense[:, ids] @ weights
        assert len(r.evidence) == 3
        np.testing.assert_allclose([e.similarity for e in r.evidence], np.sort(full)[::-1][:3], atol=1e-12)
        np.testing.assert_allclose([full[at[e.doc_id]] for e in r.evidence], [e.similarity for e in r.evidence], atol=1e-12)
        found, cosine = model.index.search(ids, weights, model.k)
        np.testing.assert_allclose(cosine, np.sort(full)[::-1][: model.k], atol=1e-12)
        np.testing.assert_allclose(full[found], cosine, atol=1e-12)


def test_index_without_examples_finds_nothing():
    found, cosine = toxicity.BlockMaxIndex(3, []).search(np.array([0, 2]), np.array([0.6, 0.8]), 15)
    assert not len(found) and not len(cosine)


def test_counts_are_those_of_plain_python():
    texts = ["The cat, the CAT!", None, "", "  ... ", "b\u3000a \tb\n", "x " * 50_000 + "cat"]
    terms = toxicity.Terms(["the", "cat", "b", "x"])
    starts, ids, counts = terms.count(pa.array(texts))
    got = [dict(zip(ids[lo:hi].tolist(), counts[lo:hi].tolist(), strict=True)) for lo, hi in zip(starts, starts[1:])]
    assert got == [{0: 2, 1: 2}, {}, {}, {}, {2: 2}, {1: 1, 3: 50_000}]


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n is not None else None for n in (3, None, 10, 0, 4, 4)]), pa.array(range(6))], ["text", "n"])
    cut = list(slices(iter([batch, batch.slice(0, 0)]), "text", 8))
    assert [b.column("n").to_pylist() for b in cut] == [[0, 1], [2], [3, 4, 5], []]


def test_hash_sample_takes_the_least_hashes(spark):
    rows = spark.range(0, 20_000, 1, 200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in hash_sample(rows, 500, 20_000).collect()}
    assert got == {r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(500).collect()}
    bound = hash_sample(rows, 500, 20_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in bound  # rows past the bound never reach the sort
    assert hash_sample(rows, 50_000, 20_000).count() == 20_000
