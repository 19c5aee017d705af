import random

import numpy as np
import pytest

from quarry.llm import toxicity

SCHEMA = "doc_id long, text string, toxic string, score string"


def test_search_is_exact():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(700):
        ids = rng.choice(40, rng.integers(1, 6), replace=False)
        w = rng.random(len(ids))
        rows.append((ids, w / np.sqrt((w * w).sum())))
    dense = np.zeros((700, 40))
    for i, (ids, w) in enumerate(rows):
        dense[i, ids] = w
    index = toxicity.BlockMaxIndex(40, rows)
    for q in range(0, 700, 7):
        full = dense @ dense[q]
        want = np.lexsort((np.arange(700), -full))[:15]
        found, cosine = index.search(*rows[q], 15)
        np.testing.assert_allclose(cosine, full[want][full[want] > 0], atol=1e-12)
        assert len(set(found)) == len(found)


def corpus(n=600, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(4000)]
    bad = ["scoundrel", "knave"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = rnd.choices(words, k=80), i % 6 == 0
        if toxic:
            text.insert(rnd.randrange(80), rnd.choice([*bad, "zzorp" + rnd.choice(words)]).title() + rnd.choice(["", "!", ","]))
        rows.append((i, " ".join(text), "x", "y"))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    train = spark.createDataFrame([*labels[:400], (10**6, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    return docs, dict(labels), toxicity.fit(docs, train)


def test_held_out(fitted):
    docs, labels, model = fitted
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(labels) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in labels if i >= 400]
    assert np.mean([(got[i].score >= 0.5) == labels[i] for i in held]) > 0.97
    assert all(got[i].evidence for i in held if got[i].score >= 0.5)


def test_edges(spark, fitted):
    _, _, model = fitted
    odd = spark.createDataFrame([(None, None, "x", "y"), (1, "", "x", "y"), (1, "", "x", "y"), (2, "knave " * 300_000, "x", "y")], SCHEMA)
    scores = [r.score for r in toxicity.scored(odd, model).orderBy("score").collect()]
    assert scores[0] == scores[1] == scores[2] < 0.5 < scores[3]
    kept = toxicity.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3


def test_no_labels_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.scored(spark.createDataFrame([(1, "a", "", "")], SCHEMA), model).first().score == 0.5


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    x = rng.random(500)
    px, py = toxicity.isotonic(x, (rng.random(500) < x).astype(int), np.ones(500))
    assert (np.diff(px) > 0).all() and (np.diff(py) >= 0).all() and np.abs(np.interp([0.2, 0.8], px, py) - [0.2, 0.8]).max() < 0.15
