"""Class-based scores against plain loops; exchange against the likelihood it climbs."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import brown
from quarry.llm.queries import QUERIES, held_out


def words(text):
    return brown.words_of((text or "").encode())


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def brute(rows, model):
    """By row: counts, the base score, and the score by the model's classes, transitions counted anew."""
    texts = [(d, words(t)) for d, t in rows]
    c = Counter(w for d, t in texts if not is_held(d) for w in t)
    n, k = sum(c.values()), brown.CLASSES + 1
    own = {w: int(model.classes[model.unit_of(w, c[w])]) for w in {w for _, t in texts for w in t}}
    table, mass = np.zeros((k, k)), np.zeros(k)
    mass[-1] = brown.ADD
    for w in c:
        mass[own[w]] += c[w] + brown.ADD
    for d, t in texts:
        if not is_held(d):
            for a, b in zip([t[-1], *t], t):
                table[own[a], own[b]] += 1
    p = (table + brown.PRIOR * mass / mass.sum()) / (table.sum(1, keepdims=True) + brown.PRIOR)
    out = []
    for d, t in texts:
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t)
        score = sum(np.log10(p[own[a], own[b]] * (c[b] + brown.ADD) / mass[own[b]]) for a, b in zip([t[-1], *t], t))
        out.append((d, is_held(d), len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out, p, mass


def same(got, want):
    key = lambda r: (r[0] is not None, r[0], r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_query_equals_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model, texts = brown.fit(docs, held_out(10, 0))
    want, p, _ = brute([(r.doc_id, r.text) for r in docs.collect()], model)
    same([tuple(r) for r in brown.scored(texts, model).collect()], want)
    assert np.allclose(p.sum(1), 1)
    df = QUERIES["op13_brown_lm"](spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    same([tuple(r) for r in df.collect()], want)
    by = {r.held_out: r for r in brown.perplexity(df).collect()}
    assert all(r.perplexity < r.base_perplexity for r in by.values())


def test_blocks_do_not_change_scores(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = []
    for parts in (1, 7):
        model, texts = brown.fit(docs.repartition(parts), held_out(10, 0))
        got.append(sorted(tuple(r) for r in brown.scored(texts, model).collect()))
        same(got[-1], brute(rows, model)[0])
    assert np.allclose([r[5:] for r in got[0]], [r[5:] for r in got[1]])


def test_edge_cases(spark):
    texts = [None, "", " \n", "The THE the", "É é", "one two\x00three", "the " * 3000, "x" * 70_000, None, "a b", "a b"]
    docs = spark.createDataFrame([(None if i == 5 else min(i, 9), t, True, 1.0, "w") for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean, mass double, unit string")
    model, coded = brown.fit(docs, held_out(10, 0))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same([tuple(r) for r in brown.scored(coded, model).collect()], brute(rows, model)[0])


def test_empty_table_and_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, coded = brown.fit(docs, held_out(10, 0))
    assert (model.n, model.v) == (0, 0) and brown.scored(coded, model).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, coded = brown.fit(docs, F.lit(True))
    got = sorted(brown.scored(coded, model).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0), (1, 0, 0)]
    assert [r.base_score for r in got] == pytest.approx([0, 0]) and [r.score for r in got] == pytest.approx([0, 0])


def grammar(seed, n):
    """Sentences of article, adjective, noun, verb; and the counts of their bigrams."""
    rng = np.random.default_rng(seed)
    kinds = [range(0, 4), range(4, 12), range(12, 24), range(24, 34)]
    text = [int(rng.choice(k)) for _ in range(n) for k in kinds]
    table = np.zeros((34, 34))
    np.add.at(table, (text[:-1], text[1:]), 1)
    order = np.argsort(-table.sum(1), kind="stable")
    return table[np.ix_(order, order)], np.repeat([0, 1, 2, 3], [4, 8, 12, 10])[order]


def test_exchange_finds_the_classes_of_a_grammar():
    table, kinds = grammar(1, 4000)
    found = brown.exchange(table, 4)
    assert {(a, b) for a, b in zip(found.tolist(), kinds.tolist(), strict=True)} == {(found[np.flatnonzero(kinds == k)[0]], k) for k in range(4)}


def test_exchange_climbs_and_ends_where_no_word_gains():
    table, _ = grammar(2, 300)
    value = [brown.likelihood(brown.class_table(table, brown.exchange(table, 5, sweeps), 5)) for sweeps in (0, 1, 2, 3, 50)]
    assert all(b >= a - 1e-9 for a, b in zip(value, value[1:]))
    found = brown.exchange(table, 5, 50)
    for w in range(len(table)):
        for k in range(5):
            moved = found.copy()
            moved[w] = k
            assert brown.likelihood(brown.class_table(table, moved, 5)) <= value[-1] + 1e-6


def test_buckets_go_where_their_neighbours_gain_most(spark, monkeypatch):
    monkeypatch.setattr(brown, "EVENTS", 8)
    table, _ = grammar(3, 500)
    core = brown.exchange(table, 4)
    classes = brown.class_table(table, core, 4)
    padded = np.append(core, np.zeros(brown.CORE - len(core), np.int64))
    rng = np.random.default_rng(5)
    rows, seen = [], Counter()
    for i in range(60):
        bucket, a, b = int(rng.integers(0, 9)), int(rng.integers(0, 34)), int(rng.integers(0, 34))
        rows.append((i, False, brown._planes(np.array([a + 1, 1 + brown.CORE + bucket, b + 1]))))
        seen[bucket, core[a], "before"] += 1
        seen[bucket, core[b], "after"] += 1
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, units binary").repartition(3)
    got = brown.bucket_classes(docs, padded, classes)
    for bucket in range(9):
        values = []
        for k in range(4):
            new = classes.copy()
            for (x, c, side), n in seen.items():
                if x == bucket:
                    new[(c, k) if side == "before" else (k, c)] += n
            values.append(brown.likelihood(new))
        if any(x == bucket for x, _, _ in seen):
            assert values[got[bucket]] == pytest.approx(max(values))


def test_packed_numbers():
    for ids in ([], [0, 65534, 65535, 70000, 1 << 31], [7]):
        assert brown._unpacked(brown._packed(np.array(ids, np.int64))).tolist() == ids
