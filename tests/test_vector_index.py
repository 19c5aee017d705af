"""The vector index against the scan, over whole tables and awkward ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.operators.vector_index import VectorIndex
from quarry.sources import views

SCHEMA = "id long, source_name string, version string, content string, embedding array<float>"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, f"s{i % 3}", f"v{i % 2}", f"text {first + i}", None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def hits(df):
    return [(r.id, round(r.similarity, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    return centres[rng.integers(0, 40, 3000)] + 0.15 * rng.normal(size=(3000, 24))


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    return VectorIndex.build(frame(spark, clustered), f"{tmp_path_factory.mktemp('index')}/a", 40)


def test_search_is_exact(spark, clustered, index):
    rows = frame(spark, clustered).cache()
    rng = np.random.default_rng(2)
    for query in (clustered[5], rng.normal(size=24), -clustered[9]):
        query = query.tolist()
        assert hits(index.search(query, 10)) == hits(search.vector_search(rows, query, 10))
        assert hits(index.search(query, 7, "s1", "v0", 0.1)) == hits(search.vector_search(rows, query, 7, "s1", "v0", 0.1))
        assert index.search(query, 3).columns == search.vector_search(rows, query, 3).columns


def test_probes_read_little_and_find_nearly_all(clustered, index):
    queries = clustered[::400]
    unit = clustered / np.linalg.norm(clustered, axis=1, keepdims=True)
    found = 0
    for q in queries:
        want = np.argsort(-(unit @ q))[:10]
        found += len({r.id for r in index.search(q.tolist(), 10, probes=2).collect()} & {*want.tolist()})
        lists = index.bounds(q / np.linalg.norm(q))
        assert sum(x[3] for x in lists[:2]) < 0.1 * len(clustered)
        assert index.read(q / np.linalg.norm(q), 10).count() < 0.05 * len(clustered)
    assert found >= 0.95 * 10 * len(queries)


def test_caps_hold_their_vectors(index):
    unit = np.zeros(24)
    unit[3] = 1
    best = {r.list: r.high for r in index._candidates(unit, [*range(len(index.centroids))], 3000, None, None).groupBy("list").agg(F.max("low").alias("high")).collect()}
    for number, _, bound, n in index.bounds(unit):
        assert n and best[number] <= bound + 1e-6


def test_codes_bound_the_cosine(clustered, index):
    unit = np.random.default_rng(3).normal(size=24)
    unit /= np.linalg.norm(unit)
    want = (clustered / np.linalg.norm(clustered, axis=1, keepdims=True)) @ unit
    rows = index._candidates(unit, [*range(len(index.centroids))], 3000, None, None).collect()
    assert len(rows) == 3000 and all(r.low <= want[r.id] <= r.high and r.high - r.low < 0.05 for r in rows)


def test_add_remove_and_compact(spark, clustered, tmp_path):
    index = VectorIndex.build(frame(spark, clustered[:500]), f"{tmp_path}/a", 10)
    index.add(frame(spark, [clustered[700]] * 2 + [clustered[499]], 498))
    index.remove(spark.createDataFrame([(3,), (498,), (9999,)], "id long"))
    index.add(frame(spark, [clustered[3]], 3))
    now = frame(spark, clustered[:498]).unionByName(frame(spark, [clustered[700]] * 2 + [clustered[499]], 498)).where("id NOT IN (3, 498)").unionByName(frame(spark, [clustered[3]], 3))
    again = index.compacted(f"{tmp_path}/b")
    for query in (clustered[700].tolist(), clustered[3].tolist()):
        want = hits(search.vector_search(now, query, 8))
        assert hits(index.search(query, 8)) == want == hits(again.search(query, 8))


def test_rows_without_direction_and_copies(spark, tmp_path):
    vectors = [[1, 0]] * 200 + [None, [], [0, 0], [math.nan, 1], [None, 1], [1, 2, 3], [0.6, 0.8], [math.inf, 0]]
    rows = frame(spark, vectors)
    index = VectorIndex.build(rows, f"{tmp_path}/a", 4)
    assert hits(index.search([1, 0], 5)) == [(i, 1.0) for i in range(5)]
    assert [(i, round(s, 6)) for i, s in hits(index.search([0, 1], 1))] == [(206, 0.8)]
    assert len(hits(index.search([1, 1], 1000))) == 201
    assert hits(index.search([1, 0, 0], 5)) == hits(index.search([0, 0], 5)) == hits(index.search([1, 0], 0)) == []


def test_empty_table(spark, tmp_path):
    index = VectorIndex.build(frame(spark, []), f"{tmp_path}/a")
    assert index.search([1.0, 0.0], 3).collect() == []


def test_chunks_of_the_tables(spark, sf, tmp_path):
    chunks = views.chunks(spark, sf)
    index = VectorIndex.build(chunks, f"{tmp_path}/a")
    query = [((i * 37) % 101 - 50) / 50 for i in range(64)]
    assert hits(index.search(query, 10, "src1")) == hits(search.vector_search(chunks, query, 10, "src1"))
