"""The stored keyword index against the scan, plain loops, and itself after changes."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions.stemming import stem
from quarry.operators import keyword_index as ki
from quarry.operators import search
from quarry.operators.search import B, K1, _split, stop_words
from quarry.sources import views

SCHEMA = "id long, source_name string, version string, content string, embedding array<float>"
WORDS = "run running runs cat cats dog the of and quick quickly brown foxes fox été für 42 jump jumping over lazy".split()


def some(n, seed=0, first=0):
    rng = random.Random(seed)
    return [(first + i, f"s{i % 3}", f"v{i % 2}", " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 8, 40, 200]))) if i % 17 else None, None) for i in range(n)]


def terms(text, simple):
    return [(w if simple else stem(w), k) for k, w in enumerate(_split(text or "")) if simple or w not in stop_words()]


def brute(rows, query, limit, simple=False, source=None):
    docs = [(r[0], terms(r[3], simple), len(_split(r[3] or "")), r[1]) for r in rows]
    wanted = sorted({t for t, _ in terms(query, simple)})
    tf = [Counter(t for t, _ in d[1]) for d in docs]
    average, df = sum(d[2] for d in docs) / len(docs), {t: sum(t in c for c in tf) for t in wanted}
    out = []
    for d, c in zip(docs, tf):
        if wanted and all(c[t] for t in wanted) and source in (None, d[3]):
            out.append((-sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (K1 + 1) / (c[t] + K1 * (1 - B + B * d[2] / average)) for t in wanted), d[0]))
    return [(i, round(-s, 9)) for s, i in sorted(out)[:limit]]


def brute_covers(rows, query, limit, simple=False):
    wanted, out = {t for t, _ in terms(query, simple)}, []
    for r in rows:
        places = [(k, t) for t, k in terms(r[3], simple) if t in wanted]
        covers = set()
        for i, (a, _) in enumerate(places):
            for b, _ in places[i:]:
                if {t for k, t in places if a <= k <= b} == wanted:
                    covers.add((a, b))
                    break
        least = [(a, b) for a, b in covers if not any((c, d) != (a, b) and a <= c and d <= b for c, d in covers)]
        if least:
            out.append((-sum(1 / (1 + b - a + 1 - len(wanted)) for a, b in least), r[0]))
    return [(i, round(-s, 9)) for s, i in sorted(out)[:limit]]


def hits(df):
    return [(r.id, round(r.similarity, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    old = ki.BLOCK, ki.FIRST
    ki.BLOCK, ki.FIRST = 16, 3
    yield ki.KeywordIndex.build(spark.createDataFrame(some(300), SCHEMA), f"{tmp_path_factory.mktemp('keywords')}/a")
    ki.BLOCK, ki.FIRST = old


@pytest.mark.parametrize("query, source", [("running cats", None), ("the quickly jumped fox", "s1"), ("für 42", None), ("the of", None), ("cat zebra", None), ("", None)])
def test_ranked_equals_brute_force(index, query, source):
    assert hits(index.search(query, 12, source=source)) == brute(some(300), query, 12, source=source)


def test_columns_are_those_of_the_scan(spark, index):
    rows = spark.createDataFrame(some(30), SCHEMA)
    assert sorted(index.search("running cats", 9).columns) == sorted(search.keyword_search(rows, "running cats", 9).columns)


@pytest.mark.parametrize("query", ["running cats dogs", "fox"])
def test_cover_density(index, query):
    assert hits(index.search(query, 20, near=True)) == brute_covers(some(300), query, 20)


def test_blocks_bound_scores_and_some_are_left_out(spark, index):
    all_terms = ["cat", "run"]
    n, average, counts = index.frequencies(all_terms)
    most, scores = defaultdict(float), defaultdict(float)
    for r in index.postings(all_terms).collect():
        weight = math.log(1 + (n - counts[r.term] + 0.5) / (counts[r.term] + 0.5))
        most[r.block] += weight * r.max_tf * (K1 + 1) / (r.max_tf + K1 * (1 - B + B * r.min_length / average))
        assert r.n == len(r.entries) and r.max_tf == max(e.tf for e in r.entries) and r.min_length == min(e.length for e in r.entries)
        for e in r.entries:
            scores[r.block, e.id] += weight * e.tf * (K1 + 1) / (e.tf + K1 * (1 - B + B * e.length / average))
    assert all(s <= most[b] + 1e-9 for (b, _), s in scores.items())
    tenth = hits(index.search("running cats", 10))[-1][1]
    assert sum(m < tenth for m in most.values()) > len(most) // 4


def test_a_query_reads_the_partitions_of_its_terms(index):
    plan = index.postings(["cat"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]
    assert len(index.postings(["cat"]).inputFiles()) >= 1 and {r.term for r in index.postings(["cat", "fox"]).collect()} == {"cat", "fox"}


def test_changes_equal_a_new_index(spark, tmp_path):
    old, new = some(120), some(40, 7, 100)
    index = ki.KeywordIndex.build(spark.createDataFrame(old, SCHEMA), f"{tmp_path}/a")
    index.add(spark.createDataFrame(new, SCHEMA))
    index.remove(spark.createDataFrame([(5,), (101,), (999,)], "id long"))
    index.add(spark.createDataFrame([(5, "s0", "v0", "cat running cat", None)], SCHEMA))
    now = [r for r in old if r[0] < 100 and r[0] != 5] + [r for r in new if r[0] != 101] + [(5, "s0", "v0", "cat running cat", None)]
    again = index.compacted(f"{tmp_path}/b")
    for query in ("running cat", "für"):
        want = brute(now, query, 15)
        assert want and hits(index.search(query, 15)) == want == hits(again.search(query, 15))


def test_simple_words(spark, tmp_path):
    rows = some(80, 3)
    index = ki.KeywordIndex.build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a", simple=True)
    assert hits(index.search("the running", 10)) == brute(rows, "the running", 10, simple=True)


def test_whole_table(spark, sf, tmp_path):
    chunks = views.chunks(spark, sf)
    rows = [(r.id, r.source_name, r.version, r.content) for r in chunks.collect()]
    index = ki.KeywordIndex.build(chunks, f"{tmp_path}/a")
    for query in ("hati ered", "für ü"):
        assert hits(index.search(query, 20)) == brute(rows, query, 20)


def test_empty_table(spark, tmp_path):
    index = ki.KeywordIndex.build(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert index.search("cat", 3).collect() == index.search("cat", 3, near=True).collect() == []
    index.add(spark.createDataFrame([(1, "s", "v", "a cat", None)], SCHEMA))
    assert [r.id for r in index.search("cats", 3).collect()] == [1]


def most_memory(spark):
    """MB that each Python worker has held at most so far."""

    def told(batches):
        import resource

        import pandas as pd

        for _ in batches:
            pass
        yield pd.DataFrame({"pid": [os.getpid()], "mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    return {r.pid: r.mb for r in spark.range(64).repartition(64).mapInPandas(told, "pid long, mb double").collect()}


@pytest.mark.parametrize("simple", [True, False])
def test_a_task_holds_few_words(spark, tmp_path, simple):
    words = F.transform(F.sequence(F.lit(0), F.lit(599)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50_000))))
    docs = spark.range(10_000).coalesce(1).select("id", F.array_join(words, " ").alias("content"))
    before = most_memory(spark)
    index = ki.KeywordIndex.build(docs, f"{tmp_path}/a", simple)
    after = most_memory(spark)
    assert index.rows_of_terms().agg(F.sum("documents")).first()[0] > 5_900_000
    assert max(mb - before.get(pid, 120) for pid, mb in after.items()) < 500


def test_blocks_are_cut_and_no_document_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ki, "BLOCK", 8)
    monkeypatch.setattr(ki, "WORDS", 100)
    rows = [(7, "s0", "v0", f"cat dog{i % 40} {'run ' * (i % 90)}", None) for i in range(150)] + [(i, "s1", "v1", "cat " * 700 if i == 400 else "cat fox", None) for i in range(300, 420)]
    index = ki.KeywordIndex.build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a")
    found = index.postings(["cat"]).collect()
    assert sum(r.n for r in found) == len(rows) and len({r.block for r in found}) == len(found) and max(r.n for r in found) <= 32
    for r in found:
        assert sum(e.length for e in r.entries) <= 200 or r.n == 1
        assert all(len(e.positions) == e.tf == (700 if e.id == 400 else 1) and [*e.positions] == [*range(e.tf)] for e in r.entries)
    assert {(r.term, r.documents) for r in index.rows_of_terms().collect() if r.term in ("run", "fox")} == {("run", sum(i % 90 > 0 for i in range(150))), ("fox", 119)}


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """An index whose blocks are cut often."""
    old = ki.BLOCK, ki.WORDS, ki.FIRST
    ki.BLOCK, ki.WORDS, ki.FIRST = 2, 120, 2
    yield ki.KeywordIndex.build(spark.createDataFrame(some(200, 5), SCHEMA).coalesce(1), f"{tmp_path_factory.mktemp('keywords')}/a")
    ki.BLOCK, ki.WORDS, ki.FIRST = old


@pytest.mark.parametrize("query, source", [("running cats", None), ("quickly jumping", "s2")])
def test_ranked_over_cut_blocks(cut, query, source):
    assert hits(cut.ranked(query, 15, source=source)) == brute(some(200, 5), query, 15, source=source)


@pytest.mark.parametrize("query", ["running cats dogs", "quickly jumping"])
def test_cover_density_over_cut_blocks(cut, query):
    assert hits(cut.proximate(query, 15)) == brute_covers(some(200, 5), query, 15)
