import pytest
from pyspark.sql import functions as F

from quarry.functions.stemming import stem
from quarry.operators import render, search, upkeep


def hits(spark, ids):
    return spark.createDataFrame([(i, f"t{i}", 1.0 - n / 100) for n, i in enumerate(ids)], "id long, title string, similarity double")


def fuse(spark, v, k, limit=10):
    return [(r.id, round(r.similarity, 6)) for r in search.fused(hits(spark, v), hits(spark, k), limit).collect()]


def test_fusion(spark):
    assert fuse(spark, [1, 2], [3]) == [(1, round(1 / 61, 6)), (3, round(1 / 61, 6)), (2, round(1 / 62, 6))]
    assert fuse(spark, [5, 6], [5]) == [(5, round(2 / 61, 6)), (6, round(1 / 62, 6))]
    assert fuse(spark, [], []) == [] and fuse(spark, [1], [2], 0) == [] and [i for i, _ in fuse(spark, [], [4, 2])] == [4, 2]
    assert len(fuse(spark, range(40), range(20, 60), 50)) == 50


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "docs", "v1", "Cats running quickly.\nA cat ran", [1.0, 0.0], "a.md", '{"confidence": 0.9}'), (2, "docs", "v2", "Dogs and the cats", [0.8, 0.6], "b.md", '{"confidence": 0.4}'),
        (3, "code", "v1", "run the runners: cat", [0.0, 1.0], "a.md", "{}"), (4, "code", None, "nothing here", [0.0, 0.0], "c.md", '{"confidence": 0.8}'), (5, "docs", "v1", "the and of", [-1.0, 0.0], "d.md", None),
    ]
    df = spark.createDataFrame(rows, "id long, source_name string, version string, content string, embedding array<float>, file_path string, metadata string")
    return df.withColumn("title", F.col("file_path")).withColumn("source_url", F.lit(None).cast("string")).withColumn("start_line", F.lit(10)).withColumn("repo_url", F.lit("r")).withColumn("chunk_index", F.lit(0)).withColumn("indexed_at", F.lit("2024-01-01").cast("timestamp_ntz"))


def ids(df):
    return [r.id for r in df.collect()]


def test_vector_search(chunks):
    assert ids(search.vector_search(chunks, [1, 0], 10)) == [1, 2, 3, 5]
    assert ids(search.vector_search(chunks, [1, 0], 3, min_score=0.5)) == [1, 2]
    assert ids(search.vector_search(chunks, [1, 0], 3, source="docs", version="v1")) == [1, 5]
    assert ids(search.vector_search(chunks, [1, 0, 0], 3)) == []
    assert "embedding" not in search.vector_search(chunks, [1, 0], 1).columns


def test_keyword_search(chunks):
    assert ids(search.keyword_search(chunks, "cat", 10))[0] == 1 and set(ids(search.keyword_search(chunks, "the cats", 10))) == {1, 2, 3}
    assert ids(search.keyword_search(chunks, "cat dog", 10)) == [2]
    assert ids(search.keyword_search(chunks, "  ", 10)) == [] and ids(search.keyword_search(chunks, "the and of", 10)) == [] and ids(search.keyword_search(chunks, "zebra", 10)) == []
    assert ids(search.simple_keyword_search(chunks, "the cats", 10)) == [2]


def test_hybrid_floor_is_for_vectors_only(chunks):
    assert set(ids(search.hybrid_search(chunks, [1, 0], "runners", 2, min_score=0.9))) == {1, 3}


def test_knowledge(chunks):
    assert ids(search.faq_browse(chunks, ["docs", "code"], 0.7)) == [4, 1] and ids(search.faq_browse(chunks, [], 0.7)) == []
    assert ids(search.knowledge_search(chunks, [1, 0], ["docs"], 2)) == [1]


def test_grep_and_related(chunks):
    assert [(r.path, r.line, r.text) for r in search.grep(chunks, "a CAT").collect()] == [("/docs/a.md", 11, "A cat ran")]
    assert [r.path for r in search.related_files(chunks, [1, 0], "/docs/a.md", 3).collect()] == ["/docs/b.md", "/code/a.md"]
    assert [r.name for r in search.listing(chunks, "/docs").collect()] == ["a.md", "b.md", "d.md"]


def test_texts(chunks):
    found = search.vector_search(chunks, [1, 0], 2)
    assert render.search_results(found, "docs").first().text.startswith("SNIPPET 1\nTITLE: a.md\nSOURCE: a.md\nCONTENT:\nCats running")
    assert render.search_results(found, "code").first().text.count("\n\n---\n\n") == 1
    assert render.search_results(found.where("id = 99")).first().text == render.NOTHING
    faq = search.faq_browse(chunks, ["docs"], 0.7).withColumn("content", F.lit("Q: x\n\nA: y z"))
    assert render.faq_results(faq).first().text == "Q&A 1\nQUESTION: a.md\nANSWER: y z\nSOURCE: a.md\nCONFIDENCE: 0.90"
    assert [r.title for r in render.faq_text(faq, ["docs"]).collect()] == ["a.md"]
    assert {(r.file_path): r.content for r in render.llms_full(chunks, by_source=False).collect()}["a.md"] == "Cats running quickly.\nA cat ran\nrun the runners: cat"


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([("s", "a", 0, "x"), ("s", "a", 1, "y"), ("s", "b", 0, "z")], "source_name string, file_path string, chunk_index int, content string")
    new = spark.createDataFrame([("s", "a", 0, "new")], old.schema)
    once = upkeep.upserted(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upkeep.upserted(once, new).collect())) == [("s", "a", 0, "new"), ("s", "a", 1, "y"), ("s", "b", 0, "z")]
    assert upkeep.reindexed(old, new).count() == 2 and upkeep.without_source(old, "s").count() == 0 and upkeep.without_files(old, new).count() == 1


def test_states(spark):
    schema = "source_type string, source_key string, last_commit_sha string, last_indexed_at timestamp_ntz, status string, error_message string"
    states = spark.createDataFrame([("t", "k", "sha1", None, "error", "old")], schema)
    change = spark.createDataFrame([("t", "k", None, None, "indexing", None), ("t", "new", "s", None, "idle", "x")], schema)
    got = {r.source_key: r for r in upkeep.state_upserted(states, change).collect()}
    assert (got["k"].last_commit_sha, got["k"].status, got["k"].error_message) == ("sha1", "indexing", None) and got["new"].error_message is None


def test_collected(spark):
    rows = spark.createDataFrame([("a", "good", "1"), ("b", "odd", "2"), (None, "good", "3"), ("c", None, "x")], "name string, rating string, n string")
    fields = [{"name": "name", "type": "string", "required": True}, {"name": "rating", "type": "enum", "values": ["good", "bad"]}, {"name": "n", "type": "number"}]
    assert [r.data for r in upkeep.collected(rows, "feedback", fields).collect()] == ['{"name":"a","rating":"good","n":1.0}']


def test_replaced_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    upkeep.replace(spark.createDataFrame([("a", 1), ("b", 2)], "source_name string, n int"), path)
    upkeep.replace(spark.createDataFrame([("b", 3)], "source_name string, n int"), path)
    assert {(r.source_name, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("généré", "généré")])
def test_stems(word, want):
    assert stem(word) == want
