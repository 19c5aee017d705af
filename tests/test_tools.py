import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.operators.tools import FAILED, HINT, Toolbox, resolved
from quarry.plans.indexing import hashed_embedder

TEXTS = {("docs", "guide.md"): "install the client\nthen run it", ("docs", "faq.md"): "Q: how?\n\nA: install first", ("code", "main.py"): "def run(): pass"}


@pytest.fixture
def box(spark):
    embed = hashed_embedder(32)
    rows = [(i, s, p, t, embed([t])[0], i) for i, ((s, p), t) in enumerate(TEXTS.items())]
    df = spark.createDataFrame(rows, "id long, source_name string, file_path string, content string, embedding array<float>, chunk_index int")
    df = df.withColumn("title", F.col("file_path")).withColumn("source_url", F.lit(None).cast("string")).withColumn("repo_url", F.lit("r")).withColumn("metadata", F.lit('{"confidence": 0.9}')).withColumn("version", F.lit("v1"))
    return Toolbox(df.withColumn("start_line", F.lit(1)).withColumn("indexed_at", F.lit("2024-01-01").cast("timestamp_ntz")), embed, "s1")


def test_search_modes_and_their_log(box):
    assert "guide.md" in box.search("search-docs", "install the client", form="docs", limit=1)
    assert box.search("search-docs", "zebra", mode="keyword") == "No results found."
    assert box.search("search-docs", "client run", mode="hybrid", source="docs", limit=1).startswith("SNIPPET 1\nSOURCE: guide.md")
    assert "CONFIDENCE: 0.90" in box.knowledge("faq", ["docs"]) and "QUESTION: faq.md" in box.knowledge("faq", ["docs"], "how install", 1)
    rows = box.logged().collect()
    assert [(r.tool_name, r.query_text, r.result_count) for r in rows][1] == ("search-docs", "zebra", 0) and rows[1].top_score is None and {r.session_id for r in rows} == {"s1"} and rows[3].query_text == "<browse>"


def test_failures_have_a_fixed_text(box):
    def broken(texts):
        raise ConnectionError

    assert Toolbox(box.chunks, broken).search("search-docs", "x") == FAILED


def test_shell(box):
    assert box.shell("ls /") == ("code/\ndocs/", 0) and box.shell("ls nowhere")[1] == 2
    assert box.shell("cat guide.md", "/docs") == (TEXTS["docs", "guide.md"], 0) and box.shell("cat /x")[1] == 1 and box.shell("head /docs/guide.md")[0].startswith("install")
    assert box.shell("find /docs") == ("/docs/faq.md\n/docs/guide.md", 0)
    assert box.shell("grep -i INSTALL") == ("/docs/faq.md:3:A: install first\n/docs/guide.md:1:install the client", 0) and box.shell("grep zebra") == (HINT, 1)
    assert box.shell("qmd run it") == ("/docs/guide.md:2:then run it", 0) and box.shell("qmd zebra")[1] == 1
    assert "/docs/faq.md (" in box.shell("related /docs/guide.md")[0] and box.shell("related /none")[1] == 1
    assert box.shell("rm x")[1] == 127 and box.shell("grep")[1] == 2 and box.shell("cat 'x")[1] == 2


def test_shell_flags_and_pages(box):
    assert box.shell("head -n 1 /docs/guide.md") == ("install the client", 0) and box.shell("head -n2 /docs/guide.md") == (TEXTS["docs", "guide.md"], 0)
    assert box.shell("find / -name '*.md'") == ("/docs/faq.md\n/docs/guide.md", 0)
    assert box.shell("grep -rl install /") == ("/docs/faq.md\n/docs/guide.md", 0) and box.shell("grep install guide.md", "/docs") == ("/docs/guide.md:1:install the client", 0)
    assert box.shell("find /", page=2) == ("/code/main.py\n/docs/faq.md\n... more: from line 3 on", 0) and box.shell("find /", page=2, skip=2) == ("/docs/guide.md", 0)


def test_health(box, spark):
    states = spark.createDataFrame([("code", "k", "idle")], "source_type string, source_key string, status string")
    assert box.health(states) == {"total": 3, "repos": 1, "by_source": {"code": 1, "docs": 2}, "states": [{"source_type": "code", "source_key": "k", "status": "idle"}]}


@pytest.mark.parametrize("path, cwd, want", [("a/../b/", "/x", "/x/b"), ("/a//b/.", "/", "/a/b"), ("../../..", "/x", "/"), ("", "/x", "/x")])
def test_paths(path, cwd, want):
    assert resolved(path, cwd) == want


GOOD = {"sources": [{"name": "d", "type": "markdown"}, {"name": "f", "type": "slack"}], "embedding": {"provider": "local"}, "indexing": {"nightly": 3}, "tools": [{"name": "s", "type": "search", "source": "d"}, {"name": "k", "type": "knowledge", "sources": ["f"]}, {"name": "b", "type": "bash", "sources": ["d"]}]}


def test_configurations():
    assert config.errors(GOOD) == [] and config.tools_of(GOOD, "d") == ["s", "b"]
    for change, said in (
        ({"embedding": None}, "embedding settings"), ({"indexing": None}, "indexing settings"), ({"embedding": {"provider": "x"}}, "provider"), ({"sources": [*GOOD["sources"], {"name": "d", "type": "zip"}]}, "unknown type"),
        ({"tools": [{"name": "s", "type": "search", "source": "gone"}]}, "no source gone"), ({"tools": [{"name": "s", "type": "search", "default_limit": 9, "max_limit": 5}]}, "over max_limit"), ({"tools": [{"name": "k", "type": "knowledge", "sources": ["d"]}]}, "questions and answers"),
        ({"tools": [{"name": "c", "type": "collect"}]}, "schema"), ({"embedding": None, "tools": [{"name": "b", "type": "bash", "sources": ["d"], "grep_strategy": "hybrid"}]}, "grep needs"),
    ):
        assert any(said in e for e in config.errors(GOOD | change)), said


def test_texts_about_the_server(box):
    from quarry.operators import render

    assert render.skill_text(GOOD | {"server": {"name": "acme"}}).startswith("# acme\n") and "- `k` (knowledge, over f)" in render.skill_text(GOOD | {"server": {"name": "acme"}})
    assert render.index_text(box.chunks).first().text == "/code/  1 files, 1 chunks\n/docs/  2 files, 2 chunks"
