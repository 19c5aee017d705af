import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.operators.chunking import Sizes, chunked


@pytest.fixture
def run(spark):
    def chunks(kind, content, path="docs/file.md", **sizes):
        items = spark.createDataFrame([(path, content)], "id string, content string")
        return chunked(items, kind, Sizes(**sizes)).orderBy("chunk_index").collect()

    return chunks


@pytest.mark.parametrize("kind", sorted(chunking.CHUNKERS))
def test_blank_content_has_no_chunks(run, kind):
    assert run(kind, " \n\t ") == [] and run(kind, None) == []


def test_raw_text_merges_and_overlaps(run):
    got = run("raw-text", "aaaa aaaa\n\n\nbbbb\n\ncccc dddd eeee\nffff", target_tokens=5, overlap_tokens=2)
    assert [c.content for c in got] == ["aaaa aaaa\n\nbbbb", "\nbbbb\n\ncccc dddd eeee\nffff".strip()]
    assert [c.content for c in run("raw-text", "one\n\ntwo")] == ["one\n\ntwo"]


def test_qa(run):
    got = run("slack", "Q: How so? \n\nA: Like this.\n")
    assert [(c.title, c.content) for c in got] == [("How so?", "Q: How so? \n\nA: Like this.")]
    assert run("qa", "no question")[0].title is None


def test_document_pages_and_headers(run):
    text = "INTRO PART\nfirst words\n1. Scope\nscope words\fsecond page\n1.2 Not a header"
    got = run("document", text)
    assert [(c.title, c.content, c.start_line) for c in got] == [("INTRO PART", "first words", 1), ("1. Scope", "\n".join(["first words", "", "scope words", "", "second page", "1.2 Not a header"]), 1)]
    assert run("document", "HEADER ONLY") == []


def test_document_splits_long_paragraphs_at_words(run):
    got = run("document", "word " * 50, target_tokens=5, overlap_tokens=0)
    assert all(len(c.content) <= 20 for c in got) and sum(c.content.split().count("word") for c in got) == 50


def test_markdown_titles(run):
    assert run("markdown", '---\ntitle: "The Title"\n---\n# Head\ntext')[0].title == "The Title"
    assert run("markdown", "text\n## Head two\nmore")[0].title == "Head two"
    assert run("markdown", "just text", path="a/b.md")[0].title == "b.md"


def test_markdown_strips_components(run):
    text = "import X from 'y';\n\n<Card title=\"a\"><Inner>kept</Inner></Card>\n<Image src='x' />\n\n\n\nend"
    assert run("markdown", text)[0].content == "kept\n\nend"


def test_markdown_splits_at_headings_and_keeps_fences(run):
    fence = "```py\n## not a heading\n\nx = 1\n```"
    text = f"# Top\nintro\n\n## One\n{fence}\n\n## Two\nwords here\n### Deep\nmore words"
    got = run("markdown", text, target_tokens=12, overlap_tokens=0)
    whole = [c.content for c in got]
    assert whole[0] == "# Top\nintro" and any(fence in c for c in whole)
    paths = {c.content.split("\n")[0]: c.heading_path for c in got}
    assert paths["## Two"][:1] == ["Top"] and "Two" not in paths["## Two"]


def test_markdown_lines_of_a_long_paragraph(run):
    got = run("markdown", "\n".join(f"line number {i}" for i in range(20)), target_tokens=10, overlap_tokens=0)
    assert len(got) > 1 and all(len(c.content) <= 40 for c in got) and "\n\n" in got[0].content


def test_code_short_file(run):
    got = run("code", "a = 1\nb = 2\n", path="x/y.py")
    assert [(c.content, c.start_line, c.end_line, c.language) for c in got] == [("// File: x/y.py\n1 | a = 1\n2 | b = 2", 1, 2, "python")]


def test_code_prefers_double_blank_lines(run):
    lines = [f"l{i}" for i in range(5)] + ["", ""] + [f"m{i}" for i in range(5)]
    got = run("code", "\n".join(lines), target_lines=6, overlap_lines=0)
    assert [(c.start_line, c.end_line) for c in got] == [(1, 6), (7, 12)]


def test_code_does_not_split_comments(run):
    lines = ["/*"] + ["", ""] * 4 + ["*/", "x", "", "y", "z"]
    got = run("code", "\n".join(lines), target_lines=5, overlap_lines=1)
    assert [(c.start_line, c.end_line) for c in got] == [(1, 11), (11, 14)]
    assert got[1].content.split("\n")[1] == "11 | x"


def test_code_mechanical_split(run):
    got = run("code", "\n".join("abcdefghij"), target_lines=4, overlap_lines=2, path="Makefile")
    assert [(c.start_line, c.end_line) for c in got] == [(1, 4), (3, 8), (7, 10)] and got[0].language == "makefile"


PAGE = """<html><head><title>Guide - Part | Site</title></head><body><nav>menu</nav><main><h1>Top</h1><p>Hello <b>big</b></p>
<ul><li>one</li><li>two</li></ul><ol><li>first</li></ol><h2>Second</h2><pre>x  = 1
y</pre><table><tr><th>a</th><td>b</td></tr></table><h4>Small</h4><img alt="cat"><script>no()</script></main></body></html>"""


def test_html_sections(run):
    got = run("html", PAGE, overlap_tokens=0)
    assert [c.heading_path for c in got] == [["Top"], ["Top", "Second"]]
    assert got[0].title == "Guide - Part"
    assert got[0].content == "Hello\nbig\n- one\n- two\n1. first"
    assert got[1].content == "```\nx  = 1\ny\n```\n\na | b\n\nSmall\n[image: cat]"


def test_html_splits_large_sections(run):
    body = "".join(f"<p>paragraph {i} with words</p>" for i in range(30))
    got = run("html", f"<article>{body}</article>", path="p.html", target_tokens=20)
    assert len(got) > 5 and all(len(c.content) <= 80 for c in got) and got[0].title == "p.html"


def test_registered_chunker(run):
    chunking.register("upper", lambda items, sizes: items.withColumn("chunks", F.array(chunking.chunk(F.upper("content")))))
    assert run("upper", "abc")[0].content == "ABC"
    chunking.CHUNKERS.pop("upper")
    with pytest.raises(ValueError, match="upper"):
        run("upper", "abc")
