import io
import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import html, ip, scalar
from quarry.sources import conversations, crawl, files, notion, registry


@pytest.fixture
def tree(tmp_path):
    for path, text in {"src/a.ts": "alpha", "src/b.test.ts": "test", "node_modules/x.ts": "skip", "docs/long.md": "x" * 200_000, "docs/n.md": "1,2;3 " * 200, "docs/g.md": "good words"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_scan(spark, tree):
    got = files.scan(spark, str(tree), ["**/*.ts", "**/*.md"], ["**/*.test.ts"])
    assert {r.path for r in got.collect()} == {"src/a.ts", "docs/n.md", "docs/g.md"}
    assert {r.id: r.content for r in files.items(got).collect()} == {"src/a.ts": "alpha", "docs/g.md": "good words"}


def test_changes_and_token(spark, tree):
    files.snapshot(files.scan(spark, str(tree))).write.parquet(f"{tree}/../snapshot")
    before, token = spark.read.parquet(f"{tree}/../snapshot"), files.state_token(files.scan(spark, str(tree))).first().token
    (tree / "src/a.ts").write_text("changed")
    (tree / "docs/g.md").unlink()
    changed, gone = files.changes(before, files.snapshot(files.scan(spark, str(tree))))
    assert [r.path for r in changed.collect()] == ["src/a.ts"] and [r.path for r in gone.collect()] == ["docs/g.md"]
    assert token.startswith("local-") and len(token) == 18 and files.state_token(files.scan(spark, str(tree))).first().token != token


def test_git_provider(spark, tree):
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "src", "docs/g.md")
    run("commit", "-qm", "one")
    source = registry.provider("code", spark, path=str(tree), include=["**/*.ts", "**/*.md"], repository=str(tree))
    first = source.full()
    (tree / "src/a.ts").write_text("second")
    (tree / "docs/g.md").unlink()
    run("commit", "-qam", "two")
    second = source.incremental(first.token)
    assert [(r.id, r.content) for r in second.items.collect()] == [("src/a.ts", "second")] and [r.id for r in second.removed.collect()] == ["docs/g.md"] and second.token != first.token
    assert source.incremental("0" * 40).removed is None
    with pytest.raises(ValueError, match="nowhere"):
        registry.provider("nowhere", spark)


def test_checkout(spark, tmp_path):
    origin, place = tmp_path / "origin", tmp_path / "clones/copy"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    def commit(name, text):
        (origin / name).write_text(text)
        run("add", ".")
        run("commit", "-qm", name)

    run("init", "-q", "-b", "main")
    commit("a.ts", "one")
    run("checkout", "-qb", "other")
    commit("a.ts", "of the other branch")
    run("checkout", "-q", "main")
    commit("b.ts", "two")
    source = registry.provider("code", spark, path=str(place), remote=f"file://{origin}", branch="main")
    read = lambda acquired: {r.id: r.content for r in acquired.items.collect()}
    first = source.full()
    assert read(first) == {"a.ts": "one", "b.ts": "two"} and files.git(str(place), "rev-list", "--count", "HEAD").strip() == "1"
    commit("c.ts", "three")
    second = source.incremental(first.token)
    assert read(second) == {"c.ts": "three"} and second.token != first.token
    (place / ".git/HEAD").write_text("broken")
    assert read(source.full()) == {"a.ts": "one", "b.ts": "two", "c.ts": "three"} and [p.name for p in place.parent.iterdir()] == ["copy"]
    assert read(registry.provider("code", spark, path=str(tmp_path / "second"), remote=f"file://{origin}", branch="other").full()) == {"a.ts": "of the other branch"}
    with pytest.raises(RuntimeError, match="can't clone file:///nowhere"):
        files.checkout("file:///nowhere", str(tmp_path / "third"))
    with pytest.raises(ValueError, match="no checkout"):
        files.checkout(f"file://{origin}", str(tmp_path))
    assert files.authorised("https://h/o/r", "t") == "https://x-access-token:t@h/o/r" and files.authorised("https://h/o/r", None) == "https://h/o/r"


def test_documents_that_can_not_be_read(spark, tmp_path, monkeypatch):
    from types import ModuleType, SimpleNamespace

    (tmp_path / "a.txt").write_text("text of a file")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    found = files.scan(spark, str(tmp_path))
    assert [(r.id, r.metadata) for r in files.items(found, documents=True).collect()] == [("a.txt", "{}")]
    assert {r.path: r.problem.split(":")[0] for r in files.problems(found).collect()} == {"b.pdf": "reading PDF needs the optional library pypdf", "c.docx": "BadZipFile"}
    pages = [SimpleNamespace(extract_text=lambda t=t: t) for t in ("first page " * 9, "second")]
    fake = ModuleType("pypdf")
    fake.PdfReader = lambda raw: SimpleNamespace(pages=pages[:1] if raw.read() == b"one" else pages[1:], metadata={"/Title": "T", "/Author": "", "/CreationDate": "D:2024"})
    monkeypatch.setitem(__import__("sys").modules, "pypdf", fake)
    assert files.extract("x.PDF", b"one") == ("first page " * 9, '{"title": "T", "creationDate": "D:2024", "pageCount": 1}', None)
    assert files.extract("x.pdf", b"two")[2] == "1 pages, 6 characters: scanned?"


def test_docx(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = files.items(files.scan(spark, str(tmp_path)), documents=True)
    assert [(r.id, r.content) for r in got.collect()] == [("d.docx", "One two\n\nthree")]


@pytest.mark.parametrize("glob, path, want", [("**/*.ts", "a/b/c.ts", True), ("**/*.ts", "c.ts", True), ("*.ts", "a/c.ts", False), ("src/**", "src/a/b", True), ("a?.md", "ab.md", True), ("a?.md", "a/.md", False), ("a.md", "axmd", False), ("**/__tests__/**", "x/__tests__/y.ts", True)])
def test_globs(spark, glob, path, want):
    assert spark.range(1).select(scalar.glob_match(F.lit(path), [glob])).first()[0] is want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalar.derived_url(F.lit("docs/(g)/a/index.md"), "https://h/", "docs/", ".md", True, True)) == "https://h/a"
    assert one(scalar.derived_url(F.lit("index"), "https://h/", strip_index=True)) == "https://h/" and one(scalar.derived_url(F.lit("a"), None)) is None
    assert [one(scalar.language(F.lit(p))) for p in ("a.TSX", "b.zig", "Makefile", "x/y.py")] == ["typescript", "zig", "makefile", "python"]
    assert [one(scalar.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert [one(scalar.retry_after(F.lit(x))) for x in (0.0, -1.0, 2.7, 999.0, float("nan"), float("inf"))] == [60, 60, 2, 300, 60, 60]
    assert one(scalar.client_ip(F.lit(""), F.lit(None).cast("string"), F.lit("1.2.3.4"))) == "1.2.3.4" and one(scalar.client_ip(F.lit(""))) == "unknown"
    assert one(scalar.answer(F.lit("Q: a\n\nA: b\nc "))) == "b\nc" and one(scalar.answer(F.lit("plain"))) == "plain"


def test_addresses(spark):
    rows = spark.createDataFrame([("10.1.2.3",), ("::ffff:10.1.2.3",), ("11.0.0.1",), ("2001:db8::1",), ("x",), (None,)], "ip string")
    got = {r.ip: r.allowed for r in ip.allowlisted(rows, ["10.1.2.99/16", "2001:db8::/32"]).collect()}
    assert got == {"10.1.2.3": True, "::ffff:10.1.2.3": True, "11.0.0.1": False, "2001:db8::1": True, "x": False, None: False}


def test_chat_threads(spark):
    slack = spark.createDataFrame([("1.0", "1.0", 3), ("1.1", "1.0", None), ("2.0", "2.0", 1), ("9.0", "9.0", 5), ("10.0", "10.0", 5)], "ts string, thread_ts string, reply_count int")
    assert {r.ts for r in conversations.slack_threads(slack).collect()} == {"1.0", "9.0", "10.0"}
    assert {r.ts for r in conversations.slack_threads(slack, since="2").collect()} == {"9.0"}
    assert conversations.slack_token(conversations.slack_threads(slack)).first().token == "9.0"
    discord = spark.createDataFrame([("a", 5, "9"), ("b", 5, "10"), ("b", 5, "10"), ("c", 1, "11")], "id string, message_count int, last_message_id string")
    assert [r.id for r in conversations.discord_threads(discord, since="9").collect()] == ["b"]
    assert conversations.discord_token(discord).first().token == "11"


def test_authors_and_participants(spark):
    messages = spark.createDataFrame([("t", 2, "u1", "x"), ("t", 1, "u2", "y"), ("t", 3, "u2", "z")], "thread string, position int, user string, text string")
    users = spark.createDataFrame([("u1", "Ann", "T1")], "id string, name string, team string")
    named = conversations.with_authors(messages, users, spark.createDataFrame([("T1", "Ops")], "id string, name string"))
    assert conversations.participants(named).first().participants == ["u2", "Ann (Ops)"]


def test_forum_items(spark):
    threads = spark.createDataFrame([("t", "c", "How?")], "id string, channel string, name string")
    messages = spark.createDataFrame([("t", 1, "a", "how?"), ("t", 2, "b", "  "), ("t", 3, "c", "like this")], "thread string, position int, author string, text string")
    got = conversations.forum_items(threads, messages).first()
    assert (got.id, got.content, json.loads(got.metadata)) == ("c:t", "Q: How?\n\nA: c: like this", {"channel": "c", "confidence": 1.0, "forumThread": True})
    said = {"whole": ["  ", "How?", "yes"], "begins": ["how do", "so "], "more": ["How do I? Because", "so"], "none": ["How do I?"]}
    threads = spark.createDataFrame([(k, "c", "How do I?", f"http://{k}") for k in said], "id string, channel string, name string, url string")
    messages = spark.createDataFrame([(k, i, "a", t) for k, v in said.items() for i, t in enumerate(v)], messages.schema)
    got = {r.id[2:]: (r.content.partition("A: ")[2], r.source_url) for r in conversations.forum_items(threads, messages).collect()}
    assert got == {"whole": ("a: How?\n\na: yes", "http://whole"), "begins": ("a: so ", "http://begins"), "more": ("a: How do I? Because\n\na: so", "http://more")}
    long = spark.range(1).select(conversations.shortened(F.lit("a" * 50 + "\n\n" + "b" * 50), 80)).first()[0]
    assert long == "a" * 50 + "\n\n[truncated]"


def test_distilled_pairs(spark):
    transcripts = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "x")], "thread string, transcript string")

    def client(text):
        return "not json" if text == "bad" else json.dumps([{"question": " q ", "answer": "a", "confidence": 0.9}, {"question": "", "answer": "a", "confidence": 0.9}, {"question": "q", "answer": "a", "confidence": 1.5}, {"question": "q", "answer": "a", "confidence": 0.1}])

    got = conversations.pair_items(conversations.distilled(transcripts, client))
    assert sorted(r.id for r in got.collect()) == ["a:0", "c:0"] and got.first().title == "q"


def test_transcripts_for_distilling(spark):
    rows = spark.createDataFrame([("t", i, f"m{i}", "a", "now", [("up", 2)] if i == 1 else None) for i in range(1, 150)], "thread string, position int, text string, author string, timestamp string, reactions array<struct<name: string, count: int>>")
    text = conversations.for_distilling(rows).first().transcript
    assert text.startswith("[now] a: m1 [reactions: :up: x2]\n\n[now] a: m2") and text.count("[now]") == 100


def test_workspace_pages(spark):
    text = lambda s: {"rich_text": [{"plain_text": s}]}
    blocks = [
        {"type": "heading_2", "heading_2": text("Head")}, {"type": "bulleted_list_item", "bulleted_list_item": text("one"), "children": [{"type": "to_do", "to_do": text("two") | {"checked": True}}]},
        {"type": "code", "code": text("x = 1") | {"language": "python"}}, {"type": "table", "table": {"has_column_header": True, "table_width": 2}, "children": [{"type": "table_row", "table_row": {"cells": [[{"plain_text": "a"}], [{"plain_text": "b"}]]}}]}, {"type": "image", "image": {"external": {"url": "u"}, "caption": []}},
        {"type": "unknown"}, {"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "l", "href": "h"}]}},
    ]
    schema = "id string, title string, blocks string, frontmatter map<string,string>, parent_type string, parent_id string, url string, last_edited string"
    pages = spark.createDataFrame([("p", "T", json.dumps(blocks), {"b": "2", "a": "1"}, "database_id", "d", "u", "2"), ("q", "Empty", "[]", None, "page", "p", "u", "3")], schema)
    got = {r.id: r.content for r in notion.page_items(pages).collect()}
    assert got["q"] == "# Empty"
    assert got["p"] == "---\na: 1\nb: 2\n---\n\n## Head\n- one\n  - [x] two\n```python\nx = 1\n```\n| a | b |\n| --- | --- |\n![](u)\n[l](h)"
    assert notion.token(pages).first().token == "3" and notion.edited_since(pages, "2").count() == 1
    assert {r.id for r in notion.discovered(pages, [], []).collect()} == {"p", "q"} and {r.id for r in notion.discovered(pages, [], ["d"]).collect()} == {"p"}


@pytest.mark.parametrize("value, want", [({"type": "title", "title": [{"plain_text": "a"}, {"plain_text": "b"}]}, "ab"), ({"type": "select", "select": {"name": "s"}}, "s"), ({"type": "multi_select", "multi_select": [{"name": "x"}, {"name": "y"}]}, "x, y"), ({"type": "date", "date": {"start": "1", "end": "2"}}, "1 → 2"), ({"type": "number", "number": 3}, "3"), ({"type": "formula", "formula": {}}, None)])
def test_workspace_properties(spark, value, want):
    assert spark.createDataFrame([(json.dumps(value),)], "p string").select(notion.property_text(F.col("p"))).first()[0] == want


ROBOTS = "User-agent: bad\nDisallow: /all\n\nUser-agent: *\nDisallow: /private\nDisallow:\nSitemap: https://h/s.xml\n"


def test_site_files(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    xml = '<urlset xmlns="x"><url><loc> https://h/a </loc></url><url><lastmod>1</lastmod><loc>https://h/b</loc></url></urlset>'
    assert one(crawl.sitemap_urls(F.lit(xml))) == ["https://h/a", "https://h/b"] and one(crawl.sitemap_index(F.lit(xml))) == []
    assert one(crawl.sitemap_index(F.lit("<sitemapindex><sitemap><loc>https://h/1.xml</loc></sitemap></sitemapindex>"))) == ["https://h/1.xml"]
    assert one(crawl.robots_disallowed(F.lit(ROBOTS))) == ["/private"] and one(crawl.robots_sitemaps(F.lit(ROBOTS))) == ["https://h/s.xml"]


def test_links_and_text():
    page = '<html><head><title>t</title></head><body>a<script>x</script> b<a href="/c/#x">1</a><a href="c">2</a><a href="https://o/z">3</a><a href="mailto:q">4</a><a href="/c">5</a></body></html>'
    assert html.links(page, "https://h/d/e") == ["https://h/c", "https://h/d/c"] and html.visible_text(page) == "a b12345"
    assert html.content_selector(html.parsed("<div id=content></div><article></article>"))[0] == "article" and html.content_selector(html.parsed("<p>")) is None


def test_crawl(spark):
    site = {"https://h/": '<a href="/a">', "https://h/a": '<a href="/b"><a href="/">', "https://h/b": '<a href="/private/x">', "https://h/private/x": ""}
    rows = spark.createDataFrame(list(site.items()), "url string, html string")
    seeds = spark.createDataFrame([("https://h/",)], "url string")
    fetch = lambda urls: urls.join(rows, "url")
    got = crawl.crawl(seeds, fetch, F.array(F.lit("/private")))
    assert {(r.url, r.depth) for r in got.collect()} == {("https://h/", 0), ("https://h/a", 1), ("https://h/b", 2)}
    assert crawl.crawl(seeds, fetch, most=2).count() == 2 and crawl.crawl(seeds, fetch, depth=0).count() == 1


def test_site_shape(spark):
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert crawl.common_prefix(urls("https://h/docs/a/x", "https://h/docs/a/y", "https://h/docs/a")).first().prefix == "/docs/a"
    assert crawl.common_prefix(urls("https://h/docs/guide")).first().prefix == "/docs" and crawl.common_prefix(urls("https://h/a", "https://h/b")).first().prefix == "/"
    assert crawl.source_type(urls("a.md", "b.mdx", "c")).first().type == "markdown" and crawl.source_type(urls("a.md", "c")).first().type == "html"
    assert crawl.looks_scripted(spark.createDataFrame([("",), ("x" * 200,), ("",)], "text string")).first().scripted


def test_paged_api(spark, monkeypatch):
    from quarry.sources import api

    spark.dataSource.register(api.ApiSource)
    rows = spark.read.format("paged-api").option("client", "fake_api:client").option("channels", "a,b").load()
    assert rows.count() == 8 and {(r.channel, r.ts) for r in conversations.slack_threads(rows).collect()} == {(c, f"{n}.0") for c in "ab" for n in (0, 1)}

    waits, calls = [], []

    def busy(channel, cursor):
        calls.append(cursor)
        if len(calls) < 4:
            raise api.Throttled(7 if len(calls) == 1 else None)
        return ["row"], None

    assert list(api.pages(busy, "a", sleep=waits.append)) == [["row"]] and waits == [7, 2.0, 3.0]
    with pytest.raises(api.Throttled):
        api.patiently(lambda: (_ for _ in ()).throw(api.Throttled()), retries=2, sleep=waits.append)


def test_generated_config(spark):
    from quarry import config

    pages = spark.createDataFrame([("https://docs.acme.dev/en/a", "<main>x</main>"), ("https://docs.acme.dev/en/b", "<main>y</main>"), ("https://docs.acme.dev/en/c", "<article>z</article>")], "url string, html string")
    got = crawl.generated_config(pages, "https://docs.acme.dev/")
    assert config.errors(got) == [] and got["server"]["name"] == "acme" and got["sources"][0] | {"path": "/en", "content_selector": "main"} == got["sources"][0]
    assert crawl.repository_of("https://github.com/o/r.git") == "https://github.com/o/r.git" and crawl.repository_of("https://o.example/") is None


def test_messages():
    from quarry.functions import messages

    assert messages.rate_limited(1, 60, 1.5) == {"error": "rate_limited", "message": "At most 1 request in 60 seconds; try again in 1 second.", "retry_after": 1}
    assert messages.at_capacity(20, 20)["retry_after"] == 60 and messages.wait_seconds(1e9) == 300
