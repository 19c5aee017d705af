"""Providers of chat and workspace sources with fetchers of small tables."""

import json

import pytest

from quarry.sources import chats, registry


def distil(text):
    return json.dumps([{"question": f"asked of {text.count('] ')}", "answer": "a", "confidence": 0.9}, {"question": "unsure", "answer": "b", "confidence": 0.1}])


MESSAGES = "channel string, ts string, thread_ts string, reply_count int, author string, text string, timestamp string, reactions array<struct<name: string, count: int>>, error string"


def slack_rows(*rows):
    return lambda spark, channels: spark.createDataFrame([(*r, "now", None, None) if len(r) == 6 else (r[0], *[None] * 7, r[1]) for r in rows], MESSAGES)


def test_slack(spark):
    rows = [("c1", "1.0", "1.0", 2, "ann", "how?"), ("c1", "1.1", "1.0", None, "bob", "so"), ("c1", "1.2", "1.0", None, "ann", "thanks"), ("c1", "5.0", "5.0", 0, "ann", "hello"), ("c2", "3.0", "3.0", 4, "x", "y")]
    source = registry.provider("slack", spark, channels=["c1", "c2", "c3"], messages=slack_rows(*rows, ("c3", "no access")), distil=distil)
    got = source.full()
    assert {r.id: r.title for r in got.items.collect()} == {"c1:1.0:0": "asked of 3", "c2:3.0:0": "asked of 1"} and got.token == "3.0" and got.removed is None
    later = source.incremental("1.0")
    assert [r.id for r in later.items.collect()] == ["c2:3.0:0"] and later.token == "3.0" and source.current_token() == "5.0"
    nothing = source.incremental("9.0")
    assert nothing.items.count() == 0 and nothing.token == "9.0"
    with pytest.raises(RuntimeError, match="all 1 channels failed"):
        registry.provider("slack", spark, channels=["c3"], messages=slack_rows(("c3", "no access")), distil=distil).full()


def test_discord(spark):
    threads = [("f", "forum", "10", "How do I?", 3, "100", "http://m/1", None), ("t", "text", "11", "talk", 3, "90", None, None), ("t", "text", "12", "short", 1, "120", None, None), ("gone", None, None, None, None, None, None, "403")]
    said = [("10", 1, "a", "How do I?"), ("10", 2, "b", "like this"), ("11", 1, "a", "q"), ("11", 2, "b", "r")]
    source = registry.provider(
        "discord", spark, channels=["f", "t", "gone"], distil=distil,
        threads=lambda s, _: s.createDataFrame(threads, "channel string, kind string, id string, name string, message_count int, last_message_id string, url string, error string"),
        messages=lambda s, _: s.createDataFrame([(*m, "now", None) for m in said], "thread string, position int, author string, text string, timestamp string, reactions array<struct<name: string, count: int>>"),
    )
    got = source.full()
    assert {r.id: (r.content, r.source_url) for r in got.items.collect()} == {"f:10": ("Q: How do I?\n\nA: b: like this", "http://m/1"), "t:11:0": ("Q: asked of 2\n\nA: a", None)}
    assert got.token == "100" and [r.id for r in source.incremental("95").items.collect()] == ["f:10"] and source.current_token() == "120"


def test_notion(spark):
    found = [("p1", "page_id", "root", "2024-01-02", "One", "http://n/1"), ("p2", "database_id", "d", "2024-01-05", "Two", "http://n/2"), ("p3", "workspace", None, "2024-01-09", "Other", "http://n/3")]
    paragraph = json.dumps([{"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "text"}]}}])
    asked = []

    def blocks(s, ids):
        asked.append({r.id for r in ids.collect()})
        return s.createDataFrame([("p1", paragraph, None), ("p2", "[]", {"state": "done"})], "id string, blocks string, frontmatter map<string, string>")

    search = lambda s, _: s.createDataFrame(found, "id string, parent_type string, parent_id string, last_edited string, title string, url string")
    source = registry.provider("notion", spark, search=search, blocks=blocks, roots=["p1"], databases=["d"])
    got = source.full()
    assert {r.id: r.content for r in got.items.collect()} == {"p1": "text", "p2": "---\nstate: done\n---\n\n# Two"} and got.token == "2024-01-05"
    known = spark.createDataFrame([("p1",), ("p9",)], "id string")
    later = source.incremental("2024-01-02", known)
    assert [r.id for r in later.items.collect()] == ["p2"] and [r.id for r in later.removed.collect()] == ["p9"] and asked[-1] == {"p2"}
    assert source.current_token() == "2024-01-05" and chats.NotionProvider is registry.PROVIDERS["notion"]
