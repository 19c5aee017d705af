"""Clients of chat and workspace services against a service whose state is a file, and channels as a stream."""

import json
from functools import partial

import fake_api
import pytest

from quarry.sources import clients, feeds, notion, registry
from quarry.sources.api import Throttled


def distil(text):
    return json.dumps([{"question": text, "answer": "a", "confidence": 0.9}])


def message(ts, text, thread=None, replies=None, user="u1", **more):
    return {"ts": ts, "text": text, "user": user} | ({"thread_ts": thread} if thread else {}) | ({"reply_count": replies} if replies is not None else {}) | more


class State:
    def __init__(self, path, **data):
        self.path, self.data = str(path / "state.json"), data
        self.write()

    def write(self):
        with open(self.path, "w") as f:
            json.dump(self.data, f)

    def calls(self):
        with open(self.path + ".log") as f:
            return [json.loads(line) for line in f]

    def made(self, kind, *more, **options):
        path = self.path
        return lambda: kind(fake_api.Service(path), *more, sleep=lambda s: None, **options)


@pytest.fixture
def chat(tmp_path):
    thread = [message("1.0", "how?", "1.0", 3), message("1.1", "so", "1.0", user="u2"), message("1.2", "thanks", "1.0", reactions=[{"name": "up", "count": 2}]), message("1.3", "bye", "1.0", user="gone")]
    channels = {"a": [*thread, message("2.0", "alone"), message("3.0", "short", "3.0", 1), message("3.1", "one", "3.0")], "b": [message("4.0", "later?", "4.0", 2), message("4.1", "x", "4.0"), message("4.2", "y", "4.0", user=None)]}
    users = {"u1": {"team_id": "T", "profile": {"display_name": "Ann"}}, "u2": {"team_id": "S", "profile": {"display_name": "", "real_name": "Bob"}}}
    return State(tmp_path, channels=channels, users=users, teams={"T": "Acme"})


def test_patience():
    answers = [(429, {"retry-after": "7"}, None), (503, {}, None), (200, {}, {"ok": False, "error": "ratelimited"}), (200, {}, {"ok": True})]
    waits = []
    assert clients.Web(lambda p, q: answers.pop(0), sleep=waits.append)("x") == {"ok": True} and waits == [7.0, 2.0, 3.0]
    with pytest.raises(clients.Refused, match="x: 404"):
        clients.Web(lambda p, q: (404, {}, None))("x")
    with pytest.raises(clients.Refused, match="no_scope"):
        clients.Web(lambda p, q: (200, {}, {"ok": False, "error": "no_scope"}))("x")
    with pytest.raises(Throttled):
        clients.Web(lambda p, q: (429, {}, None), retries=1, sleep=waits.append)("x")


def test_pace():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    web = clients.Web(lambda p, q: (200, {}, {}), pause=0.34, sleep=sleep, clock=lambda: now[0])
    web("a")
    now[0] += 0.1
    web("b")
    now[0] += 1
    web("c")
    assert waits == [pytest.approx(0.24)]


def test_cursor_that_repeats():
    web = clients.Web(lambda p, q: (200, {}, {"rows": [1], "next": "same"}))
    assert len(list(web.cursored("x", "rows", lambda b: b["next"]))) == 2


def test_chat_provider(spark, chat):
    source = registry.provider("slack", spark, channels=["a", "b", "closed"], messages=feeds.ChatMessages(chat.made(clients.ChatClient)), distil=distil)
    got = source.full()
    titles = {r.id: r.title for r in got.items.collect()}
    assert sorted(titles) == ["a:1.0:0", "b:4.0:0"] and got.token == "4.0"
    said = [line.split("] ", 1)[1] for line in titles["a:1.0:0"].split("\n\n")]
    assert said == ["Ann (Acme): how?", "Bob: so", "Ann (Acme): thanks [reactions: :up: x2]", "gone: bye"]
    asked = [p["user"] for path, p in chat.calls() if path == "users.info"]
    assert sorted(asked) == ["gone", "u1", "u2"]  # once each, though the results were used more than once
    before = len(chat.calls())
    assert source.current_token() == "4.0" and [p["limit"] for _, p in chat.calls()[before:]] == [1, 1, 1]


def test_chat_provider_since(spark, chat):
    source = registry.provider("slack", spark, channels=["a", "b"], messages=feeds.ChatMessages(chat.made(clients.ChatClient)), distil=distil)
    got = source.incremental("1.0")
    assert [r.id for r in got.items.collect()] == ["b:4.0:0"] and got.token == "4.0"
    assert {p.get("oldest") for path, p in chat.calls() if path == "conversations.history"} == {"1.0"}
    assert {p["ts"] for path, p in chat.calls() if path == "conversations.replies"} == {"4.0"}
    assert source.incremental("9.0").items.count() == 0


def test_chat_provider_fails_with_all_channels(spark, chat):
    with pytest.raises(RuntimeError, match="all 1 channels failed"):
        registry.provider("slack", spark, channels=["closed"], messages=feeds.ChatMessages(chat.made(clients.ChatClient)), distil=distil).full()


def test_forum_provider(spark, tmp_path):
    thread = lambda i, name, parent="f", last="50", n=2: {"id": i, "name": name, "parent_id": parent, "message_count": n, "last_message_id": last}
    author = {"username": "ann", "global_name": None}
    said = {"1": [{"id": str(i), "author": author, "content": f"m{i}", "timestamp": "now"} for i in range(10, 260)], "2": [{"id": "9", "author": author | {"global_name": "Bob"}, "content": "hi", "timestamp": "now"}], "t1": [{"id": "8", "author": author, "content": "asked", "timestamp": "now"}]}
    archived = [thread("1", "archived again", last="999"), thread("2", "Second", last="100"), thread("t1", "talk", "t", "60")]
    state = State(tmp_path, active=[thread("1", "First"), thread("x", "elsewhere", "other")], archived=archived, said=said)
    factory = state.made(clients.ForumClient, "g")
    source = registry.provider("discord", spark, channels=["f", "t"], threads=feeds.ForumThreads(factory, ["t"]), messages=feeds.ForumMessages(factory), distil=distil)
    got = source.full()
    items = {r.id: r for r in got.items.collect()}
    assert sorted(items) == ["f:1", "f:2", "t:t1:0"] and got.token == "100"
    assert items["f:1"].title == "First" and items["f:1"].source_url == "https://discord.com/channels/g/f/1"  # the first listing wins
    assert items["f:1"].content == "Q: First\n\nA: " + "\n\n".join(f"ann: m{i}" for i in range(10, 260))  # three pages, in order of ids as numbers
    assert items["f:2"].content == "Q: Second\n\nA: Bob: hi" and items["t:t1:0"].title == "[now] ann: asked"
    before = len(state.calls())
    later = source.incremental("60")
    assert [r.id for r in later.items.collect()] == ["f:2"]
    assert {p.split("/")[2] for p, _ in state.calls()[before:] if p.endswith("messages")} == {"2"}  # only what is taken is read


def test_workspace_provider(spark, tmp_path):
    text = lambda s: [{"plain_text": s}]
    page = lambda i, edited, parent, **p: {"object": "page", "id": i, "last_edited_time": edited, "url": f"http://n/{i}", "parent": parent, "properties": {"Name": {"type": "title", "title": text(i.upper())}} | p}
    database = {"type": "database_id", "database_id": "d"}
    pages = [page("p", "2024-01-02", {"type": "page_id", "page_id": "root"}), page("q", "2024-01-05", database, State={"type": "select", "select": {"name": "done"}}, Odd={"type": "relation"}), page("r", "2024-01-07", database), page("s", "2024-01-09", {"type": "workspace"})]
    item = lambda i, inner=False: {"id": i, "type": "bulleted_list_item", "has_children": inner, "bulleted_list_item": {"rich_text": text(i)}}
    blocks = {"p": [item("one", True), item("two"), item("three")], "one": [item("four", True)], "four": [item("four", True)], "q": []}
    state = State(tmp_path, pages=pages, blocks=blocks)
    factory = state.made(clients.WorkspaceClient, depth=3, pause=0.0)
    source = registry.provider("notion", spark, search=feeds.WorkspaceSearch(factory, ["p"], ["d"]), blocks=feeds.WorkspaceBlocks(factory), roots=["p"], databases=["d"])
    got = source.full()
    items = {r.id: r for r in got.items.collect()}
    assert sorted(items) == ["p", "q", "r"] and got.token == "2024-01-07"
    assert items["p"].content == "- one\n  - four\n    - four\n- two\n- three"  # the depth is bounded
    assert items["q"].content == "---\nName: Q\nState: done\n---\n\n# Q" and json.loads(items["q"].metadata) == {"parentType": "database", "parentId": "d"}
    everything = registry.provider("notion", spark, search=feeds.WorkspaceSearch(factory), blocks=feeds.WorkspaceBlocks(factory))
    assert {r.id for r in everything.incremental("2024-01-05").items.collect()} == {"r", "s"}


def test_block_lines():
    text = lambda s: {"rich_text": [{"plain_text": s}]}
    row = lambda *c: {"type": "table_row", "table_row": {"cells": [[{"plain_text": x}] for x in c]}}
    lines = lambda kind, own, *inner: notion.block_lines({"type": kind, kind: own, "children": list(inner)})
    assert lines("toggle", text("{more}"), {"type": "paragraph", "paragraph": text("inside")}) == ["**{more}**", "inside"]
    assert lines("callout", text("note") | {"icon": {"emoji": "!"}}) == ["> **!** note"]
    assert lines("table", {"has_column_header": False}, row("a", "b"), row("c", "d")) == ["| a | b |", "| c | d |"]
    assert lines("table", {"has_column_header": True, "table_width": 2}, row("a", "b"), row("c", "d")) == ["| a | b |", "| --- | --- |", "| c | d |"]
    assert lines("column_list", {}, {"type": "column", "children": [{"type": "divider", "divider": {}}]}) == ["---"] and lines("breadcrumb", {}) == []
    assert lines("child_page", {"title": "T"}) == ["[Page: T]"] and lines("bookmark", {"url": "u", "caption": None}) == ["[u](u)"] and lines("equation", {"expression": "x"}) == ["$$x$$"]


def streamed(spark, state, out, client="chat", channels="a,b", position="ts", schema="channel string, ts string, text string", **options):
    rows = spark.readStream.format("channel-feed").schema(schema).options(client=f"fake_api:{client}", channels=channels, path=state.path, position=position, **options).load()
    query = rows.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(str(out / "rows"))


def test_stream_goes_on_from_its_offset(spark, chat, tmp_path):
    spark.dataSource.register(feeds.FeedSource)
    chat.data["channels"]["closed"] = []
    chat.write()
    assert sorted(r.ts for r in streamed(spark, chat, tmp_path, channels="a,b,closed").collect()) == ["1.0", "2.0", "3.0", "4.0"]
    chat.data["channels"]["a"].append(message("5.0", "new"))
    chat.data["channels"]["closed"] = [message("0.5", "opened")]
    chat.write()
    before = len(chat.calls())
    rows = streamed(spark, chat, tmp_path, channels="a,b,closed").collect()
    assert sorted((r.channel, r.ts) for r in rows) == [("a", "1.0"), ("a", "2.0"), ("a", "3.0"), ("a", "5.0"), ("b", "4.0"), ("closed", "0.5")]
    read = [p for _, p in chat.calls()[before:] if p["limit"] > 1]
    assert {p["channel"]: p.get("oldest") for p in read} == {"a": "3.0", "closed": None}  # b is not read again
    assert len(streamed(spark, chat, tmp_path, channels="a,b,closed").collect()) == 6


def test_stream_compares_ids_as_numbers(spark, tmp_path):
    spark.dataSource.register(feeds.FeedSource)
    said = lambda *ids: [{"id": str(i), "author": {"username": "a"}, "content": "x", "timestamp": "now"} for i in ids]
    state = State(tmp_path, said={"c": said(8, 9), "empty": []})
    read = partial(streamed, spark, state, tmp_path, "forum", "c,empty", "id", "channel string, id string, text string")
    assert sorted(r.id for r in read().collect()) == ["8", "9"]
    state.data["said"] = {"c": said(8, 9, 10, *range(100, 350)), "empty": said(1)}
    state.write()
    assert sorted(int(r.id) for r in read().collect()) == sorted([8, 9, 10, 1, *range(100, 350)])


def reader(state, channels="a,b"):
    return feeds.FeedReader({"client": "fake_api:chat", "channels": channels, "path": state.path}, feeds.StructType.fromDDL("channel string, ts string"))


def test_offsets(spark, chat):
    feed = reader(chat)
    assert feed.initialOffset() == {"a": None, "b": None}
    end = feed.latestOffset()
    assert end == {"a": "3.0", "b": "4.0"}
    parts = feed.partitions({"a": "1.0", "b": "4.0"}, end)
    assert [p.value for p in parts] == [("a", "1.0", "3.0")] and sorted(feed.read(parts[0])) == [("a", "2.0"), ("a", "3.0")]
    chat.data["channels"]["a"].append(message("9.0", "later"))
    chat.data["channels"].pop("b")
    chat.write()
    assert sorted(feed.read(parts[0])) == [("a", "2.0"), ("a", "3.0")]  # a batch that is read again gives the same
    assert feed.latestOffset() == {"a": "9.0", "b": "4.0"}  # a channel that fails keeps its position
    chat.data["channels"]["a"] = chat.data["channels"]["a"][:1]
    chat.write()
    assert feed.latestOffset() == {"a": "9.0", "b": "4.0"}  # nor does a deleted message move it back


def test_offsets_of_failing_channels(spark, chat):
    with pytest.raises(clients.Refused):
        reader(chat, "a,closed").latestOffset()  # after a restart its position is not known
    feed = reader(chat, "closed")
    feed.initialOffset()
    with pytest.raises(clients.Refused):
        feed.latestOffset()
