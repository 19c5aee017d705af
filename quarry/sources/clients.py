"""Clients of chat and workspace services: pages of rows from a function get(path, parameters) -> (status, headers, body).

A client keeps no rows: its methods yield one page at a time, so a task holds a page whatever the length of a channel. Calls wait where
the service asks for it, are repeated after a lost connection or a status of 500 and more, and keep a pause between each other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from quarry.sources.api import MAX_RETRIES, Throttled, patiently

Get = Callable[[str, dict[str, Any]], tuple[int, dict[str, str], Any]]
Page = list[dict[str, Any]]
#: Rows of a page by service, the pause in seconds that the workspace service asks for, and how deep its blocks are read.
MESSAGES, REPLIES, FORUM, ENTRIES, PAUSE, DEPTH = 200, 200, 100, 100, 0.34, 10


class Refused(Exception):
    """The service answered with an error that waiting does not mend."""


class Web:
    """Calls of one service from one task."""

    def __init__(self, get: Get, pause: float = 0.0, retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.get, self.pause, self.retries, self.sleep, self.clock, self.last = get, pause, retries, sleep, clock, None

    def _once(self, path: str, parameters: dict[str, Any]) -> Any:
        if self.last is not None and (wait := self.last + self.pause - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        status, headers, body = self.get(path, parameters)
        error = body.get("error") if isinstance(body, dict) else None
        if status == 429 or error == "ratelimited":
            asked = {k.lower(): v for k, v in headers.items()}.get("retry-after")
            raise Throttled(float(asked) if asked else None)
        if status >= 500:
            raise ConnectionError(f"{path}: status {status}")
        if status >= 400 or (error and not body.get("ok", True)):
            raise Refused(f"{path}: {error or status}")
        return body

    def __call__(self, path: str, **parameters: Any) -> Any:
        given = {k: v for k, v in parameters.items() if v is not None}
        return patiently(lambda: self._once(path, given), self.retries, self.sleep)

    def cursored(self, path: str, rows: str, more: Callable[[dict], str | None], name: str = "cursor", **parameters: Any) -> Iterator[Page]:
        """Pages until there is no next cursor; a cursor that comes twice ends them too, as it would never end."""
        cursor, seen = None, set()
        while True:
            body = self(path, **parameters, **{name: cursor})
            yield body.get(rows) or []
            cursor = more(body)
            if not cursor or cursor in seen:
                return
            seen.add(cursor)


class ChatClient:
    """Channels of messages with threads of replies. Positions are times as text of a fixed form; they order messages."""

    position = staticmethod(str)

    def __init__(self, get: Get, **more: Any):
        self.call = Web(get, **more)

    def messages(self, channel: str, after: str | None = None) -> Iterator[Page]:
        """Messages of the channel itself, those after a position only."""
        for page in self.call.cursored("conversations.history", "messages", _next, channel=channel, oldest=after, limit=MESSAGES):
            yield [_message(channel, m) for m in page if after is None or m["ts"] > after]

    def latest(self, channel: str) -> str | None:
        found = self.call("conversations.history", channel=channel, limit=1).get("messages") or []
        return max((m["ts"] for m in found), default=None)

    def replies(self, channel: str, thread: str) -> Iterator[Page]:
        for page in self.call.cursored("conversations.replies", "messages", _next, channel=channel, ts=thread, limit=REPLIES):
            yield [_message(channel, m) for m in page]

    def user(self, user: str) -> dict[str, Any]:
        found = self.call("users.info", user=user).get("user") or {}
        profile = found.get("profile") or {}
        return {"id": user, "name": profile.get("display_name") or profile.get("real_name") or user, "team": found.get("team_id")}

    def team(self, team: str) -> dict[str, Any]:
        """The team's name; null where it may not be read."""
        try:
            return {"id": team, "name": (self.call("team.info", team=team).get("team") or {}).get("name")}
        except Refused:
            return {"id": team, "name": None}


def _next(body: dict) -> str | None:
    return (body.get("response_metadata") or {}).get("next_cursor")


def _message(channel: str, m: dict) -> dict[str, Any]:
    reactions = [{"name": r.get("name"), "count": r.get("count")} for r in m.get("reactions") or []]
    return {"channel": channel, "ts": m["ts"], "thread_ts": m.get("thread_ts"), "reply_count": m.get("reply_count"), "user": m.get("user"), "text": m.get("text") or "", "reactions": reactions}


class ForumClient:
    """Channels of messages and forums of threads. Positions are ids, which grow with time; they are compared as numbers."""

    position = staticmethod(int)

    def __init__(self, get: Get, guild: str = "", **more: Any):
        self.call, self.guild = Web(get, **more), guild

    def messages(self, channel: str, after: str | None = None) -> Iterator[Page]:
        """Messages after an id, oldest page first, whatever the order within a page is."""
        last = after
        while page := self.call(f"/channels/{channel}/messages", after=last or "0", limit=FORUM):
            yield [self._said(channel, m) for m in page]
            last = max((m["id"] for m in page), key=int)
            if len(page) < FORUM:
                return

    def latest(self, channel: str) -> str | None:
        return max((m["id"] for m in self.call(f"/channels/{channel}/messages", limit=1) or []), key=int, default=None)

    def _said(self, channel: str, m: dict) -> dict[str, Any]:
        author = m.get("author") or {}
        reactions = [{"name": (r.get("emoji") or {}).get("name"), "count": r.get("count")} for r in m.get("reactions") or []]
        return {"channel": channel, "id": m["id"], "author": author.get("global_name") or author.get("username"), "text": m.get("content") or "", "timestamp": m.get("timestamp"), "reactions": reactions}

    def threads(self, channel: str) -> Iterator[Page]:
        """Active threads of the forum, then archived ones, public before private. A thread may come in more than one list; of its rows that of the
        least place counts. A list that may not be read is left out, unless none can be read."""
        place, failed = 0, []
        for pages in (self._active(channel), self._archived(channel, "public"), self._archived(channel, "private")):
            try:
                for page in pages:
                    yield [self._thread(channel, t) | {"place": place + i} for i, t in enumerate(page)]
                    place += len(page)
            except (Refused, Throttled, ConnectionError) as e:
                failed.append(e)
        if len(failed) == 3:
            raise failed[0]

    def _active(self, channel: str) -> Iterator[Page]:
        yield [t for t in self.call(f"/guilds/{self.guild}/threads/active").get("threads") or [] if t.get("parent_id") == channel]

    def _archived(self, channel: str, kind: str) -> Iterator[Page]:
        last = lambda body: body["threads"][-1]["id"] if body.get("has_more") and body.get("threads") else None
        return self.call.cursored(f"/channels/{channel}/threads/archived/{kind}", "threads", last, name="before")

    def _thread(self, channel: str, t: dict) -> dict[str, Any]:
        return {"channel": channel, "id": t["id"], "name": t.get("name"), "message_count": t.get("message_count"), "last_message_id": t.get("last_message_id"), "url": f"https://discord.com/channels/{self.guild}/{channel}/{t['id']}"}


class WorkspaceClient:
    """Pages, databases of pages, and the blocks of a page."""

    def __init__(self, get: Get, pause: float = PAUSE, depth: int = DEPTH, **more: Any):
        self.call, self.depth = Web(get, pause=pause, **more), depth

    def _pages(self, path: str, **parameters: Any) -> Iterator[Page]:
        yield from self.call.cursored(path, "results", _more, name="start_cursor", page_size=ENTRIES, **parameters)

    def search(self, after: str | None = None) -> Iterator[Page]:
        """All pages, those edited later than a time only."""
        for page in self._pages("search", filter="page"):
            yield [_page(p) for p in page if p.get("object", "page") == "page" and (after is None or p["last_edited_time"] > after)]

    def entries(self, database: str, after: str | None = None) -> Iterator[Page]:
        for page in self._pages(f"databases/{database}/query"):
            yield [_page(p) for p in page if after is None or p["last_edited_time"] > after]

    def page(self, page: str) -> dict[str, Any]:
        return _page(self.call(f"pages/{page}"))

    def blocks(self, parent: str, depth: int = 0) -> Page:
        """The blocks of a page with those in them as children, to the depth that is read. They are one row's content, so they are held together."""
        if depth >= self.depth:
            return []
        found = [b for page in self._pages(f"blocks/{parent}/children") for b in page]
        return [b | {"children": self.blocks(b["id"], depth + 1)} if b.get("has_children") else b for b in found]


def _more(body: dict) -> str | None:
    return body.get("next_cursor") if body.get("has_more") else None


def _page(p: dict) -> dict[str, Any]:
    """A page's row: its title is that of its property of type title; properties go by name, as they came."""
    properties = p.get("properties") or {}
    titles = [v.get("title") or [] for v in properties.values() if v.get("type") == "title"]
    parent = p.get("parent") or {}
    kind = parent.get("type") or "workspace"
    title = "".join(t.get("plain_text") or "" for t in titles[0]) if titles else ""
    return {"id": p["id"], "title": title, "last_edited": p["last_edited_time"], "url": p.get("url"), "parent_type": kind, "parent_id": parent.get(kind) if kind != "workspace" else None, "properties": properties}
