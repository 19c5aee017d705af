"""Clients for the tests of sources: two pages in each channel of the paged data source, and a service whose state is a file."""

import json
from pathlib import Path

from quarry.sources import clients


def client(channel, cursor):
    n = int(cursor or 0)
    return [(channel, f"{n}.{i}", "u", f"text {n}", f"{n}.0", 3 if i == 0 else None) for i in range(2)], str(n + 1) if n == 0 else None


class Service:
    """A chat, forum and workspace service over one JSON file, so that tasks see what a test writes. It answers the first call of each task and path with 429 or 503."""

    def __init__(self, path, busy=True):
        self.path, self.busy, self.asked = path, busy, set()

    def __call__(self, path, parameters):
        data = json.loads(Path(self.path).read_text())
        if self.busy and path not in self.asked:
            self.asked.add(path)
            return (429, {"Retry-After": "1"}, None) if len(path) % 2 else (503, {}, None)
        with open(self.path + ".log", "a") as log:
            log.write(json.dumps([path, parameters]) + "\n")
        return getattr(self, path.replace("/", " ").replace(".", " ").split()[0])(data, path, parameters)

    def conversations(self, data, path, parameters):
        channel = data["channels"].get(parameters["channel"])
        if channel is None:
            return 200, {}, {"ok": False, "error": "not_in_channel"}
        if path.endswith("history"):
            rows = sorted((m for m in channel if m["ts"] > parameters.get("oldest", "") and m.get("thread_ts", m["ts"]) == m["ts"]), key=lambda m: m["ts"], reverse=True)
        else:
            rows = [m for m in channel if m.get("thread_ts") == parameters["ts"]]
        return self._paged(rows, parameters, 1 if parameters["limit"] == 1 else 2)

    def _paged(self, rows, parameters, size):
        at = int(parameters.get("cursor", 0))
        return 200, {}, {"ok": True, "messages": rows[at : at + size], "response_metadata": {"next_cursor": str(at + size) if at + size < len(rows) else ""}}

    def users(self, data, path, parameters):
        user = data["users"].get(parameters["user"])
        return 200, {}, {"ok": True, "user": user} if user else {"ok": False, "error": "user_not_found"}

    def team(self, data, path, parameters):
        name = data["teams"].get(parameters["team"])
        return 200, {}, {"ok": True, "team": {"name": name}} if name else {"ok": False, "error": "missing_scope"}

    def guilds(self, data, path, parameters):
        return 200, {}, {"threads": data["active"]}

    def channels(self, data, path, parameters):
        _, channel, *rest = path.strip("/").split("/")
        if rest[0] == "threads":
            if rest[-1] == "private":
                return 403, {}, None
            rows = [t for t in data["archived"] if t["parent_id"] == channel]
            at = next((i + 1 for i, t in enumerate(rows) if t["id"] == parameters.get("before")), 0)
            return 200, {}, {"threads": rows[at : at + 1], "has_more": at + 1 < len(rows)}
        if channel not in data["said"]:
            return 403, {}, None
        rows = sorted((m for m in data["said"][channel] if int(m["id"]) > int(parameters.get("after", 0))), key=lambda m: int(m["id"]))
        rows = rows[: parameters["limit"]] if "after" in parameters else rows[-parameters["limit"] :]
        return 200, {}, rows[::-1]

    def _listed(self, rows, parameters):
        at = int(parameters.get("start_cursor", 0))
        return 200, {}, {"results": rows[at : at + 2], "has_more": at + 2 < len(rows), "next_cursor": str(at + 2)}

    def search(self, data, path, parameters):
        return self._listed(data["pages"], parameters)

    def databases(self, data, path, parameters):
        return self._listed([p for p in data["pages"] if (p["parent"]).get("database_id") == path.split("/")[1]], parameters)

    def pages(self, data, path, parameters):
        found = [p for p in data["pages"] if p["id"] == path.split("/")[1]]
        return (200, {}, found[0]) if found else (404, {}, None)

    def blocks(self, data, path, parameters):
        return self._listed(data["blocks"].get(path.split("/")[1], []), parameters)


def chat(options):
    return clients.ChatClient(Service(options["path"], busy=False))


def forum(options):
    return clients.ForumClient(Service(options["path"], busy=False), "g")
