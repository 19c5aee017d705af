"""Tools by name over one chunk table: search, knowledge, shell-like commands and health, each logged like any query."""

from __future__ import annotations

import shlex
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import glob_match
from quarry.operators import render, search, upkeep
from quarry.plans.indexing import Embedder
from quarry.schemas import QUERY_LOG

#: What a search without result suggests; what a failed search says.
HINT = "No literal match. A search by meaning may find more: qmd <text>."
FAILED = "The search failed. Try again later."


@dataclass
class Toolbox:
    """chunks: the chunk table; embed: of queries. Calls are kept in log until logged() is read."""

    chunks: DataFrame
    embed: Embedder
    session_id: str | None = None
    log: list[tuple] = field(default_factory=list)

    def _logged(self, tool: str, text: str, results: DataFrame, source: str | None, begun: float) -> DataFrame:
        # a handful of rows, read once from here on
        results = results.sparkSession.createDataFrame(results.collect(), results.schema)
        n, top = results.agg(F.count("*"), F.max("similarity")).first()
        self.log.append((tool, text, n, top, int((time.time() - begun) * 1000), source, self.session_id))
        return results

    def logged(self) -> DataFrame:
        """The calls so far as rows of the query log."""
        spark = self.chunks.sparkSession
        columns = QUERY_LOG.rsplit(", ", 1)[0]
        return spark.createDataFrame(self.log, columns.replace("top_score float", "top_score double")).withColumn("top_score", F.col("top_score").cast("float")).withColumn("created_at", F.localtimestamp())

    def search(self, tool: str, query: str, mode: str = "vector", limit: int | None = None, default_limit: int = 5, max_limit: int = 20, min_score: float | None = None, source: str | None = None, version: str | None = None, form: str = "raw") -> str:
        """The formatted results of a search tool."""
        limit, begun = min(limit or default_limit, max_limit), time.time()
        try:
            if mode == "keyword":
                found = search.keyword_search(self.chunks, query, limit, source, version)
            elif mode == "hybrid":
                found = search.hybrid_search(self.chunks, self.embed([query])[0], query, limit, min_score, source=source, version=version)
            else:
                found = search.vector_search(self.chunks, self.embed([query])[0], limit, source, version, min_score)
            return render.search_results(self._logged(tool, query, found, source, begun), form).first().text
        except (ConnectionError, TimeoutError):
            return FAILED

    def knowledge(self, tool: str, sources: list[str], query: str | None = None, limit: int = 20, min_confidence: float = 0.7) -> str:
        """FAQ rows: the latest without a query, else the nearest."""
        begun = time.time()
        found = search.knowledge_search(self.chunks, self.embed([query])[0], sources, limit, min_confidence) if query else search.faq_browse(self.chunks, sources, min_confidence, limit)
        return render.faq_results(self._logged(tool, query or "<browse>", found, ",".join(sources), begun)).first().text

    def found(self, command: str, cwd: str = "/") -> tuple[DataFrame | None, int]:
        """What a shell-like command finds, as rows to sort by path, line and id, with the column text; and the exit code if it finds nothing or (None) can't run.

        ls, cat, head [-n N], find [-name GLOB], grep [-l], qmd and related, over the virtual file tree. Nothing comes to the driver.
        """
        try:
            name, *args = shlex.split(command)
        except ValueError:
            return None, 2
        flags, words = _flags(args, {"head": ["-n"], "find": ["-name"]}.get(name, []))
        tree = self.chunks.withColumn("path", search.virtual_path())
        at = resolved(words[-1], cwd) if words and (name in ("ls", "cat", "head", "find", "related") or name == "grep" and len(words) > 1) else cwd
        below = (F.col("path") == at) | F.startswith("path", F.lit(at.rstrip("/") + "/"))
        row = lambda rows, path, line, text: rows.select(F.col(path).alias("path") if path else F.lit("").alias("path"), line.alias("line"), F.lit(0).cast("long").alias("id"), text.alias("text"))
        if name == "ls":
            rows = search.listing(self.chunks, at).withColumn("name", F.concat("name", F.when(F.col("is_dir"), "/").otherwise("")))
            return row(rows, "name", F.when(F.col("is_dir"), 0).otherwise(1), F.col("name")).withColumn("path", F.concat(F.col("line").cast("string"), "path")), 2
        if name in ("cat", "head"):
            own = tree.where(F.col("path") == at)
            lines = own.select(F.lit("").alias("path"), "chunk_index", "id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
            if name == "head":
                first = int(flags.get("-n") or 10)
                # a chunk has a line at least
                lines = own.orderBy("chunk_index", "id").limit(first).select(F.lit("").alias("path"), "chunk_index", "id", F.posexplode(F.split("content", "\n")).alias("line", "text")).orderBy("chunk_index", "id", "line").limit(first)
            return lines.select("path", F.struct("chunk_index", "id", "line").alias("line"), F.lit(0).cast("long").alias("id"), "text"), 1
        if name == "find":
            rows = tree.where(below & (F.col("path") != at)).select("path").distinct()
            if "-name" in flags:
                rows = rows.where(glob_match(F.substring_index("path", "/", -1), [flags["-name"]]))
            return row(rows, "path", F.lit(0), F.col("path")), 0
        if name in ("grep", "qmd"):
            if not words:
                return None, 2
            literal = words[0] if name == "grep" else " ".join(words)
            rows = search.grep(self.chunks, literal).where(below) if name == "grep" else search.semantic_grep(self.chunks, self.embed([literal])[0], literal)
            if "-l" in flags:
                return row(rows.select("path").distinct(), "path", F.lit(0), F.col("path")), 1
            return rows.select("path", "line", "id", F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), "text").alias("text")), 1
        if name == "related":
            text = tree.where(F.col("path") == at).orderBy("chunk_index", "id").select(F.substring("content", 1, 8000).alias("t")).first()
            if text is None:
                return None, 1
            rows = search.related_files(self.chunks, self.embed([text.t])[0], at)
            return row(rows, "path", -F.col("similarity"), F.format_string("%s (%.2f)", "path", "similarity")).withColumn("path", F.lit("")), 0
        return None, 127

    def shell(self, command: str, cwd: str = "/", page: int = 2000, skip: int = 0) -> tuple[str, int]:
        """A page of what a command finds, as text, and the exit code; a last line tells how to go on where there is more."""
        rows, code = self.found(command, cwd)
        if rows is None:
            return (f"{command.split()[0]}: not found" if code == 127 else ""), code
        got = [r.text for r in rows.orderBy("path", "line", "id", "text").offset(skip).limit(page + 1).select("text").collect()]
        if not got and not skip:
            return (HINT if command.split()[0] == "grep" else ""), code
        more = [f"... more: from line {skip + page + 1} on"] if len(got) > page else []
        return "\n".join([*got[:page], *more]), 0

    def health(self, states: DataFrame) -> dict[str, Any]:
        """Numbers of chunks by source and in all, and the states of the sources."""
        rows = {r.source_name: r.asDict() for r in upkeep.index_stats(self.chunks).collect()}
        total = rows.pop("*")
        return {"total": total["chunks"], "repos": total["repos"], "by_source": {k: r["chunks"] for k, r in rows.items()}, "states": [r.asDict() for r in states.orderBy("source_type", "source_key").collect()]}


def resolved(path: str, cwd: str = "/") -> str:
    """An absolute path without dots, doubled or trailing slashes."""
    out: list[str] = []
    for part in (path if path.startswith("/") else f"{cwd}/{path}").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


def _flags(args: list[str], valued: list[str]) -> tuple[dict[str, str], list[str]]:
    """Flags, with the values of those that take one, and words; clustered one-letter flags are taken apart."""
    flags, words, rest = {}, [], list(args)
    while rest:
        a = rest.pop(0)
        if a in valued and rest:
            flags[a] = rest.pop(0)
        elif a[:2] in valued and len(a) > 2:
            flags[a[:2]] = a[2:]
        elif a.startswith("-") and len(a) > 1:
            flags |= {f"-{c}": "" for c in a[1:]}
        else:
            words.append(a)
    return flags, words
