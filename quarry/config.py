"""Rules that a configuration (a dict of server, sources, tools, embedding, indexing and analytics) has to keep."""

from __future__ import annotations

from typing import Any

#: Kinds of sources, tools and vectors; defaults.
SOURCES = {"markdown", "code", "raw-text", "html", "document", "slack", "discord", "notion"}
FAQ_SOURCES = {"slack", "discord"}
TOOLS = {"search", "collect", "bash", "knowledge"}
MODES = {"vector", "keyword", "hybrid"}
EMBEDDERS = {"openai", "ollama", "local"}
DEFAULTS = {"min_confidence": 0.7, "default_limit": 20, "max_limit": 100, "confidence_threshold": 0.7, "min_thread_replies": 2, "max_depth": 5, "retention_days": 90}


def errors(config: dict[str, Any]) -> list[str]:
    """What is wrong with a configuration; nothing if it may be used."""
    out: list[str] = []
    sources, tools = config.get("sources") or [], config.get("tools") or []
    names = [s.get("name") for s in sources]
    for kind, rows in (("source", sources), ("tool", tools)):
        own = [r.get("name") for r in rows]
        out += [f"{kind} names must be there and differ: {n}" for n in dict.fromkeys(own) if not n or own.count(n) > 1]
    for s in sources:
        if s.get("type") not in SOURCES:
            out.append(f"source {s.get('name')}: unknown type {s.get('type')}")
        chunk = s.get("chunk") or {}
        out += [f"source {s.get('name')}: chunk.{k} must be a positive whole number" for k in ("target_tokens", "target_lines") if k in chunk and not (isinstance(chunk[k], int) and chunk[k] > 0)]
    by_name = {s.get("name"): s for s in sources}
    for t in tools:
        name, kind = t.get("name"), t.get("type")
        used = t.get("sources") or ([t["source"]] if t.get("source") else [])
        if kind not in TOOLS:
            out.append(f"tool {name}: unknown type {kind}")
            continue
        out += [f"tool {name}: no source {u}" for u in used if u not in names]
        if kind in ("search", "knowledge"):
            out += [f"tool {name}: {need} settings are missing" for need in ("embedding", "indexing") if not config.get(need) and not (need == "embedding" and t.get("search_mode") == "keyword")]
            if t.get("default_limit", DEFAULTS["default_limit"]) > t.get("max_limit", DEFAULTS["max_limit"]):
                out.append(f"tool {name}: default_limit is over max_limit")
        if kind == "search" and t.get("search_mode", "vector") not in MODES:
            out.append(f"tool {name}: unknown search_mode {t['search_mode']}")
        if kind in ("bash", "knowledge") and not used:
            out.append(f"tool {name}: needs sources")
        if kind == "knowledge":
            out += [f"tool {name}: {u} is no source of questions and answers" for u in used if u in by_name and by_name[u].get("type") not in FAQ_SOURCES and by_name[u].get("category") != "faq"]
        if kind == "bash" and t.get("grep_strategy") in ("vector", "hybrid") and not config.get("embedding"):
            out.append(f"tool {name}: {t['grep_strategy']} grep needs embedding settings")
        if kind == "collect" and not t.get("schema"):
            out.append(f"tool {name}: needs a schema")
    embedding = config.get("embedding")
    if embedding and embedding.get("provider") not in EMBEDDERS:
        out.append(f"unknown embedding provider {embedding.get('provider')}")
    return out


def tools_of(config: dict[str, Any], source: str) -> list[str]:
    return [t["name"] for t in config.get("tools") or [] if source in (t.get("sources") or [t.get("source")])]
