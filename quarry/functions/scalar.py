"""Column functions on paths, urls and texts; all are JVM expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "swift": "swift", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sql": "sql",
    "sh": "shell", "bash": "shell", "zsh": "shell", "css": "css", "scss": "scss", "html": "html", "xml": "xml",
}
#: Fixed values of the low-value rule.
LOW_VALUE_LEAST, LOW_VALUE_SEEN, LOW_VALUE_SHARE = 500, 8192, 0.30


def language(path: Column) -> Column:
    """Of a file by its extension; one that is not known stands for itself, and so does a name without a dot."""
    extension = F.lower(F.substring_index(path, ".", -1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.nullif(extension, F.lit("")), F.lit("text"))


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ** crosses folders, * and ? stay within one."""
    out = []
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob.replace("\\", "/")):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", part))
    return f"^{''.join(out)}$"


def glob_match(path: Column, include: list[str], exclude: list[str] = []) -> Column:
    """Whether a path matches any include and no exclude."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    any_of = lambda globs: reduce(Column.__or__, (path.rlike(glob_regex(g)) for g in globs), F.lit(False))
    return any_of(include) & ~any_of(exclude)


def low_semantic_value(text: Column) -> Column:
    """Whether a text is mostly numbers and separators."""
    seen = F.substring(text, 1, LOW_VALUE_SEEN)
    share = F.length(F.regexp_replace(seen, "[^0-9.,;=]", "")) / F.length(seen)
    return F.coalesce((F.length(text) >= LOW_VALUE_LEAST) & (share > LOW_VALUE_SHARE), F.lit(False))


def derived_url(path: Column, base_url: str | None, strip_prefix: str = "", strip_suffix: str = "", strip_route_groups: bool = False, strip_index: bool = False) -> Column:
    """The public url of a file; null without a base."""
    if not base_url:
        return F.lit(None).cast("string")
    out = path
    if strip_prefix:
        out = F.when(out.startswith(strip_prefix), F.substring(out, len(strip_prefix) + 1, 1 << 30)).otherwise(out)
    if strip_suffix:
        out = F.when(out.endswith(strip_suffix), out.substr(F.lit(1), F.length(out) - len(strip_suffix))).otherwise(out)
    if strip_route_groups:
        out = F.regexp_replace(out, r"\([^)]*\)/", "")
    if strip_index:
        out = F.when(out == "index", F.lit("")).otherwise(F.regexp_replace(out, "/index$", ""))
    return F.concat(F.lit(base_url), out)


def question(content: Column) -> Column:
    """The question of a text that begins with Q:, else null."""
    return F.nullif(F.trim(F.regexp_extract(content, r"^Q:\s*(.+?)(?:\n|$)", 1)), F.lit(""))


def answer(content: Column) -> Column:
    """What follows A: at the start of a line, else the whole text."""
    return F.when(content.rlike(r"\nA:"), F.trim(F.regexp_extract(content, r"\nA:\s*([\s\S]*)", 1))).otherwise(content)


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at its end opens no further line."""
    return F.when(F.length(text) == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1))


def file_facts(text: Column) -> Column:
    return F.struct(F.octet_length(text).alias("size"), line_count(text).alias("lines"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def cosine(embedding: Column, query: list[float]) -> Column:
    """Cosine with a fixed vector, in double precision; null where lengths differ or a vector is zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    own = F.transform(embedding, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(own, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x)) * norm
    return F.when((F.size(embedding) == len(query)) & (length > 0), dot / length)


def retry_after(seconds: Column) -> Column:
    """Whole seconds from 1 to 300; 60 where there is none."""
    usable = seconds.isNotNull() & ~F.isnan(seconds.cast("double")) & (seconds > 0) & (F.abs(seconds.cast("double")) != float("inf"))
    return F.when(usable, F.greatest(F.lit(1), F.least(F.lit(300), F.floor(seconds)))).otherwise(60).cast("int")


def client_ip(*candidates: Column) -> Column:
    """The first candidate that is not empty, else 'unknown'."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], F.lit("unknown"))
