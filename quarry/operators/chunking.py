"""Chunkers: each adds to items (id, content) a column chunks, an array made by column expressions over the item's row. What an expression
needs more than once is a column of its own, so that it is evaluated once.

Sizes are in characters, four to a token. Chunks overlap: each begins with the end of the one before it, from its last
line end on. Blank content has no chunks. chunked() explodes the arrays; register() adds chunkers for other types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import html as html_reader
from quarry.functions.scalar import language, question

CHUNK = "struct<content: string, title: string, heading_path: array<string>, start_line: int, end_line: int, language: string>"
SPACES = " \t\n\r\x0b\x0c\u00a0\ufeff\u2028\u2029"
#: Stands for a line end inside a fenced block; not a character of texts.
HIDDEN = "\ue000"
FENCE = r"(?m)^(`{3,})[^\n]*\n(?:[\s\S]*?\n)?\1\s*$"


@dataclass(frozen=True)
class Sizes:
    target_tokens: int = 600
    overlap_tokens: int = 50
    target_lines: int = 80
    overlap_lines: int = 10

    @property
    def target(self) -> int:
        return 4 * self.target_tokens

    @property
    def overlap(self) -> int:
        return 4 * self.overlap_tokens


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    return F.length(trimmed(c)) > 0


def chunk(content: Column, title: Column | None = None, path: Column | None = None, first: Column | None = None, last: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None)
    values = {"content": content, "title": title, "heading_path": path, "start_line": first, "end_line": last, "language": lang}
    return F.struct(*[(none if v is None else v).alias(k) for k, v in values.items()]).cast(CHUNK)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged(parts: Column, target: int, separator: str, unless_line_end: bool = False) -> Column:
    """Neighbouring parts joined for as long as they keep to the target; blank results are left out.

    The fold keeps places and sizes only, so that no text is copied before its chunk is complete. unless_line_end: no
    separator follows a line end, nor an empty part, which has had one before it.
    """
    def between(last: Column) -> Column:
        if not unless_line_end:
            return F.lit(separator)
        return F.when((last == "") | last.endswith("\n") | last.endswith(HIDDEN), "").otherwise(separator)

    def step(s: Column, p: Column) -> Column:
        longer = F.when(s["size"] == 0, F.length(p)).otherwise(s["size"] + F.length(between(s["last"])) + F.length(p))
        full = (s["size"] > 0) & (longer > target)
        new = full | (s["size"] == 0)
        return F.struct(
            F.when(full, F.array_append(s["done"], F.struct(s["first"].alias("first"), s["n"].alias("n")))).otherwise(s["done"]).alias("done"), F.when(new, s["i"]).otherwise(s["first"]).alias("first"), F.when(new, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            F.when(full, F.length(p)).otherwise(longer).alias("size"), p.alias("last"), (s["i"] + 1).alias("i"),
        )

    def joined(all_parts: Column) -> Column:
        zero = F.lit(0)
        start = F.struct(F.array().cast("array<struct<first: int, n: int>>").alias("done"), zero.alias("first"), zero.alias("n"), zero.alias("size"), F.lit("").alias("last"), zero.alias("i"))
        runs = F.aggregate(all_parts, start, step, lambda s: F.when(s["size"] > 0, F.array_append(s["done"], F.struct(s["first"].alias("first"), s["n"].alias("n")))).otherwise(s["done"]))
        own = lambda r: F.slice(all_parts, r["first"] + 1, r["n"])
        if not unless_line_end:
            return F.transform(runs, lambda r: F.array_join(own(r), separator))
        spaced = lambda r: F.transform(own(r), lambda p, i: F.concat(F.when(i == 0, "").otherwise(between(F.get(all_parts, r["first"] + i - 1))), p))
        return F.transform(runs, lambda r: F.array_join(spaced(r), ""))

    return F.filter(once(parts, joined), filled)


def tail(text: Column, size: int) -> Column:
    """The last characters of a text, from their last line end on."""
    end = F.right(text, F.lit(size))
    return F.when(F.contains(end, F.lit("\n")), F.concat(F.lit("\n"), F.substring_index(end, "\n", -1))).otherwise(end)


def overlapped(texts: Column, size: int, separator: str) -> Column:
    if size <= 0:
        return texts
    return F.transform(texts, lambda t, i: F.when(i == 0, t).otherwise(F.concat(tail(F.get(texts, i - 1), size), F.lit(separator), t)))


def pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), filled)


# plain text, questions


def raw_text(items: DataFrame, sizes: Sizes) -> DataFrame:
    parts = merged(F.transform(pieces(F.col("content"), "\n\n+"), trimmed), sizes.target, "\n\n")
    return items.withColumn("parts", parts).withColumn("chunks", F.transform(overlapped(F.col("parts"), sizes.overlap, "\n\n"), lambda t: chunk(trimmed(t))))


def qa(items: DataFrame, sizes: Sizes) -> DataFrame:
    return items.withColumn("chunks", F.array(chunk(trimmed(F.col("content")), question(F.col("content")))))


# documents with pages


def section_header(line: Column) -> Column:
    """Whether a line is a header: capitals only, or numbered."""
    t = trimmed(line)
    return (F.length(t).between(1, 100)) & (t.rlike(r"^[A-Z][A-Z\s]{2,}[A-Z]$") | t.rlike(r"(?i)^(?:\d+\.(?:\d+\.)*\s+\S|Section\s+\d)"))


SECTION = "struct<title: string, content: string, page: int>"


def _page_sections(page: Column, number: Column) -> Column:
    """The text between headers, each with the header before it; headers without text are left out."""
    def cut(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda line, i: F.when(section_header(line), i)), lambda i: i.isNotNull())
        return once(places, lambda heads: F.zip_with(F.concat(F.array(F.lit(-1)), heads), F.concat(heads, F.array(F.size(lines))), lambda a, b: section(lines, a, b)))

    def section(lines: Column, a: Column, b: Column) -> Column:
        text = trimmed(F.array_join(F.slice(lines, a + 2, b - a - 1), "\n"))
        return F.struct(F.when(a >= 0, trimmed(F.get(lines, a))).alias("title"), text.alias("content"), number.alias("page")).cast(SECTION)

    return F.filter(once(F.split(page, "\n"), cut), lambda x: x["content"] != "")


def _merged_sections(sections: Column, target: int) -> Column:
    """Sections joined as merged() does, but a section with a title of its own begins anew. The fold keeps places and sizes, as that of merged() does."""
    run = "struct<first: int, n: int, title: string, page: int>"

    def out(s: Column) -> Column:
        return F.when(s["now"]["n"] > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        now = s["now"]
        longer = s["size"] + F.when(now["n"] > 0, 2).otherwise(0) + F.length(x["content"])
        full = (now["n"] > 0) & ((longer > target) | x["title"].isNotNull())
        new = full | (now["n"] == 0)
        return F.struct(
            F.when(full, out(s)).otherwise(s["done"]).alias("done"), F.when(new, F.length(x["content"])).otherwise(longer).alias("size"), (s["i"] + 1).alias("i"),
            F.struct(
                F.when(new, s["i"]).otherwise(now["first"]).alias("first"), F.when(new, F.lit(1)).otherwise(now["n"] + 1).alias("n"),
                F.when(new, F.coalesce(x["title"], now["title"])).otherwise(now["title"]).alias("title"), F.when(new, x["page"]).otherwise(now["page"]).alias("page"),
            ).cast(run).alias("now"),
        )

    def joined(every: Column) -> Column:
        none = F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(None).alias("title"), F.lit(None).alias("page")).cast(run)
        start = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit(0).alias("size"), F.lit(0).alias("i"), none.alias("now"))
        text = lambda r: F.array_join(F.transform(F.slice(every, r["first"] + 1, r["n"]), lambda x: x["content"]), "\n\n")
        return F.transform(F.aggregate(every, start, step, out), lambda r: F.struct(r["title"].alias("title"), text(r).alias("content"), r["page"].alias("page")).cast(SECTION))

    return once(sections, joined)


def _resized(sections: Column, target: int, parts: Callable[[Column], Column], separator: str) -> Column:
    """Sections, with those over the target split into parts that are merged again."""
    def split(s: Column) -> Column:
        return F.transform(merged(parts(s["content"]), target, separator), lambda t: F.struct(s["title"].alias("title"), t.alias("content"), s["page"].alias("page")).cast(SECTION))

    return F.flatten(F.transform(sections, lambda s: F.when(F.length(s["content"]) <= target, F.array(s)).otherwise(split(s))))


def document(items: DataFrame, sizes: Sizes) -> DataFrame:
    number = lambda i: F.when(F.size("pages") > 1, i + 1)
    sections = F.flatten(F.transform("pages", lambda p, i: F.when(filled(p), _page_sections(trimmed(p), number(i))).otherwise(F.array().cast(f"array<{SECTION}>"))))
    rows = items.withColumn("pages", F.split("content", "\f")).withColumn("sections", sections).withColumn("joined", _merged_sections(F.col("sections"), sizes.target))
    rows = rows.withColumn("sized", _resized(F.col("joined"), sizes.target, lambda t: pieces(t, "\n\n+"), "\n\n"))
    rows = rows.withColumn("final", _resized(F.col("sized"), sizes.target, lambda t: F.split(t, r"\s+"), " ")).withColumn("texts", F.transform("final", lambda s: s["content"]))
    clean = lambda t: trimmed(F.regexp_replace(F.replace(t, F.lit("\f"), F.lit("\n\n")), "\n{3,}", "\n\n"))
    rows = rows.withColumn("texts", overlapped(F.col("texts"), sizes.overlap, "\n\n"))
    return rows.withColumn("chunks", F.zip_with("texts", "final", lambda t, s: chunk(clean(t), s["title"], first=s["page"], last=s["page"])))


# markdown


@F.pandas_udf(T.StringType())
def _without_tags(texts: pd.Series) -> pd.Series:
    """Component tags go, pair by pair until none is left; what is between them stays."""
    import re

    pair = re.compile(r"<([A-Z][A-Za-z0-9]*)(?:\s+[^>]*)?>([\s\S]*?)</\1>")

    def strip(text: str) -> str:
        while (out := pair.sub(r"\2", text)) != text:
            text = out
        return text

    return texts.map(lambda t: t if t is None or "</" not in t else strip(t))


def frontmatter_title(content: Column) -> Column:
    block = F.regexp_extract(content, r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?", 1)
    return F.nullif(trimmed(F.regexp_extract(block, r"""(?m)^title:\s*["']?(.+?)["']?\s*$""", 1)), F.lit(""))


def first_heading(body: Column) -> Column:
    return F.nullif(trimmed(F.regexp_extract(body, r"(?m)^#{1,6}\s+(.+)$", 1)), F.lit(""))


def plain_markdown(content: Column) -> Column:
    """The body of a file without imports and component tags."""
    body = F.regexp_replace(content, r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?", "")
    body = F.regexp_replace(body, r"""(?m)^import\s+[\s\S]*?from\s+['"][^'"]+['"];?\s*$""", "")
    body = _without_tags(F.regexp_replace(body, r"<[A-Z][A-Za-z0-9]*(?:\s+[^>]*)?\s*/>", ""))
    return trimmed(F.regexp_replace(body, "\n{3,}", "\n\n"))


def _hide_fences(text: Column) -> Column:
    """The line ends inside fenced blocks become HIDDEN, so that nothing splits there."""
    plain, fenced = F.split(text, FENCE), F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    return F.array_join(F.transform(plain, lambda p, i: F.concat(p, F.coalesce(F.replace(F.get(fenced, i), F.lit("\n"), F.lit(HIDDEN)), F.lit("")))), "")


def _shown(text: Column) -> Column:
    return F.replace(text, F.lit(HIDDEN), F.lit("\n"))


def _split_markdown(text: Column, target: int) -> Column:
    def by_line(t: Column) -> Column:
        split = lambda lines: F.when(F.size(lines) < 2, F.array(t)).otherwise(merged(lines, target, "\n\n", True))
        return F.when(F.length(t) <= target, F.array(t)).otherwise(once(F.split(_shown(t), "\n"), split))

    def by_paragraph(t: Column) -> Column:
        split = lambda parts: F.when(F.size(parts) > 1, F.flatten(F.transform(merged(parts, target, "\n\n", True), by_line))).otherwise(by_line(t))
        return F.when(F.length(t) <= target, F.array(t)).otherwise(once(pieces(t, "\n\n+"), split))

    def by_heading(t: Column, level: int, below: Callable[[Column], Column]) -> Column:
        # a text without such a heading is its one part
        split = lambda parts: F.flatten(F.transform(F.when(F.size(parts) > 1, parts).otherwise(F.array(t)), below))
        return F.when(F.length(t) <= target, F.array(t)).otherwise(once(pieces(t, f"(?m)(?=^{'#' * level} )"), split))

    by_h3 = lambda t: by_heading(t, 3, by_paragraph)
    return by_heading(text, 2, by_h3)


HEAD = "struct<level: int, text: string, first: int, last: int>"


def headings(body: Column) -> Column:
    """The headings of a text in order, with the places of their first and last characters, from 1 on."""
    def found(parts: Column) -> Column:
        # each part but perhaps the first begins with a heading; one of hashes alone takes the next part's line
        whole = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(parts, i + 1), F.lit(""))))
        of = lambda t, k: F.regexp_extract(t, r"^(#{1,6})(\s+)(.+)", k)
        sizes = F.transform(whole, lambda t: F.struct(F.length(of(t, 1)).alias("level"), of(t, 3).alias("text"), F.length(of(t, 0)).alias("size")))
        return F.arrays_zip(parts.alias("part"), sizes.alias("head"))

    def step(s: Column, x: Column) -> Column:
        head, at = x["head"], s["at"]
        new = F.struct(head["level"].alias("level"), trimmed(head["text"]).alias("text"), at.alias("first"), (at + head["size"] - 1).alias("last")).cast(HEAD)
        last = F.coalesce(F.try_element_at(s["all"], F.lit(-1))["last"], F.lit(0))
        return F.struct((at + F.length(x["part"])).alias("at"), F.when((head["level"] > 0) & (at > last), F.array_append(s["all"], new)).otherwise(s["all"]).alias("all"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{HEAD}>").alias("all"))
    return F.aggregate(once(F.split(body, r"(?m)(?=^#{1,6}\s+.+$)"), found), start, step, lambda s: s["all"])


def heading_path(heads: Column, before: Column) -> Column:
    """The headings that hold at a place, outermost first."""
    stack = F.aggregate(F.filter(heads, lambda h: h["last"] < before), F.array().cast(f"array<{HEAD}>"), lambda s, h: F.array_append(F.filter(s, lambda x: x["level"] < h["level"]), h))
    return F.transform(stack, lambda x: x["text"])


def markdown(items: DataFrame, sizes: Sizes) -> DataFrame:
    rows = items.withColumn("body", plain_markdown(F.col("content"))).where(filled(F.col("body")))
    rows = rows.withColumn("hidden", _hide_fences(F.col("body"))).withColumn("parts", F.transform(_split_markdown(F.col("hidden"), sizes.target), _shown))
    title = F.coalesce(frontmatter_title(F.col("content")), first_heading(F.col("body")), F.nullif(F.substring_index("id", "/", -1), F.lit("")), "id")

    def next_place(s: Column, p: Column) -> Column:
        at = F.call_function("locate", trimmed(p), F.col("body"), s["at"])
        return F.transform(F.array(at), lambda x: F.struct(F.when(x > 0, x).otherwise(s["at"]).alias("at"), F.array_append(s["all"], x).alias("all")))[0]

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all"))
    rows = rows.withColumn("title", title).withColumn("places", F.aggregate("parts", start, next_place, lambda s: s["all"])).withColumn("texts", overlapped(F.col("parts"), sizes.overlap, "")).withColumn("heads", headings(F.col("body")))
    none = F.array().cast("array<string>")
    found = F.zip_with("texts", "places", lambda t, p: chunk(trimmed(t), F.col("title"), F.when(p > 0, heading_path(F.col("heads"), p)).otherwise(none)))
    return rows.withColumn("chunks", F.filter(found, lambda c: c["content"] != ""))


# source code


STRINGS = r""""(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|//.*"""


def _open_after(lines: Column) -> Column:
    """For each line, whether a comment, template or docstring is open after it."""
    odd = lambda n: n % 2 == 1

    def step(s: Column, line: Column) -> Column:
        code = F.regexp_replace(line, STRINGS, "")
        ticks = odd(F.regexp_count(code, F.lit(r"(?<!\\)`")))
        starts = F.contains(code, F.lit("/*")) & ~F.contains(code, F.lit("*/"))
        doc = odd(F.regexp_count(line, F.lit('"""'))) | odd(F.regexp_count(line, F.lit("'''")))
        comment = F.when(s["comment"], ~F.contains(code, F.lit("*/"))).when(s["template"], False).otherwise(starts | (~ticks & doc))
        template = F.when(s["comment"], False).when(s["template"], ~ticks).otherwise(~starts & ticks)
        return F.struct(comment.alias("comment"), template.alias("template"), F.array_append(s["all"], comment | template).alias("all"))

    return F.aggregate(lines, F.struct(F.lit(False).alias("comment"), F.lit(False).alias("template"), F.array().cast("array<boolean>").alias("all")), step, lambda s: s["all"])


def _spaced(points: Column, least: int) -> Column:
    """The points that lie at least so far from the one taken before."""
    step = lambda s, p: F.when(p - F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) >= least, F.array_append(s, p)).otherwise(s)
    return F.aggregate(points, F.array().cast("array<int>"), step)


def _ranges(points: Column, n: Column) -> Column:
    starts = F.concat(F.array(F.lit(0)), points)
    return F.zip_with(starts, F.concat(F.transform(points, lambda p: p - 1), F.array(n - 1)), lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def code(items: DataFrame, sizes: Sizes) -> DataFrame:
    split, target = F.split("content", "\n"), sizes.target_lines
    rows = items.withColumn("lines", F.when(F.col("content").endswith("\n"), F.slice(split, 1, F.size(split) - 1)).otherwise(split)).withColumn("open", _open_after(F.col("lines"))).withColumn("n", F.size("lines"))
    n, every = F.col("n"), F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("blank", F.transform("lines", lambda x: ~filled(x)))
    free = lambda i: F.get("blank", i) & ~F.get("open", i)
    rows = rows.withColumn("single", F.filter(F.sequence(F.lit(0), n - 1), free)).withColumn("double", F.filter(every, lambda i: free(i) & F.get("blank", i - 1)))
    rows = rows.withColumn("coarse", _ranges(_spaced(F.col("double"), target), n)).withColumn("fine", _ranges(_spaced(F.col("single"), target), n))
    plain = F.transform(F.sequence(F.lit(0), n - 1, F.lit(target)), lambda a: F.struct(a.alias("first"), F.least(a + target - 1, n - 1).alias("last")))
    coarse_ok = (F.size("double") > 0) & ~F.exists("coarse", lambda r: (r["last"] - r["first"] + 1) > target * 1.5)
    rows = rows.withColumn("ranges", F.when(n <= target, _ranges(F.array().cast("array<int>"), n)).when(coarse_ok, F.col("coarse")).when(F.size("single") > 0, F.col("fine")).otherwise(plain))

    def text(first: Column, last: Column) -> Column:
        width = F.length((last + 1).cast("string"))
        numbered = F.transform(F.slice("lines", first + 1, last - first + 1), lambda line, i: F.concat(F.call_function("lpad", (first + 1 + i).cast("string"), width, F.lit(" ")), F.lit(" | "), line))
        return F.concat(F.lit("// File: "), "id", F.lit("\n"), F.array_join(numbered, "\n"))

    def one(r: Column, i: Column) -> Column:
        before = F.get("ranges", i - 1)
        first = r["first"] if sizes.overlap_lines <= 0 else F.when(i > 0, F.least(r["first"], F.greatest(before["last"] - sizes.overlap_lines + 1, before["first"]))).otherwise(r["first"])
        return chunk(text(first, r["last"]), first=first + 1, last=r["last"] + 1, lang=language(F.col("id")))

    return rows.withColumn("chunks", F.transform("ranges", one))


# web pages


_SECTIONS = T.ArrayType(T.StructType().add("heading", T.StringType()).add("level", T.IntegerType()).add("content", T.StringType()))
PAGE = T.StructType().add("title", T.StringType()).add("sections", _SECTIONS)


@F.pandas_udf(PAGE)
def page_sections(pages: pd.Series) -> pd.DataFrame:
    """Title and sections of the main content."""
    found = [html_reader.sections(p or "") for p in pages]
    return pd.DataFrame({"title": [t for t, _ in found], "sections": [[{"heading": h, "level": n, "content": c} for h, n, c in s] for _, s in found]})


def html(items: DataFrame, sizes: Sizes) -> DataFrame:
    rows = items.withColumn("page", page_sections("content"))
    sections, target = F.col("page.sections"), sizes.target
    title = F.coalesce(F.nullif("page.title", F.lit("")), F.substring_index("id", "/", -1))
    part = "struct<content: string, section: int>"

    def out(s: Column) -> Column:
        return F.when(filled(s["now"]["content"]), F.array_append(s["done"], s["now"])).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        now = s["now"]["content"]
        some = now != ""
        longer = F.concat(now, F.when(some, "\n\n").otherwise(""), x["content"])
        new = some & ((F.length(longer) > target) | x["heading"].isNotNull())
        fresh = F.struct(x["content"].alias("content"), s["i"].alias("section")).cast(part)
        return F.struct(F.when(new, out(s)).otherwise(s["done"]).alias("done"), F.when(new | ~some, fresh).otherwise(F.struct(longer.alias("content"), s["now"]["section"].alias("section")).cast(part)).alias("now"), (s["i"] + 1).alias("i"))

    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.struct(F.lit("").alias("content"), F.lit(0).alias("section")).cast(part).alias("now"), F.lit(0).alias("i"))
    rows = rows.withColumn("joined", F.aggregate(sections, start, step, out)).withColumn("texts", F.transform("joined", lambda p: p["content"])).withColumn("texts", overlapped(F.col("texts"), sizes.overlap, "\n\n"))

    def lines(t: Column) -> Column:
        return F.when((F.length(t) <= target) | ~F.contains(t, F.lit("\n")), F.array(t)).otherwise(merged(F.split(t, "\n"), target, "\n"))

    def sized(t: Column) -> Column:
        paragraphs = F.split(t, "\n\n+")
        return F.when(F.length(t) <= target, F.array(t)).when(F.size(paragraphs) > 1, F.flatten(F.transform(merged(paragraphs, target, "\n\n"), lines))).otherwise(lines(t))

    stack = "array<struct<level: int, text: string>>"
    heads = lambda k: F.filter(F.slice(sections, F.lit(1), k + 1), lambda x: F.coalesce(x["heading"], F.lit("")) != "")
    climb = lambda s, h: F.array_append(F.filter(s, lambda x: x["level"] < h["level"]), F.struct(h["level"].alias("level"), h["heading"].alias("text")))
    path = lambda k: F.transform(F.aggregate(heads(k), F.array().cast(stack), climb), lambda x: x["text"])
    return rows.withColumn("chunks", F.flatten(F.zip_with("texts", "joined", lambda t, p: F.transform(sized(t), lambda x: chunk(x, title, path(p["section"]))))))


CHUNKERS: dict[str, Callable[[DataFrame, Sizes], DataFrame]] = {
    "markdown": markdown, "code": code, "raw-text": raw_text, "html": html, "document": document, "slack": qa, "discord": qa, "qa": qa, "notion": markdown,
}


def register(kind: str, chunker: Callable[[DataFrame, Sizes], DataFrame]) -> None:
    """Add a chunker: a function of items (id, content) and sizes that adds the column chunks, an array of CHUNK."""
    CHUNKERS[kind] = chunker


def chunked(items: DataFrame, kind: str, sizes: Sizes = Sizes()) -> DataFrame:
    """id, chunk_index and the fields of CHUNK, for items with id and content."""
    if kind not in CHUNKERS:
        raise ValueError(f"no chunker for {kind}; there are {', '.join(sorted(CHUNKERS))}")
    rows = CHUNKERS[kind](items.select("id", "content").where(filled(F.col("content"))), sizes)
    # of the inner form the optimizer would derive a filter on the array's size, and evaluate all the stages in it again
    return rows.select("id", F.posexplode_outer("chunks").alias("chunk_index", "c")).where("c IS NOT NULL").select("id", "chunk_index", "c.*")
