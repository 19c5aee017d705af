"""Workspace pages as items: discovery, blocks as markdown, properties as text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The line of a block by its type, from its text t, the indentation i and the block's own values.
LINES = {
    "paragraph": "{i}{t}",
    "heading_1": "# {t}",
    "heading_2": "## {t}",
    "heading_3": "### {t}",
    "bulleted_list_item": "{i}- {t}",
    "numbered_list_item": "{i}1. {t}",
    "to_do": "{i}- [{done}] {t}",
    "toggle": "{i}**{t}**",
    "quote": "{i}> {t}",
    "callout": "{i}> **{icon}** {t}",
    "code": "{i}```{language}\n{t}\n```",
    "divider": "{i}---",
    "image": "{i}![{caption}]({url})",
    "bookmark": "{i}[{label}]({url})",
    "equation": "{i}$${expression}$$",
    "child_page": "{i}[Page: {title}]",
    "child_database": "{i}[Database: {title}]",
    "table_row": "| {cells} |",
}
LIST_ITEMS = ("bulleted_list_item", "numbered_list_item")


def rich_text(parts: list[dict] | None) -> str:
    out = []
    for p in parts or []:
        text, href = p.get("plain_text") or "", p.get("href")
        out.append(f"[{text}]({href})" if href else text)
    return "".join(out)


def block_lines(block: dict, indent: str = "") -> list[str]:
    """Markdown of a block and of the blocks in it. Blocks in list items are indented; those of types without a line only give what is in them."""
    kind = block.get("type", "")
    own = block.get(kind) or {}
    icon, place = own.get("icon") or {}, own.get("external") or own.get("file") or {}
    values = {
        "i": indent, "t": rich_text(own.get("rich_text")), "done": "x" if own.get("checked") else " ", "language": own.get("language") or "", "expression": own.get("expression") or "", "title": own.get("title") or "",
        "icon": icon.get("emoji") or (icon.get("external") or {}).get("url") or "", "caption": rich_text(own.get("caption")), "url": own.get("url") or place.get("url") or "",
        "label": rich_text(own.get("caption")) if "caption" in own and own["caption"] is not None else own.get("url") or "", "cells": " | ".join(rich_text(c) for c in own.get("cells") or []),
    }
    lines = [LINES[kind].format(**values)] if kind in LINES else []
    inner = [line for b in block.get("children") or [] for line in block_lines(b, indent + "  " if kind in LIST_ITEMS else indent)]
    if kind == "table" and inner and own.get("has_column_header"):
        inner.insert(1, "| " + " | ".join(["---"] * (own.get("table_width") or 2)) + " |")
    return lines + inner


@F.pandas_udf(T.StringType())
def markdown_of(blocks: pd.Series) -> pd.Series:
    """Markdown of a page's blocks, given as a JSON list."""
    return blocks.map(lambda b: "\n".join(line for x in json.loads(b or "[]") for line in block_lines(x)))


def property_text(p: Column) -> Column:
    """The text of a property, given as JSON; null for types that have none."""
    get = lambda path: F.get_json_object(p, path)
    rich = lambda path: F.array_join(F.transform(F.from_json(get(path), "array<struct<plain_text: string>>"), lambda x: x["plain_text"]), "")
    named = lambda path: F.array_join(F.transform(F.from_json(get(path), "array<struct<name: string>>"), lambda x: x["name"]), ", ")
    kinds = {
        "title": rich("$.title"), "rich_text": rich("$.rich_text"), "number": get("$.number"), "select": get("$.select.name"), "status": get("$.status.name"), "multi_select": named("$.multi_select"), "people": named("$.people"), "files": named("$.files"),
        "date": F.concat(get("$.date.start"), F.coalesce(F.concat(F.lit(" → "), get("$.date.end")), F.lit(""))), "checkbox": get("$.checkbox"), "url": get("$.url"), "email": get("$.email"), "phone_number": get("$.phone_number"),
        "created_time": get("$.created_time"), "last_edited_time": get("$.last_edited_time"),
    }
    out = F.lit(None).cast("string")
    for kind, value in kinds.items():
        out = F.when(get("$.type") == kind, value).otherwise(out)
    return F.nullif(out, F.lit(""))


def discovered(search: DataFrame, roots: list[str], databases: list[str]) -> DataFrame:
    """Pages to take: all, or the roots and the entries of the databases; a page found twice is taken once, as listed last where there is a column place, else as last edited."""
    rows = search if not roots and not databases else search.where(F.col("id").isin(roots) | (F.col("parent_id").isin(databases) & (F.col("parent_type") == "database_id")))
    return rows.groupBy("id").agg(F.max_by(F.struct(*search.columns), "place" if "place" in search.columns else "last_edited").alias("r")).select("r.*")


def page_items(pages: DataFrame) -> DataFrame:
    """Items of pages with title, blocks (JSON), frontmatter (map, may be null), parent_type, parent_id and url."""
    body = markdown_of("blocks")
    front = F.concat(F.lit("---\n"), F.array_join(F.transform(F.array_sort(F.map_entries("frontmatter")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.lit("\n---\n\n"))
    content = F.concat(F.when(F.col("frontmatter").isNotNull() & (F.col("parent_type") == "database_id"), front).otherwise(""), F.when(F.col("body").rlike(r"\S"), F.col("body")).otherwise(F.concat(F.lit("# "), "title")))
    return pages.withColumn("body", body).select("id", content.alias("content"), "title", F.col("url").alias("source_url"), F.to_json(F.struct(F.regexp_replace("parent_type", "_id$", "").alias("parentType"), F.col("parent_id").alias("parentId"))).alias("metadata"))


def edited_since(pages: DataFrame, token: str | None) -> DataFrame:
    return pages if token is None else pages.where(F.col("last_edited") > token)


def token(pages: DataFrame) -> DataFrame:
    return pages.agg(F.max("last_edited").alias("token"))
