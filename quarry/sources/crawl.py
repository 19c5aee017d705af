"""Sites as items: sitemaps, robots rules, pages and their links, and a crawl in rounds."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import html

#: Fixed limits of a crawl.
MAX_PAGES, MAX_DEPTH, SPA_TEXT, SPA_SHARE = 500, 3, 100, 0.5


def sitemap_urls(xml: Column) -> Column:
    """The pages of a sitemap, whatever its namespaces."""
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?url\b[^>]*>.*?<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc>"), F.lit(1)), lambda u: F.btrim(u, F.lit(" \t\r\n"))), lambda u: u != "")


def sitemap_index(xml: Column) -> Column:
    """The sitemaps of a sitemap index."""
    return F.filter(F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?sitemap\b[^>]*>.*?<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc>"), F.lit(1)), lambda u: F.btrim(u, F.lit(" \t\r\n"))), lambda u: u != "")


def robots_sitemaps(robots: Column) -> Column:
    return F.transform(F.regexp_extract_all(robots, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), F.btrim)


def robots_disallowed(robots: Column) -> Column:
    """The path prefixes that all agents are kept from."""
    blocks = F.filter(F.split(robots, r"(?im)^(?=\s*user-agent:)"), lambda b: b.rlike(r"(?i)^\s*user-agent:\s*\*\s*(?:#.*)?(?:\r?\n|$)"))
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?im)^\s*disallow:\s*(/\S*)"), F.lit(1))))


def allowed(url: Column, prefixes: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    return ~F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda p: F.when(path == "", "/").otherwise(path).startswith(p))


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    return pages.map(html.visible_text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def links(pages: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series([html.links(p, u or "") for p, u in zip(pages, urls, strict=True)])


@F.pandas_udf(T.StringType())
def content_selector(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: found[0] if (found := html.content_selector(html.parsed(p))) else None)


def looks_scripted(pages: DataFrame) -> DataFrame:
    """Whether most pages have hardly any text, as pages have that scripts fill."""
    return pages.agg(F.coalesce(F.avg((F.length("text") < SPA_TEXT).cast("int")) > SPA_SHARE, F.lit(False)).alias("scripted"))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], robots: Column | None = None, depth: int = MAX_DEPTH, most: int = MAX_PAGES) -> DataFrame:
    """Pages (url, html, depth) reached from seeds (url) in rounds. fetch turns urls into (url, html) on the executors; each round's new urls are
    those of the last round's links that no round has seen."""
    spark = seeds.sparkSession
    pages, seen = None, None
    frontier = seeds.select("url").distinct()
    for d in range(depth + 1):
        if robots is not None:
            frontier = frontier.where(allowed(F.col("url"), robots))
        if seen is not None:
            frontier = frontier.join(seen, "url", "left_anti")
        left = most if pages is None else most - pages.count()
        if left <= 0:
            break
        got = fetch(frontier.orderBy("url").limit(left)).select("url", "html").withColumn("depth", F.lit(d)).persist()
        if got.isEmpty():
            break
        pages = got if pages is None else pages.unionByName(got)
        seen = pages.select("url")
        frontier = got.select(F.explode(links("html", "url")).alias("url")).distinct()
    return spark.createDataFrame([], "url string, html string, depth int") if pages is None else pages


def common_prefix(urls: DataFrame) -> DataFrame:
    """The longest run of first path segments that all urls share; of a single url all but the last segment."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1), "^/|/$", ""), "/"), lambda p: p != "")
    got = urls.select("url").distinct().select(parts.alias("p")).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n"))
    # the least and the greatest of sorted segment lists differ first where any two do
    same = F.aggregate(F.zip_with("low", "high", lambda a, b: F.struct(a.alias("a"), (a.eqNullSafe(b)).alias("ok"))), F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("on")),
                       lambda s, x: F.struct(F.when(s["on"] & x["ok"], F.array_append(s["out"], x["a"])).otherwise(s["out"]).alias("out"), (s["on"] & x["ok"]).alias("on")), lambda s: s["out"])
    return got.select(F.concat(F.lit("/"), F.array_join(F.when(F.col("n") == 1, F.slice("low", F.lit(1), F.greatest(F.size("low") - 1, F.lit(0)))).otherwise(same), "/")).alias("prefix"))


def source_type(urls: DataFrame) -> DataFrame:
    """markdown if most urls end in .md or .mdx, else html."""
    return urls.agg(F.when(F.avg(F.lower("url").rlike(r"\.mdx?$").cast("int")) > 0.5, "markdown").otherwise("html").alias("type"))


def server_name(url: str) -> str:
    """A short name of a site by its host."""
    import re

    host = re.sub(r"^(?:www|docs|doc|developer|developers|api|help|learn)\.", "", re.sub(r"^[a-z]+://|[/:?#].*$", "", url.lower()))
    return re.sub(r"[^a-z0-9]+", "-", host.rsplit(".", 1)[0] if "." in host else host).strip("-") or "site"


def repository_of(url: str) -> str | None:
    """The clone url that a page of a code host belongs to."""
    import re

    m = re.match(r"^(?:https?://|git@)(github\.com|gitlab\.com)[/:]([^/]+)/([^/#?]+)", url)
    return f"https://{m[1]}/{m[2]}/{m[3].removesuffix('.git')}.git" if m else None


def generated_config(pages: DataFrame, url: str) -> dict:
    """A configuration for a crawled site (pages: url, html): its kind of source, the prefix and the content selector that most pages share, and a search tool."""
    kind, prefix = source_type(pages).first().type, common_prefix(pages).first().prefix
    selector = pages.select(content_selector("html").alias("s")).where("s IS NOT NULL").groupBy("s").count().orderBy(F.desc("count"), "s").first()
    name = server_name(url)
    source = {"name": "docs", "type": kind, "path": prefix, "base_url": url} | ({"content_selector": selector.s} if selector else {})
    return {"server": {"name": name}, "sources": [source], "tools": [{"name": "search-docs", "type": "search", "source": "docs"}], "embedding": {"provider": "local"}, "indexing": {"auto_reindex": True}}
