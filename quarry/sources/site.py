"""Whole sites as tables of pages: what robots rules, sitemaps and links lead to, site by site, in rounds.

Sites (site, url) are crawled side by side; requests to one site go one after another, in order, with pauses. A site is read by the first of these that names
pages: its sitemap.xml (a list or an index of further maps), its sitemap_index.xml, the maps that robots.txt names; else by links, breadth first. Each round
is written to the shared folder, so what was fetched is not fetched again when an executor is lost later.

A client is a function of a url to (status, content type, body, seconds to wait or None). It runs on executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import written
from quarry.sources import crawl
from quarry.sources.crawl import MAX_DEPTH, MAX_PAGES

Client = Callable[[str], tuple[int, str, str, float | None]]
#: Fixed defaults: seconds between two requests to a site, repeated tries of one; and how deep maps may name maps.
PAUSE, RETRIES, MAP_LEVELS = 0.5, 3, 3
_GOT = "site string, url string, place long, status int, kind string, body string"
_HTML = "status BETWEEN 200 AND 299 AND (contains(kind, 'text/html') OR contains(kind, 'application/xhtml'))"


def fetched(urls: DataFrame, client: Client, pause: float = PAUSE, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """urls (site, url, place) with status, kind and body. A site's requests are in one task, in order of place. A status of 429 or of 500 and more is tried
    again, after the time asked for or growing pauses; a lost connection too, and is a status of 0 in the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for row in batch.itertuples():
                for attempt in range(retries + 1):
                    if row.site in last and (wait := last[row.site] + pause - clock()) > 0:
                        sleep(wait)
                    last[row.site] = clock()
                    try:
                        status, kind, body, asked = client(row.url)
                    except ConnectionError:
                        status, kind, body, asked = 0, "", "", None
                    if attempt == retries or not (status in (0, 429) or status >= 500):
                        break
                    sleep(min(300.0, asked if asked and asked > 0 else 2.0**attempt))
                out.append((row.site, row.url, row.place, status, (kind or "").lower(), body))
            yield pd.DataFrame(out, columns=["site", "url", "place", "status", "kind", "body"])

    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(urls.select("site", "url", "place").repartition(n, "site").sortWithinPartitions("site", "place").mapInPandas(run, _GOT), "fetched")


def normal(url: Column) -> Column:
    """A url without a slash at its end."""
    return F.regexp_replace(url, "/$", "")


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/]+)", 1)


def _first(rows: DataFrame) -> DataFrame:
    """Of rows of a site with the same url but for its end, the first by place."""
    rank = F.row_number().over(Window.partitionBy("site", normal(F.col("url"))).orderBy("place"))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(*order)).cast("long"))


def mapped(maps: DataFrame, client: Client, levels: int = MAP_LEVELS, only_index: bool = False, **pacing: object) -> DataFrame:
    """The pages that sitemaps (site, url, place) name, in their order: site, url, place, indexed (by a map of maps). Maps that name maps are followed to so many levels."""
    spark, found, path = maps.sparkSession, None, maps.withColumn("path", F.array("place"))
    for level in range(levels + 1):
        if path.isEmpty():
            break
        got = fetched(path, client, **pacing).where("status BETWEEN 200 AND 299").join(path.select("site", "url", "path").dropDuplicates(["site", "url"]), ["site", "url"])
        got = got.withColumn("maps", crawl.sitemap_index(F.col("body"))).withColumn("pages", crawl.sitemap_urls(F.col("body")))
        if not (only_index and level == 0):
            pages = got.where(F.size("maps") == 0).select("site", "path", F.posexplode("pages").alias("k", "url")).select("site", "url", F.concat("path", F.array(F.col("k").cast("long"))).alias("path"), F.lit(level > 0).alias("indexed"))
            found = pages if found is None else found.unionByName(pages)
        path = _numbered(got.select("site", "path", F.posexplode("maps").alias("k", "url")).select("site", "url", F.concat("path", F.array(F.col("k").cast("long"))).alias("path")), "path").dropDuplicates(["site", "url"])
    if found is None:
        return spark.createDataFrame([], "site string, url string, place long, indexed boolean")
    return _numbered(found, "path").drop("path")


@dataclass(frozen=True)
class Crawled:
    """pages: site, url, html, depth, place (order within the site), method. failed: site, url, status, reason."""

    pages: DataFrame
    failed: DataFrame


def crawled(sites: DataFrame, client: Client, depth: int = MAX_DEPTH, most: int = MAX_PAGES, **pacing: object) -> Crawled:
    """The pages of sites (site, url), at most so many of each. Urls that robots.txt keeps all agents from are left out. Answers that are no HTML count as nothing; 401 and 403 fail as
    auth-required, others but 404 as fetch-error. Two urls that differ by a slash at the end are one. A site without pages has no rows."""
    sites = written(sites.select("site", "url").dropDuplicates(["site"]), "sites")
    special = lambda path: sites.select("site", F.concat(_origin(F.col("url")), F.lit(path)).alias("url"), F.lit(1).cast("long").alias("place"))
    robots = fetched(special("/robots.txt"), client, **pacing).where("status BETWEEN 200 AND 299").select("site", crawl.robots_disallowed(F.col("body")).alias("disallowed"), crawl.robots_sitemaps(F.col("body")).alias("maps"))
    robots = written(robots, "robots")

    def permitted(rows: DataFrame) -> DataFrame:
        return rows.join(robots.select("site", "disallowed"), "site", "left").where(crawl.allowed(F.col("url"), F.col("disallowed"))).drop("disallowed")

    listed, left = [], sites
    for maps, method, only_index in (
        (special("/sitemap.xml"), "sitemap", False), (special("/sitemap_index.xml"), "sitemap-index", True),
        (robots.select("site", F.posexplode("maps").alias("place", "url")).select("site", "url", F.col("place").cast("long")), "robots-sitemap", False),
    ):
        found = written(mapped(maps.join(left, "site", "left_semi"), client, only_index=only_index, **pacing), "listed")
        name = F.when(F.col("indexed") & F.lit(method == "sitemap"), "sitemap-index").otherwise(method)
        by = found.groupBy("site").agg(F.max(name).alias("method"))
        listed.append(found.where(F.col("place") <= most).select("site", "url", "place").join(by, "site"))
        left = left.join(by, "site", "left_anti")
    mapped_pages = listed[0].unionByName(listed[1]).unionByName(listed[2])
    got = fetched(permitted(_first(mapped_pages)), client, **pacing)
    methods = mapped_pages.select("site", "method").distinct()
    pages = [got.where(_HTML).join(methods, "site").select("site", "url", F.col("body").alias("html"), F.lit(0).alias("depth"), "place", "method")]
    answers = [got.select("site", "url", "status")]

    # links: a round for each depth, and more where pages failed and others wait
    frontier = left.select("site", normal(F.col("url")).alias("url"), F.lit(1).cast("long").alias("place"))
    seen, had = None, left.select("site", F.lit(0).cast("long").alias("n"))
    for d in range(depth + 1):
        waiting = _first(permitted(frontier))
        if seen is not None:
            waiting = waiting.join(seen, ["site", "url"], "left_anti")
        waiting, round_pages = written(_numbered(waiting, "place"), "waiting"), None
        while True:
            room = waiting.join(had, "site").withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("place"))).where(F.col("k") <= most - F.col("n")).select("site", "url", "place")
            if room.isEmpty():
                break
            got = fetched(room, client, **pacing)
            answers.append(got.select("site", "url", "status"))
            tried = got.select("site", "url")
            seen = tried if seen is None else seen.unionByName(tried)
            html = got.where(_HTML).select("site", "url", F.col("body").alias("html"), F.lit(d).alias("depth"), F.col("place") + d * (1 << 32), F.lit("crawl").alias("method")).toDF("site", "url", "html", "depth", "place", "method")
            round_pages = html if round_pages is None else round_pages.unionByName(html)
            had = written(had.unionByName(html.groupBy("site").agg(F.count("*").alias("n"))).groupBy("site").agg(F.sum("n").alias("n")), "had")
            waiting = written(waiting.join(tried, ["site", "url"], "left_anti"), "waiting")
        if round_pages is None:
            break
        pages.append(round_pages)
        linked = round_pages.select("site", F.col("place").alias("parent"), F.posexplode(crawl.links("html", "url")).alias("k", "url"))
        frontier = _numbered(linked.select("site", normal(F.col("url")).alias("url"), "parent", "k"), "parent", "k").select("site", "url", "place")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    reason = F.when(F.col("status").isin(401, 403), "auth-required").otherwise("fetch-error")
    failed = union(answers).where("status NOT BETWEEN 200 AND 299 AND status != 404").select("site", "url", "status", reason.alias("reason"))
    return Crawled(_numbered(union(pages), "place"), failed)
