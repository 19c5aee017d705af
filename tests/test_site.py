"""Crawls of sites that live in a dict, against the order in which a reader would meet their pages."""

import pytest

from quarry.sources import site

LINK = lambda *urls: "<html><body>" + "".join(f'<a href="{u}">x</a>' for u in urls) + "</body></html>"
URLS = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
MAPS = lambda *urls: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"
PAGES = {
    "https://a/sitemap.xml": URLS("https://a/2", "https://a/1", "https://a/1/", "https://a/secret/x", "https://a/file.pdf", "https://a/auth", "https://a/gone"), "https://a/robots.txt": "User-agent: *\nDisallow: /secret",
    "https://a/1": LINK("https://a/3"), "https://a/2": LINK(), "https://a/3": LINK(), "https://a/secret/x": LINK(), "https://a/file.pdf": "pdf",
    "https://b/sitemap.xml": MAPS("https://b/m1.xml", "https://b/m2.xml"), "https://b/m1.xml": URLS("https://b/x"), "https://b/m2.xml": MAPS("https://b/m3.xml"), "https://b/m3.xml": URLS("https://b/y"), "https://b/x": LINK(), "https://b/y": LINK(),
    "https://c/sitemap_index.xml": MAPS("https://c/m.xml"), "https://c/m.xml": URLS("https://c/p"), "https://c/p": LINK(),
    "https://d/robots.txt": "Sitemap: https://d/far.xml", "https://d/far.xml": URLS("https://d/q"), "https://d/q": LINK(),
    "https://e": LINK("https://e/1", "https://e/2/", "https://e/private/z", "https://other/"), "https://e/1": LINK("https://e/3", "https://e/2", "https://e/dead"), "https://e/2": LINK("https://e/4"), "https://e/3": LINK("https://e/5"), "https://e/4": LINK(), "https://e/5": LINK("https://e/6"), "https://e/6": LINK(),
    "https://e/robots.txt": "User-agent: *\nDisallow: /private", "https://e/private/z": LINK(),
}


def client(url):
    if url == "https://a/auth":
        return 403, "text/html", "", None
    if url == "https://e/dead":
        raise ConnectionError("lost")
    if url not in PAGES:
        return 404, "text/html", "", None
    return 200, "application/pdf" if url.endswith(".pdf") else "text/html; charset=utf-8", PAGES[url], None


@pytest.fixture(scope="module")
def crawled(spark):
    sites = spark.createDataFrame([(s, f"https://{s}/") for s in "abcdefg"], "site string, url string")
    return site.crawled(sites, client, depth=3, pause=0.0, retries=0)


def test_pages_in_order(crawled):
    rows = sorted(crawled.pages.collect(), key=lambda r: (r.site, r.place))
    got = {s: [r.url for r in rows if r.site == s] for s in "abcdefg"}
    assert got == {
        "a": ["https://a/2", "https://a/1"], "b": ["https://b/x", "https://b/y"], "c": ["https://c/p"], "d": ["https://d/q"],
        "e": ["https://e", "https://e/1", "https://e/2", "https://e/3", "https://e/4", "https://e/5"], "f": [], "g": [],
    }
    assert {(r.site, r.method) for r in rows} == {("a", "sitemap"), ("b", "sitemap-index"), ("c", "sitemap-index"), ("d", "robots-sitemap"), ("e", "crawl")}
    assert {r.url: r.depth for r in rows if r.site == "e"} == {"https://e": 0, "https://e/1": 1, "https://e/2": 1, "https://e/3": 2, "https://e/4": 2, "https://e/5": 3}


def test_failures(crawled):
    assert sorted((r.url, r.status, r.reason) for r in crawled.failed.collect()) == [("https://a/auth", 403, "auth-required"), ("https://e/dead", 0, "fetch-error")]


def test_page_limit(spark):
    got = site.crawled(spark.createDataFrame([("e", "https://e"), ("a", "https://a")], "site string, url string"), client, most=3, pause=0.0, retries=0).pages.collect()
    assert sorted(r.url for r in got) == ["https://a/1", "https://a/2", "https://e", "https://e/1", "https://e/2"]


def test_retries_and_pauses(spark):
    def flaky(url):
        import os

        seen = os.environ.get("TRIED" + url[-1], "")
        os.environ["TRIED" + url[-1]] = seen + "x"
        return (503, "", "", None) if len(seen) < 2 else (200, "text/html", seen, None)

    def sleep(seconds):
        import os

        os.environ["SLEPT"] = os.environ.get("SLEPT", "") + f"{seconds:g} "

    def told(url):
        import os

        return 200, "text/html", os.environ.get("SLEPT", ""), None

    urls = spark.createDataFrame([("s", "https://s/1", 1)], "site string, url string, place long")
    got = site.fetched(urls, flaky, pause=0.0, sleep=sleep).collect()
    assert [(r.status, r.body) for r in got] == [(200, "xx")]
    assert [r.status for r in site.fetched(urls, lambda u: (500, "", "", 1.0), pause=0.0, retries=1, sleep=lambda s: None).collect()] == [500]


def test_no_sites(spark):
    got = site.crawled(spark.createDataFrame([], "site string, url string"), client, pause=0.0)
    assert got.pages.collect() == got.failed.collect() == []
