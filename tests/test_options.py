"""User options, speed answers and headers on small rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlweft.functions.speed import header, headers_of, psi_metrics
from crawlweft.operators.options import PRESETS, CrawlOptions, GraphFilter, SegmentRule, Segments, crawlable, graph_edges, graph_nodes, pending
from crawlweft.operators.sinks import csv_file
from crawlweft.site import Site
from crawlweft.sources.pages import crawl_tables
from crawlweft.sources.store import TABLES

ROOT = "http://a.e"


def test_options_are_checked_kept_and_copied():
    o = CrawlOptions(concurrency=0, max_retries=-2, timeout_s=0, include=["^http"])
    assert (o.concurrency, o.max_retries, o.timeout_s, o.include) == (1, 0, 1.0, ("^http",))
    assert CrawlOptions.from_json(o.to_json()) == o and o.but(max_depth=3).max_depth == 3 and o.max_depth == 0
    assert PRESETS["polite"].respect_nofollow and PRESETS["fast"].requests_per_second == 50 and set(PRESETS) == {"fast", "polite", "rendering", "audit"}
    for wrong in (lambda: CrawlOptions(include=["("]), lambda: CrawlOptions(exclude=["["]), lambda: CrawlOptions(redirect_policy="x"), lambda: CrawlOptions.from_json('{"speed": 1}'), lambda: SegmentRule("a", "("), lambda: GraphFilter(status=(5, 1)), lambda: GraphFilter(max_nodes=-1)):
        with pytest.raises(ValueError):
            wrong()


def test_addresses_and_work_lists(spark):
    paths = ["/a", "/a.PDF", "/b?x=1&y=2", "/a/skip", "/c.html", "/d.js?x", "/pdf"]
    urls = spark.createDataFrame([(k, ROOT + p, k % 3) for k, p in enumerate(paths)], "id long, url string, depth int")
    left = lambda **o: [r.url.removeprefix(ROOT) for r in crawlable(urls, CrawlOptions(**o)).orderBy("id").collect()]
    assert left() == ["/a", "/b?x=1&y=2", "/a/skip", "/c.html", "/pdf"] and left(exclude_extensions=()) == paths
    assert left(include=["e/a", "e/c"], exclude=["skip"]) == ["/a", "/c.html"] and left(max_query_params=1) == ["/a", "/a/skip", "/c.html", "/pdf"] and left(max_depth=1) == ["/a", "/a/skip", "/c.html", "/pdf"]
    work = urls.selectExpr("*", "'pending' crawl_status", "id <> 3 is_internal")
    assert [r.id for r in pending(work, 3).collect()] == [0, 6, 1]
    with pytest.raises(ValueError):
        pending(work, 0)


def test_graphs_and_segments(spark):
    pages = spark.createDataFrame([(1, "http://x/blog", 0, True, 200, "text/html", True, 10, 5), (2, "http://x/p", 1, True, 404, "text/html", False, None, None), (3, "http://x/q", 2, True, None, None, None, None, None), (4, "http://y/", 1, False, 200, "text/html", True, 1, 1)], "url_id long, url string, depth int, is_internal boolean, status_code int, content_type string, is_indexable boolean, response_time_ms long, word_count int")
    links = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 1), (1, 3), (4, 1), (1, None)], "from_url_id long, to_url_id long")
    ids = lambda **o: [r.url_id for r in graph_nodes(pages, links, GraphFilter(**o)).orderBy("url_id").collect()]
    assert ids() == [1, 2, 3] and ids(internal_only=False) == [1, 2, 3, 4] and ids(status=(200, 299)) == [1, 3] and ids(content_types=("text/plain",)) == [3] and ids(indexable_only=True) == [1] and ids(min_in_links=2) == [1, 2] and ids(max_depth=1) == [1, 2] and ids(max_nodes=2) == [1, 2]
    assert sorted(map(tuple, graph_edges(graph_nodes(pages, links, GraphFilter()), links).collect())) == [(1, 2, 2), (1, 3, 1), (2, 1, 1), (3, 1, 1)]
    got = {r.segment: (r.id, r.n, r.avg_response_ms, r.ok) for r in Segments([SegmentRule("The Blog", "blog"), SegmentRule("All", "x/"), SegmentRule("None", "zzz")]).metrics(pages).collect()}
    assert got == {"The Blog": ("custom_the_blog", 1, 10.0, 1), "All": ("custom_all", 2, 0.0, 0), "None": ("custom_none", 0, 0.0, 0), "Other": ("custom_other", 0, 0.0, 0)}


def test_speed_answers(spark):
    whole = '{"lighthouseResult": {"categories": {"performance": {"score": 0.29}}, "audits": {"largest-contentful-paint": {"numericValue": 2450.5}, "cumulative-layout-shift": {"numericValue": 0.1}, "speed-index": {}}}}'
    rows = [(200, whole), (500, whole), (None, whole), (200, None), (200, ""), (200, "{"), (200, "[]"), (200, "{}"), (200, '{"lighthouseResult": null}'), (200, whole.replace("0.29", '"0.29"')), (200, whole.replace("2450.5", "true"))]
    got = [r.m for r in spark.createDataFrame(rows, "s int, b string").coalesce(1).select(psi_metrics(F.col("s"), F.col("b")).alias("m")).collect()]
    assert (got[0].error, got[0].score, got[0].lcp_ms, got[0].cls, got[0].inp_ms, got[0].speed_index) == ("", int(0.29 * 100), 2450.5, 0.1, 0.0, 0.0)
    failed = "Failed to parse response"
    assert [m.error for m in got[1:]] == ["API returned status 500", "API returned status 0", failed, failed, failed, failed, "", "", failed, failed] and got[1].score is None and got[7].score == 0


def test_responses_with_headers(spark, tmp_path):
    rows = [(1, f"{ROOT}/1", None, 301, {"Location": ["/2"]}), (2, f"{ROOT}/2", None, 302, {"location": ["/ignored"], "Location": ["/3"]}), (3, f"{ROOT}/3", "<title>t</title>", 200, {"X-Robots-Tag": ["noindex", "nofollow"], "Content-Type": ["text/html"]}), (4, f"{ROOT}/4", None, 200, None)]
    t = crawl_tables(spark.createDataFrame(rows, "id long, url string, html string, status_code int, headers map<string, array<string>>"))
    assert {(r.start_url, r.final_url, r.length) for r in t["redirect_chains"].collect()} == {(f"{ROOT}/1", f"{ROOT}/3", 2), (f"{ROOT}/2", f"{ROOT}/3", 1)}
    fetches = {r.url_id: r for r in t["fetches"].collect()}
    assert fetches[3].x_robots == "noindex, nofollow" and fetches[3].content_type == "text/html" and fetches[4].x_robots == "" and not t["html_features"].first().is_indexable
    back = t["fetches"].where("url_id = 3").select(headers_of(F.col("headers_json")).alias("h"))
    assert back.first().h == {"X-Robots-Tag": ["noindex", "nofollow"], "Content-Type": ["text/html"]} and back.select(header(F.col("h"), "x-robots-tag")).first()[0] == ""
    stored = {n: set(StructType.fromDDL(TABLES[n][0]).names) for n in t if n in TABLES}
    assert set(stored) >= {"urls", "fetches", "html_features", "links", "resources", "page_resources"} and all(set(t[n].columns) <= names for n, names in stored.items())
    shown = Site(spark, t).shown("response_codes")
    csv_file(shown, f"{tmp_path}/codes.csv")
    assert shown.where("`Redirect URL` <> ''").count() == 2 and "Redirect URL" in (tmp_path / "codes.csv").read_text()
