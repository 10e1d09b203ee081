"""User rules, structured data, robots and sitemaps against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from crawlweft.functions import robots, rules, sitemap, structured
from crawlweft.functions.rules import ExtractionRule, Rules, SearchRule

HTML = """<html><head><title>Shoes</title><style>b{}</style><script>var the = "the";</script>
<script type="application/ld+json">{"@type": "Product", "name": "Boot", "price": 12.0, "big": 1e21, "ok": true, "tags": ["a", 1, "b"], "offers": {"seller": {"name": "S"}}}</script></head>
<body id="top"><h1 class="big head">The <b>Best</b> Shoes</h1><div class="price now">9 EUR</div><img src='a.png' alt='A'><img src="b.png"><a href="/x" rel="nofollow">The link</a><p>other text</p></body></html>"""


def search(spark, *given):
    pages = spark.createDataFrame([(1, "https://s.example/The", HTML, "The Title", None), (2, "u", None, None, None)], "url_id long, url string, html string, title string, meta_description string")
    return {r.url_id: r for r in rules.searched(pages, list(given)).collect()}


def test_searches(spark):
    got = search(
        spark, SearchRule("a", "any case", "text", "THE", "text"), SearchRule("b", "case", "text", "The", "text", True), SearchRule("c", "has", "contains", "best"), SearchRule("d", "re", "regex", "<IMG[^>]*>"), SearchRule("e", "re case", "regex", "<IMG[^>]*>", "html", True),
        SearchRule("f", "id", "css", "#top"), SearchRule("g", "class", "css", ".price"), SearchRule("h", "tag", "css", "img.large"), SearchRule("i", "url", "text", "the", "url"), SearchRule("j", "title", "contains", "title", "title"), SearchRule("k", "meta", "contains", "x", "meta"), SearchRule("l", "aa", "text", "s", "title"),
    )
    one = got[1]
    assert [(r.rule_id, r.match_count, r.first_match) for r in one.rules] == [
        ("a", 3, "the"), ("b", 2, "The"), ("c", 1, "best"), ("d", 2, "<img src='a.png' alt='A'>"), ("e", 0, None), ("f", 1, 'id="top"'), ("g", 1, 'class="price now"'), ("h", 2, "<img src='a.png' alt='A'>"), ("i", 1, "the"), ("j", 1, "title"), ("k", 0, None), ("l", 0, None),
    ]
    assert one.total_matches == 14 and one.rules[0].context == "Shoes The Best Shoes 9 EUR The link other text" and one.rules[3].context.startswith("...") and got[2].total_matches == 0
    long = search(spark, SearchRule("m", "long", "regex", "<script>[^<]*<"), SearchRule("n", "whole", "regex", "(?s)<head>.*</head>"))[1].rules
    assert long[0].first_match == '<script>var the = "the";<' and long[1].first_match.endswith("...") and len(long[1].first_match) == 103


def test_extractions(spark):
    given = [
        ExtractionRule("a", "group", "regex", r"<h1[^>]*>\s*(\w+)", 1), ExtractionRule("b", "no group", "regex", r"<h1[^>]*>", 3), ExtractionRule("c", "class", "css", ".price"), ExtractionRule("d", "tag", "css", "h1"), ExtractionRule("e", "attr", "css", "a[href]"), ExtractionRule("f", "rule attr", "css", "img", 0, "src"),
        ExtractionRule("g", "id", "css", "#top", 0, "id"), ExtractionRule("h", "xattr", "xpath", "//img/@alt"), ExtractionRule("i", "xtext", "xpath", "//h1/text()"), ExtractionRule("j", "xtag", "xpath", "//p"), ExtractionRule("k", "json", "json", "$.price"), ExtractionRule("l", "json2", "json", "offers.seller.name"),
        ExtractionRule("m", "list", "json", "$.tags"), ExtractionRule("n", "star", "json", "$.tags.[*]"), ExtractionRule("o", "at", "json", "$.tags.[2]"), ExtractionRule("p", "in key", "json", "$.tags[0]"), ExtractionRule("q", "bool", "json", "$.ok"), ExtractionRule("r", "big", "json", "$.big"),
    ]
    pages = spark.createDataFrame([(1, "u", HTML), (2, "v", None)], "url_id long, url string, html string")
    got = {(r.url_id, r.rule_id): r.all_values for r in rules.expanded_extractions(pages, given).collect()}
    assert [got[1, r.id] for r in given] == ["The", '<h1 class="big head">', "9 EUR", "The Best Shoes", "/x | /x", "a.png | b.png", "top", "A", "The Best Shoes", "<p>other text</p>", "12", "S", "a | b", "a | b", "b", "", "", "1e+21"]
    assert all(got[2, r.id] == "" for r in given) and rules.extracted(pages, []).first().total_extractions == 0


def test_rule_registry_refuses_what_cannot_run():
    for bad in (lambda: SearchRule("x", "x", "text", ""), lambda: SearchRule("x", "x", "regex", "("), lambda: SearchRule("x", "x", "like", "a"), lambda: ExtractionRule("x", "x", "regex", "[")):
        with pytest.raises((ValueError, Exception)):
            bad()
    r = Rules().add(SearchRule("a", "1", "text", "x")).add(SearchRule("a", "2", "text", "y")).add(ExtractionRule("b", "3", "css", "p"))
    assert [s.name for s in r.search] == ["2"] and not r.remove("a").search and not r.clear().extract


def test_json_ld_items():
    ld = lambda x: f'<script type="application/ld+json"> {x} </script>'
    nested = '{"@graph": [{"@type": "A", "@graph": [{"@type": ["B", 1, "C"]}]}, [{"@type": "D"}]]}'
    got = structured.items(ld(nested) + ld('{"@type": "Article", "author": "x"}') + ld("{") + ld('{"@type": "FAQPage"}') + ld('{"@type": "Product", "name": ""}') + ld('{"@type": ["BreadcrumbList"]}') + ld("[]") + '<p itemscope itemtype="https://schema.org/Offer"><p itemtype="x:y"><p itemtype="http://schema.org/Offer">')
    assert [(i["type"], i["valid"], len(i["errors"]), len(i["warnings"])) for i in got] == [
        ("A, B, C, D", True, 0, 0), ("Article", True, 0, 2), ("Unknown (parse error)", False, 1, 0), ("FAQPage", False, 1, 0), ("Product", True, 0, 1), ("BreadcrumbList", True, 0, 0), ("Unknown", True, 0, 0), ("Offer", True, 0, 0), ("x:y", True, 0, 0),
    ]
    deep = '{"@graph":[' * 300 + '{"@type":"Z"}' + "]}" * 300
    assert structured.items(ld(deep))[0]["type"] == "Z" and structured.items(None) == []


ROBOTS = "User-agent: *\nDisallow: /private/\n\nUser-agent: news\nUser-agent: GoodBot # ours\nDisallow: /a*b$\nAllow: /a/ok\nCrawl-delay: 1.5\nSitemap: https://x/s.xml\nHost: x\nUser-agent: empty\nDisallow:\n"


def test_robots(spark):
    f = robots.file_of(ROBOTS)
    assert f["sitemaps"] == ["https://x/s.xml"] and f["host"] == "x" and [(d["agent"], d["seconds"]) for d in f["delays"]] == [("news", 1.5), ("goodbot", 1.5)]
    files = spark.createDataFrame([("h", ROBOTS), ("none", None)], "host string, body string")
    given = files.select("host", F.explode(robots.parsed_robots("body")["rules"]).alias("r")).select("host", "r.*")
    paths = spark.createDataFrame([("h", p, 1) for p in ("/private/x", "/a1b", "/a1bc", "/a/okb", "", "/private")] + [("h", "/private/x", 1), ("none", "/private/x", 1)], "host string, path string, kept int")
    verdict = lambda agent: sorted((r.host, r.path, r.allowed) for r in robots.allowed(paths, robots.for_agent(given, agent)).collect())
    open_ = lambda *closed: sorted((h, p, (h, p) not in {("h", c) for c in closed}) for h, p, _ in paths.collect())
    assert verdict("goodbot") == open_("/a1b") and verdict("GoodBot/2.1") == open_("/a1b") and verdict("other") == open_("/private/x") and verdict("empty") == open_()


def test_meta_robots_and_headers(spark):
    values = ["none, max-snippet: 5", " NOINDEX ,nosnippet,max-snippet:5,max-image-preview:large,max-video-preview:-1", "noindexed", None, "max-snippet:x,noimageindex,notranslate,noarchive,nofollow"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", robots.meta_robots(F.col("v")).alias("m")).select("i", "m.*")
    assert [tuple(r)[1:] for r in df.orderBy("i").collect()] == [
        (True, True, False, False, False, False, -1, "", -1), (True, False, False, True, False, False, 5, "large", -1), (False,) * 6 + (-1, "", -1), (False,) * 6 + (-1, "", -1), (False, True, True, False, True, True, -1, "", -1),
    ]
    heads = [["noindex", "googlebot: nofollow"], ["bot: none", "noarchive", "nofollow"], ["max-snippet:3", "noindex"], ["other: noindex"], [], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(heads)], "i int, v array<string>").select("i", robots.x_robots(F.col("v"), "GoogleBot").alias("m")).select("i", "m.noindex", "m.nofollow", "m.noarchive", "m.max_snippet")
    assert [tuple(r)[1:] for r in df.orderBy("i").collect()] == [(False, True, False, -1), (True, True, False, -1), (True, False, False, 3), (None,) * 4, (None,) * 4, (None,) * 4]


def test_sitemaps():
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    got = sitemap.parsed(200, f"<urlset {space}><url><loc> https://a/?x=1&amp;y </loc><lastmod>2024-01-02</lastmod><priority>0.5</priority></url><url><loc>b</loc><priority>high</priority></url></urlset>")
    assert got["kind"] == "sitemap" and [tuple(e.values()) for e in got["entries"]] == [("https://a/?x=1&y", "2024-01-02", "", 0.5), ("b", "", "", None)]
    assert sitemap.parsed(200, "<sitemapindex><sitemap><loc>s</loc></sitemap></sitemapindex>")["kind"] == "sitemap_index"
    assert sitemap.parsed(404, "<urlset/>")["error"] == "HTTP 404" and sitemap.parsed(None, "<html/>")["error"] == "Unknown sitemap format" and sitemap.parsed(200, "<urlset><url>")["error"].startswith("XML parse error")
