"""A site of eight pages from HTML to reports, against values worked out by hand."""

from pyspark.sql import functions as F

from crawlweft.functions import robots
from crawlweft.site import Site
from crawlweft.sources.pages import crawl_tables, sitemap_urls

ROOT = "https://site.example"


def page(title, h1, links=(), head="", body=""):
    return f"<!DOCTYPE html><html lang='en'><head><title>{title}</title>{head}</head><body><h1>{h1}</h1>{''.join(f'<a href="{x}">{x}</a>' for x in links)}{body}</body></html>"


PAGES = [
    ("/", 0, page("Test Site Home", "Welcome to Test Site", ("/about", "/products", "/blog", "/contact"), f'<meta name="description" content="A small site"><link rel="canonical" href="{ROOT}/">')),
    ("/about", 1, page("About Us", "About Us", ("/",), '<meta name="description" content="Who we are">')), ("/products", 1, page("Our Products", "Products", ("/products/1", "/products/2", "/products/3"))),
    *((f"/products/{k}", 2, page(f"Product {k}", f"Product {k}", ("/products",), "", f'<img src="/i/{k}.png" alt="Product {k}"><script src="/a.js" async></script>')) for k in (1, 2, 3)),
    ("/blog", 1, page("Blog", "Blog", ("/blog/post-1", "/blog/post-2"), "", "<h2>One</h2><h2>Two</h2>")), ("/contact", 1, page("Contact Us", "Contact")),
]
SITEMAP = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{ROOT}{p}</loc><lastmod>2024-01-0{k}</lastmod></url>" for k, p in enumerate(("/", "/about", "/products", "/contact"), 1)) + "</urlset>"


def site(spark):
    rows = [(k, ROOT + p, h, 200, d, p in ("/", "/about", "/products", "/contact")) for k, (p, d, h) in enumerate(PAGES)] + [(8 + k, f"{ROOT}/blog/post-{k}", None, 404, 2, False) for k in (1, 2)]
    tables = crawl_tables(spark.createDataFrame(rows, "id long, url string, html string, status_code int, depth int, in_sitemap boolean"))
    files = spark.createDataFrame([(f"{ROOT}/sitemap.xml", 200, SITEMAP)], "url string, status_code int, body string")
    empty = {"redirect_chains": "id long, start_url string, final_url string, length int, has_loop boolean", "pagespeed": "url_id long, url string, score int, lcp_ms double, cls double, inp_ms double, fcp_ms double, ttfb_ms double"}
    return Site(spark, tables | {"sitemap_urls": sitemap_urls(files, tables["urls"])} | {n: spark.createDataFrame([], s) for n, s in empty.items()})


def test_eight_pages(spark):
    s = site(spark)
    paths = lambda df: sorted(r.url.removeprefix(ROOT) for r in df.collect())
    products = [f"/products/{k}" for k in (1, 2, 3)]
    assert paths(s.analyze("meta_description").where("status = 'Missing'")) == sorted(["/products", *products, "/blog", "/contact"])
    assert paths(s.analyze("canonicals").where("status = 'Missing'")) == sorted(["/about", "/products", *products, "/blog", "/contact"]) and paths(s.analyze("canonicals", "self")) == ["/"]
    assert s.analyze("page_titles", "too_short").count() == 8 and s.analyze("h1").where("status in ('Missing', 'Multiple')").count() == 0 and paths(s.analyze("h2").where("status = 'OK'")) == ["/blog"]
    assert s.analyze("images").count() == 3 and s.analyze("images").where("alt = ''").count() == 0 and s.analyze("content", "thin").count() == 8
    assert s.run("S04_all_links").count() == 13 and sorted(r.to_url.removeprefix(ROOT) for r in s.run("R16_broken_links").collect()) == ["/blog/post-1", "/blog/post-2"]
    assert paths(s.analyze("links_summary").where("internal = 0 and is_internal and url not like '%post%'")) == ["/contact"]
    assert paths(s.analyze("sitemaps", "crawl_only")) == sorted([*products, "/blog", "/blog/post-1", "/blog/post-2"]) and s.analyze("sitemaps", "sitemap_only").count() == 0
    assert sorted((r.d, r.url.removeprefix(ROOT)) for r in s.run("N02_bfs_subgraph").collect()) == sorted([(0, "/"), *((1, p) for p in ("/about", "/products", "/blog", "/contact")), *((2, p) for p in (*products, "/blog/post-1", "/blog/post-2"))])
    found = {(r.url.removeprefix(ROOT), r.issue_code) for r in s.run("J13_issue_urls").collect()}
    assert {("/blog", "broken_link"), ("/blog/post-1", "client_error"), ("/contact", "missing_meta_description"), ("/products/1", "mobile_missing_viewport")} <= found and not any(c in ("missing_h1", "missing_alt", "render_blocking_script") for _, c in found)
    assert {r.url.removeprefix(ROOT): r.is_async for r in s.analyze("javascript").select("url", "is_async").distinct().collect()} == {"/a.js": True}
    rules = spark.createDataFrame([("h", *r) for r in robots.rules_of("User-agent: *\nDisallow: /private/\nSitemap: x")], "host string, agent string, kind string, rule string, pattern string")
    checked = robots.allowed(spark.createDataFrame([("h", p) for p in ("/private/x", *(p for p, *_ in PAGES))], "host string, path string"), robots.for_agent(rules, "any"))
    assert [r.path for r in checked.where(~F.col("allowed")).collect()] == ["/private/x"]
