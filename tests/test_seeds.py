"""Seeds of a crawl."""

from crawlweft.sources.seeds import list_seeds, sitemap_seeds

R = "https://r.e/"


def index(*names):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{R}{n}</loc></sitemap>" for n in names) + "</sitemapindex>"


def pages(*names):
    return "<urlset>" + "".join(f"<url><loc>{R}{n}</loc><lastmod>2024-01-0{k}</lastmod></url>" for k, n in enumerate(names, 1)) + "</urlset>"


def test_an_index_of_indexes_with_a_ring(spark):
    files = [("i", 200, index("j", "k", "gone", "i")), ("j", 200, index("i", "k", "s1", "s3")), ("k", 200, index("j", "s2", "bad", "late")), ("s1", 200, pages("a", "b")), ("s2", 200, pages("b", "c")), ("s3", 404, pages("d")), ("bad", 200, "<urlset><url>"), ("late", 200, index("s4")), ("s4", 200, pages("e")), ("apart", 200, pages("f"))]
    df = spark.createDataFrame([(R + n, s, b) for n, s, b in files], "url string, status_code int, body string")
    got = lambda **o: sorted((r.url.removeprefix(R), r.sitemap.removeprefix(R), r.depth, r.lastmod[-1]) for r in sitemap_seeds(df, [R + "i"], **o).collect())
    assert got() == [("a", "s1", 2, "1"), ("b", "s1", 2, "2"), ("c", "s2", 2, "2"), ("e", "s4", 3, "1")]
    assert got(max_depth=1) == [] and len(got(max_depth=2)) == 3 and sitemap_seeds(df, []).count() == 0 and sitemap_seeds(df.limit(0), [R + "i"]).count() == 0


def test_a_list_takes_each_page_once(spark):
    rows = [(2, "http://E.com/a#x"), (1, " http://e.com/a/ "), (3, ""), (4, None), (5, "http://e.com/b")]
    assert sorted(map(tuple, list_seeds(spark.createDataFrame(rows, "position long, url string")).collect())) == [("http://e.com/a/", "http://e.com/a"), ("http://e.com/b", "http://e.com/b")]
