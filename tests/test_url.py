"""URL normalisation of both engines against a plain port of the reference's rules."""

import re
from urllib.parse import quote, quote_plus, unquote, unquote_plus

import duckdb
import pytest

import __spark_entry__ as entry
from crawlweft.functions.url import IGNORED, normalized, normalized_by_steps
from crawlweft.plans import BASE, spelled
from crawlweft.site import Site

URLS = [
    ("http://Example.COM:80/a/b/#top", "http://example.com/a/b"), ("HTTPS://example.com:443", "https://example.com/"), ("https://example.com:80/", "https://example.com:80/"),
    ("http://e.com/a//b///c/./d/../e", "http://e.com/a/b/c/e"), ("http://e.com/a/../../b", "http://e.com/b"), ("http://e.com/a/..", "http://e.com/"), ("http://e.com/a//", "http://e.com/a/"),
    ("http://e.com/Path/Case", "http://e.com/Path/Case"), ("http://e.com/p?b=2&a=3&a=1&UTM_Source=x&ref=y", "http://e.com/p?a=1&a=3&b=2"), ("http://e.com/p?utm_source=feed", "http://e.com/p"),
    ("http://e.com/p?k=&k=1&z=", "http://e.com/p?k=1&z"), ("http://e.com/p?a+b=c%20d&q=%7E*", "http://e.com/p?a+b=c+d&q=~%2A"), ("http://e.com/p?bad=%zz&x;y=1&ok=1&&=v", "http://e.com/p?=v&ok=1"),
    ("http://e.com/p?", "http://e.com/p?"), ("http://e.com/é/x", "http://e.com/%C3%A9/x"), ("http://e.com/a%2Fb", "http://e.com/a%2Fb"), ("http://e.com/a!b/", "http://e.com/a%21b"), ("http://e.com/a!b'(c)", "http://e.com/a!b'(c)"),
    ("http://e.com/a b", "http://e.com/a%20b"), ("http://e.com/a+b%41", "http://e.com/a+b%41"), ("http://User:Pw@E.com/x", "http://User:Pw@e.com/x"), ("  http://e.com/x\n", "http://e.com/x"),
    ("mailto:Me@E.com", "mailto:Me@E.com"), ("/only/path/", "/only/path"), ("//e.com/x/", "//e.com/x"), ("http://e.com/%zz", "http://e.com/%zz"), ("http://e.com/" + "x/../" * 40 + "y", "http://e.com/y"), (None, None),
]


@pytest.mark.parametrize("engine", ["spark", "duckdb"])
def test_normal_forms(spark, engine):
    sql = spelled((normalized if engine == "spark" else normalized_by_steps)("SELECT id, url FROM addresses"), engine == "spark")
    rows = [(i, u) for i, (u, _) in enumerate(URLS)]
    if engine == "spark":
        spark.createDataFrame(rows, "id long, url string").createOrReplaceTempView("addresses")
        got = {r.id: r.normalized_url for r in spark.sql(sql).collect()}
    else:
        c = duckdb.connect()
        c.execute("CREATE TABLE addresses (id bigint, url varchar)")
        c.executemany("INSERT INTO addresses VALUES (?, ?)", rows)
        got = dict(c.sql(f"SELECT id, normalized_url FROM ({sql})").fetchall())
    assert [(u, got[i]) for i, (u, _) in enumerate(URLS)] == URLS


def plain(url):
    """For absolute URLs without odd characters."""
    scheme, host, path, query = re.match(r"(\w+)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?", url).groups()
    path = re.sub("/+", "/", unquote(path or "/")[:-1] if len(path) > 1 and path.endswith("/") else unquote(path or "/"))
    pairs = [tuple(map(unquote_plus, (p + "=").split("=")[:2])) for p in (query or "").split("&") if p]
    text = "&".join(quote_plus(k) + (f"={quote_plus(v)}" if v else "") for k, v in sorted(pairs) if k.lower() not in IGNORED)
    return f"{scheme}://{host.lower()}{quote(path, safe='/')}" + (f"?{text}" if text else "")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_duplicate_urls_of_the_given_pages(spark, sf):
    folder = f"/root/testdata/{sf}"
    groups = {}
    for r in Site.open(spark, folder, BASE, entry.CATALOG).table("site_pages").collect():
        groups.setdefault(plain(r.url), []).append(r.page_id)
    got = {(r.normalized_url, r.id) for r in entry.queries()["U02_dedupe"](spark, folder).collect()}
    assert got == {(n, min(ids)) for n, ids in groups.items()}
    doubled = {i for n, ids in groups.items() if len(ids) > 1 for i in ids}
    assert doubled and doubled == {r.url_id for r in entry.queries()["url_health"](spark, folder).where("occurrences > 1").collect()}


def test_look_up_by_normal_form(spark):
    links = spark.createDataFrame([(1, "http://E.com:80/A/#x"), (2, "http://e.com/a")], "id long, to_url string")
    urls = spark.createDataFrame([(7, "http://e.com/A"), (8, "http://e.com/b")], "id long, normalized_url string")
    assert [tuple(r) for r in Site(spark, {"links": links, "urls": urls}).run("S08_lookup_urls").collect()] == [(1, 7)]
