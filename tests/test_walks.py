"""Walks against following them one step at a time."""

import random

import pytest
from pyspark.sql import functions as F

from crawlweft.operators.walks import canonical_walks, redirect_chains, resolved, walks


def followed(to, start, most):
    seen, at, hops = [], start, []
    while at in to and at not in seen:
        seen.append(at)
        at = to[at]
        hops.append(at)
    return at, len(hops), at in seen, hops[:most]


@pytest.mark.parametrize("most", [3, 2000])
def test_chains_rings_and_ways_into_rings(spark, most):
    rng = random.Random(2)
    to = {k: k + 1 for k in range(1000)} | {2000 + k: 2000 + (k + 1) % 64 for k in range(64)} | {3000 + k: 3000 + (k + 1) % 7 for k in range(7)} | {4000: 4000}
    to |= {5000 + k: 5001 + k if k < 40 else 2003 for k in range(41)} | {6000 + k: rng.choice((4000, 3002, 999, 1000, 7777)) for k in range(30)} | {8000 + k: 8000 + rng.randrange(60) for k in range(60)}
    rows = [*to.items(), (None, 1), (9001, None)]
    got = {r.start: (r.final, r.length, r.has_loop, r.hops) for r in walks(spark.createDataFrame(rows, "source long, target long"), most).collect()}
    assert got == {k: followed(to, k, most) for k in to}


def test_only_rings_and_nothing(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "source long, target long")
    assert sorted(tuple(r)[:4] for r in walks(df).collect()) == [(1, 1, 2, True), (2, 2, 2, True), (3, 1, 3, True)]
    assert walks(df.limit(0)).collect() == []


def test_redirects_from_recorded_responses(spark):
    rows = [
        ("http://a.e/1", 301, "/2"), ("http://a.e/2", 302, "../3?x=1#f"), ("http://a.e/3?x=1#f", 307, "//b.e/4"), ("http://b.e/4", 200, ""), ("http://a.e/r", 301, "r"), ("http://a.e/none", 301, ""), ("http://a.e/null", 302, None),
        ("http://a.e/end", 200, "/ignored"), ("http://a.e/1", 308, "/other"), *((f"http://l.e/{k}", 301, f"/{k + 1}") for k in range(15)),
    ]
    df = spark.createDataFrame(rows, "url string, status_code int, location string")
    got = {r.start_url: r for r in redirect_chains(df).collect()}
    one = got["http://a.e/1"]
    assert (one.final_url, one.length, one.has_loop, one.too_long) == ("http://b.e/4", 3, False, False)
    assert [tuple(h) for h in one.hops] == [("http://a.e/1", 301, "/2"), ("http://a.e/2", 302, "../3?x=1#f"), ("http://a.e/3?x=1#f", 307, "//b.e/4")]
    assert (got["http://a.e/r"].final_url, got["http://a.e/r"].length, got["http://a.e/r"].has_loop) == ("http://a.e/r", 1, True)
    assert got["http://l.e/0"].length == 15 and got["http://l.e/0"].too_long and len(got["http://l.e/0"].hops) == 10 and not got["http://l.e/5"].too_long
    assert not {"http://a.e/none", "http://a.e/null", "http://a.e/end", "http://b.e/4"} & set(got)
    near = {r.start_url: r.final_url for r in redirect_chains(df, follow="same_host").collect()}
    assert near["http://a.e/1"] == "http://a.e/3?x=1#f" and "http://a.e/3?x=1#f" not in near and redirect_chains(df, follow="none").count() == 0
    with pytest.raises(ValueError):
        redirect_chains(df, follow="some")


def test_a_response_that_leads_nowhere_hides_no_redirect(spark):
    rows = [("http://a.e/1", 200, ""), ("http://a.e/1", 301, "/2"), ("http://a.e/2", 301, None), ("http://a.e/2", 302, "/4"), ("http://a.e/2", 302, "/3"), ("http://a.e/3", 200, "/5")]
    got = {r.start_url: (r.final_url, r.length) for r in redirect_chains(spark.createDataFrame(rows, "url string, status_code int, location string")).collect()}
    assert got == {"http://a.e/1": ("http://a.e/3", 2), "http://a.e/2": ("http://a.e/3", 1)}


def test_references(spark):
    base = "http://a.e/b/c/d?q#f"
    want = {"g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d?y", "g?y": "/b/c/g?y", "#s": "/b/c/d?q#s", "g#s": "/b/c/g#s", "": "/b/c/d?q", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../../g": "/g", "/./g": "/g", "/../g": "/g", "g;x=1/../y": "/b/c/y", "g?y/./x": "/b/c/g?y/./x"}
    rows = [*((r, f"http://a.e{p}") for r, p in want.items()), ("//g", "http://g"), ("g:h", "g:h"), ("https://x/y", "https://x/y"), (None, None)]
    df = spark.createDataFrame(rows, "ref string, want string").withColumn("got", resolved(F.lit(base), F.col("ref")))
    assert [(r.ref, r.got) for r in df.collect()] == rows


def test_canonical_chains_and_loops(spark):
    to = {"a": "b", "b": "c", "c": "d", "d": "d", "x": "y", "y": "x", "s": "s", "e": "", "n": None, "o": "gone"}
    got = {r.url: (r.final, r.length, r.has_loop, r.issue_type, r.message) for r in canonical_walks(spark.createDataFrame(list(to.items()), "url string, canonical string")).collect()}
    loop = ("error", "Canonical chain contains a loop")
    assert got == {"a": ("d", 3, False, "warning", "Canonical chain detected (length: 3)"), "b": ("d", 2, False, None, None), "c": ("d", 1, False, None, None), "x": ("x", 2, True, *loop), "y": ("y", 2, True, *loop), "o": ("gone", 1, False, None, None)}
