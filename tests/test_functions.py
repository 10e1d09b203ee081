import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlweft.functions.batches import chunks
from crawlweft.functions.html import parse, parsed_page, with_page
from crawlweft.functions.robots import allowed, meta_robots, rules_of
from crawlweft.functions.structured import blocks, items, json_path, json_values, structured_items
from crawlweft.operators.sinks import write_csv
from crawlweft.plans import BASE
from crawlweft.site import Site
from crawlweft.streaming.fetches import error_rates, first_seen

SF = "/root/testdata/sf0.001"


def test_page(spark):
    html = """<html lang=en><head><title> A &amp; B </title><meta name="description" content="d"><link rel=canonical href="/c"><base href="/x/"></head>
    <h1>One</h1><h1> </h1><a href="y">t <b>u</b></a><a href="#z">no</a><img data-src=i.png src=j.png><script>var a = "</p>";</script>"""
    row = parse("https://h.example/a", html)
    assert (row["title"], row["canonical"], row["h1"], row["language"]) == ("A & B", "https://h.example/c", ["One"], "en")
    assert [(x["url"], x["text"]) for x in row["links"]] == [("https://h.example/x/y", "t u")] and row["images"][0]["src"].endswith("/x/i.png")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", parsed_page("url", "html").alias("p"))
    assert pages.where(F.col("p.title") == "").count() == 0 and pages.where(F.size("p.h1") != 1).count() == 0
    assert parse(None, None)["word_count"] == 0
    # HTML decodes some names without their semicolon too
    assert parse("", "<title>a &amp;&amp;&amp</title><h1>&copy &am</h1>")["title"] == "a &&&" and parse("", "<h1>&copy &am</h1>")["h1"] == ["© &am"]


def test_pages_are_parsed_a_few_at_a_time_and_to_the_fields_asked_for(spark):
    rows = [(k, f"http://a.e/{k}", f'<title>t{k}</title><meta property="og:x" content="{k}"><img src="{k}.png"><a href="/{k}">l</a>' + "w " * 2000) for k in range(600)] + [(None, None, None), (-1, "http://a.e/", ""), (-2, None, "<img src=x>")]
    df = spark.createDataFrame(rows, "id long, url string, html string").coalesce(1)
    want = {i: parse(u, h) for i, u, h in rows}
    got = {r.id: r.p.asDict(True) for r in with_page(df, keep=["id"]).collect()}
    assert got == want and {r.id: r.p.asDict(True) for r in with_page(df, "images", "word_count", keep=["id"]).collect()} == {i: {k: w[k] for k in ("images", "word_count")} for i, w in want.items()}
    plan = lambda name: entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert all("text_content" not in plan(name) for name in ("D01_parsed_pages", "D04_parsed_links", "D05_parsed_images", "D06_bounded_pages"))
    table = pa.RecordBatch.from_pydict({"id": list(range(600)), "html": [h for _, _, h in rows[:600]]})
    assert max(b.num_rows for b in chunks(iter([table]), "html")) < 200


def test_python_is_handed_blocks_and_not_pages(spark):
    ld = '<script type="application/ld+json">%s</script>'
    pages = ["", None, "no", ld % '{"@type": "Product", "name": "a"}' + ld % "{broken" + ld % '\u00a0["x"]\n', "<script id=x type='application/ld+json' >\n[1, {\"@type\": \"Article\"}]</script>", '<p itemscope itemtype="https://schema.org/Offer"><p itemtype="u:v"><p itemtype="https://schema.org/Offer">', '<p itemtype="u:v">', ld % '{"name": "é|\u20ac"}' * 300]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string").select("id", structured_items("html").alias("i"), json_path("html", "$.name").alias("v"))
    assert {r.id: [x.asDict() for x in r.i] for r in df.collect()} == {k: items(h) for k, h in enumerate(pages)}
    assert {r.id: r.v for r in df.collect()} == {k: [v for good, data in blocks(h or "") if good for v in json_values(data, "$.name")] for k, h in enumerate(pages)}
    for name in ("custom_extraction__has_extraction", "Q12_extraction_rows"):
        assert "run(regexp_extract_all(" in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_robots(spark):
    rules = rules_of("User-agent: a\nUser-agent: *\nDisallow: /private/\nAllow: /private/open$\n\nUser-agent: b\nDisallow: /*.pdf$")
    assert [r[:3] for r in rules if r[0] == "b"] == [("b", "disallow", "/*.pdf$")]
    table = spark.createDataFrame([("h", k, p, x) for a, k, p, x in rules if a == "*"], "host string, kind string, rule string, pattern string")
    paths = spark.createDataFrame([("h", "/private/x"), ("h", "/private/open"), ("h", "/"), ("g", "/private/x")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in allowed(paths, table).collect()} == {("h", "/private/x"): False, ("h", "/private/open"): True, ("h", "/"): True, ("g", "/private/x"): True}
    r = spark.createDataFrame([("NONE, max-snippet:20",), (None,)], "m string").select(meta_robots(F.col("m")).alias("r")).collect()
    assert r[0].r.noindex and r[0].r.max_snippet == 20 and not r[1].r.noindex and r[1].r.max_snippet == -1


def test_site_front_and_csv(spark, tmp_path):
    site = Site.open(spark, SF, BASE, entry.CATALOG)
    assert site.analyze("page_titles", "no_such_filter").count() == site.analyze("page_titles").count() == 50
    assert site.search("page_titles", "THE").count() <= 50
    write_csv(site.where("G05_status_histogram", "status_code", 200), str(tmp_path / "c"))
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "c").glob("part-*")) == 2


def test_streams(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{SF}/events.parque[t]")
    for df, name in ((first_seen(events), "seen"), (error_rates(events), "rates")):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    rates = {r.start: (r.n, r.errors, r.error_rate) for r in spark.table("rates").collect()}
    hours = {r.hour_: (r.n, r.errors) for r in spark.sql(f"SELECT date_trunc('hour', cast(ts AS timestamp)) hour_, count(*) n, count_if(event_type = 'error') errors FROM parquet.`{SF}/events.parquet` GROUP BY 1").collect()}
    assert rates and all(hours[h] == v[:2] and abs(v[2] - v[1] / v[0]) < 1e-12 for h, v in rates.items())
    assert spark.table("seen").count() == spark.table("seen").select("user_id").distinct().count() > 0
