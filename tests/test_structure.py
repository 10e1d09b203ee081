"""Structure reports on crawls deeper than the given tables."""

from crawlweft.site import Site

FETCH = "id long, url_id long, status_code int, content_type string, response_time_ms long, fetched_at timestamp, x_robots string"


def site(spark):
    deep = "/" + "/".join(f"d{k}" for k in range(1, 21))
    urls = [(1, "", 0, True), (2, deep, 9, True), (3, deep + "/page", 9, True), (4, "/d1//d2/", 2, True), (5, "/far/away", 30, False)]
    return Site(spark, {"urls": spark.createDataFrame(urls, "id long, path string, depth int, is_internal boolean"), "fetches": spark.createDataFrame([(1, 3, 404, "", 1, None, "")], FETCH)})


def test_paths_and_depths_have_no_ceiling(spark):
    s = site(spark)
    tree = {r.full_path: (r.level, r.url_count) for r in s.run("T01_path_tree").collect()}
    prefix = lambda n: "/" + "/".join(f"d{k}" for k in range(1, n + 1))
    assert tree == {prefix(n): (n, 3 if n < 3 else 2) for n in range(1, 21)} | {prefix(20) + "/page": (21, 1)}
    assert [r.full_path for r in s.run("T02_flatten").collect()] == sorted(tree)
    folders = {r.prefix: (r.n, r.errors) for r in s.run("G24_folder_stats").collect()}
    assert folders == {p: (n, 1) for p, (_, n) in tree.items()}
    depths = [(r.depth, r.n, r.percent) for r in s.run("G21_depth_distribution").orderBy("depth").collect()]
    assert depths == [(d, {0: 1, 2: 1, 9: 2}.get(d, 0), {0: 25.0, 2: 25.0, 9: 50.0}.get(d, 0.0)) for d in range(10)]


def test_status_texts_and_extensions_are_whole(spark):
    codes = {200: "OK", 206: "Success", 302: "Found", 303: "Redirect", 403: "Forbidden", 410: "Gone", 418: "Client Error", 503: "Service Unavailable", 599: "Server Error", 0: "Unknown", None: "Unknown"}
    fetches = spark.createDataFrame([(k, k, c, "", 1, None, "") for k, c in enumerate(codes)], FETCH)
    texts = {r.id: r.text for r in Site(spark, {"fetches": fetches}).run("X16_status_text").collect()}
    assert [texts[k] for k in range(len(codes))] == list(codes.values())
    assert {r.status_code: r.text for r in Site(spark, {"fetches": fetches}).run("G22_status_distribution").collect()} == codes
    paths = ["/a.SVG", "/a.webp", "/a.doc", "/a.mp4", "/a.woff2", "/a.rar", "/a.7z", "/a.html", "/a"]
    urls = spark.createDataFrame([(k, p, p) for k, p in enumerate(paths)], "id long, url string, path string")
    assert [r.url for r in Site(spark, {"urls": urls}).run("F06_extensions").collect()] == ["/a.html", "/a"]
