"""Exports, checkpoints, crawl control."""

import csv
import io
import json
import zipfile
from datetime import datetime
from xml.etree import ElementTree

from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlweft.operators import crawl, sinks
from crawlweft.operators.reports import SEGMENTS
from crawlweft.plans import BASE
from crawlweft.site import Site
from crawlweft.streaming.checkpoints import Checkpoints
from tests.test_site import site as eight_pages

SF = "/root/testdata/sf0.001"


def frame(spark):
    return spark.createDataFrame([(1, 1.005, True, datetime(2024, 1, 2, 3, 4, 5), 'a "b", c', [1]), (2, None, None, None, None, None), (None,) * 6], "id long, x double, ok boolean, at timestamp, text string, list array<int>")


def test_csv_file_has_a_mark_a_header_and_formatted_cells(spark, tmp_path):
    sinks.csv_file(frame(spark), f"file://{tmp_path}/a.csv", delimiter=";")
    raw = (tmp_path / "a.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig")), delimiter=";"))
    assert rows[0] == ["id", "x", "ok", "at", "text", "list"] and sorted(rows[1:]) == [["1", "1.00", "Yes", "2024-01-02T03:04:05Z", 'a "b", c', "[1]"], ["2", "", "", "", "", ""]]
    sinks.csv_file(frame(spark), f"file://{tmp_path}/b.csv", max_rows=1, order=["id desc nulls last"] and ["x"], bom=False)
    assert len((tmp_path / "b.csv").read_text().splitlines()) == 2


def test_json_xlsx_and_all_reports(spark, tmp_path):
    site = Site.open(spark, SF, BASE, entry.CATALOG)
    sinks.export_report(site, "R03_client_errors", f"file://{tmp_path}/r.json", kind="json")
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["metadata"]["report"] == "Client Errors (4xx)" and len(got["rows"]) == site.run("R03_client_errors").count() and set(got["rows"][0]) == set(got["metadata"]["columns"])
    sinks.export_report(site, "R03_client_errors", f"file://{tmp_path}/r.xlsx", kind="xlsx")
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert [s.attrib["name"] for s in ElementTree.fromstring(z.read("xl/workbook.xml"))[0]] == ["Client Errors (4xx)", "Metadata"]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        assert len(sheet[0]) == len(got["rows"]) + 1 and ["".join(c.itertext()) for c in sheet[0][0]] == got["metadata"]["columns"]
    sinks.export_analyzer(site, "page_titles", f"file://{tmp_path}/t.csv", "too_long")
    head, *rows = csv.reader(io.StringIO((tmp_path / "t.csv").read_text(encoding="utf-8-sig")))
    assert head == ["Address", "Title", "Length", "Pixel Width", "Status", "Occurrences"] and rows and all(int(r[2]) > 60 for r in rows)
    assert sinks.issue_export(site).columns == ["URL ID", "Issue Code", "Type", "Severity", "Category", "Message"]


def test_names_snapshots_graph(spark, tmp_path):
    assert sinks.sheet_name("a/b:c[d]" + "x" * 40) == "a_b_c_d_" + "x" * 23 and sinks.sheet_name("A", ["a"]) == "A_2" and sinks.file_name('R "x"/Y') == "r__x__y"
    snaps, df = sinks.Snapshots(spark, f"file://{tmp_path}/snaps"), frame(spark)
    assert snaps.matches("one", df) and snaps.matches("one", df.repartition(3)) and not snaps.matches("one", df.where("id = 1")) and not snaps.matches("one", df.unionByName(df))
    site = Site.open(spark, SF, BASE, entry.CATALOG)
    sinks.graph_json(site, f"file://{tmp_path}/g.json")
    g = json.loads((tmp_path / "g.json").read_text())
    assert len(g["nodes"]) == site.run("N01_nodes").count() and len(g["edges"]) == site.run("G27_edges").count()


def test_checkpoints(spark, tmp_path):
    c = Checkpoints(spark, f"file://{tmp_path}/c", keep=2)
    assert c.due() and c.load() == {} and c.versions() == []
    for k in range(3):
        c.save(pending=spark.range(k), done=spark.range(5))
    (tmp_path / "c/v000009").mkdir()  # not finished
    assert c.versions() == [2, 3] and not c.due() and c.load()["pending"].count() == 2 and c.load(2)["pending"].count() == 1
    c.clear()
    assert c.versions() == []


def test_token_bucket_and_rate_controller():
    b = crawl.TokenBucket(rate=1, burst=2, tokens=2)
    assert [b.allow(t) for t in (0, 0, 0, 1, 1, 10, 10, 10)] == [True, True, False, True, False, True, True, False]
    c = crawl.RateController()
    assert c.sample(0, 10, 0, 0, 0) == 27.500000000000004 and c.sample(1, 0, 50, 0, 0) == 27.500000000000004
    assert abs(c.sample(6, 0, 0, 0, 0) - 19.25) < 1e-9 and abs(c.sample(6.5, 0, 0, 0, 6) - 13.475) < 1e-9
    for t in range(20, 200, 10):
        low = c.sample(t, 0, 9, 2000, 0)
    assert low == 0.5


def test_folds_keep_keys_and_order(spark):
    events = spark.createDataFrame([(f"k{i % 7}", i // 7 % 50, i) for i in range(5000)], "k string, t int, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = crawl.folded(events, "k", ("t", "i"), lambda: [0], lambda s, e: s.append(e["t"]) or {"k": e["k"], "n": len(s) - 1, "t": e["t"]}, "k string, n long, t int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in {r.k for r in got}:
        mine = sorted((r.n, r.t) for r in got if r.k == k)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [t for _, t in mine] == sorted(t for _, t in mine)


def test_walks(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 5), (9, 0)], "source long, target long")
    crawl.ensure_checkpoints(spark)
    walk = lambda *a: sorted((r.depth, r.id) for r in crawl.bfs(edges, spark.createDataFrame([(0,)], "id long"), *a).collect())
    assert walk(2) == [(0, 0), (1, 1), (1, 3), (2, 2), (2, 4)] and walk(9) == [*walk(2), (3, 5)] and walk(2, 4) == [(0, 0), (1, 1), (1, 3), (2, 2)]
    xy = crawl.positions(3, [(0, 1)])
    far = lambda a, b: ((xy[a][0] - xy[b][0]) ** 2 + (xy[a][1] - xy[b][1]) ** 2) ** 0.5
    assert far(0, 1) < far(0, 2) and crawl.positions(0, []) == [] and len(crawl.positions(1, [])) == 1
    site = Site.open(spark, SF, BASE, entry.CATALOG)
    assert site.run("N03_layout").where(F.col("x").isNull()).count() == 0


def test_bulk_export_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    full = eight_pages(spark)
    part = Site(spark, {n: df for n, df in full.tables.items() if n != "redirect_chains"})
    monkeypatch.setattr(sinks, "REPORT_NAMES", {n: sinks.REPORT_NAMES[n] for n in ("R02_redirect_chains", "R06_missing_titles", "R16_broken_links")})
    got = sinks.export_all(part, str(tmp_path))
    assert got["R16_broken_links"] == 2 and got["R06_missing_titles"] == 2 and isinstance(got["R02_redirect_chains"], str)
    assert sorted(p.name for p in tmp_path.glob("*.csv")) == sorted(f"{sinks.file_name(sinks.REPORT_NAMES[n])}.csv" for n in ("R06_missing_titles", "R16_broken_links"))
    sinks.segment_json(part, f"{tmp_path}/segments.json")
    segments = json.loads((tmp_path / "segments.json").read_text())
    assert {k for k in segments} == {k for k in SEGMENTS if k != "G20_all_segments"} and [(r["segment"], r["n"]) for r in segments["G16_by_depth"]] == [("2", 5), ("1", 4), ("0", 1)]
