"""The shared pass: a user's analyzers in it, and what it reads."""

import re

import pytest

import __spark_entry__ as entry
from crawlweft.operators.passes import Analyzer, Rule
from crawlweft.plans import BASE
from crawlweft.site import COMPUTED, OPERATORS, Site
from tests.test_site import ROOT, site

SF = "/root/testdata/sf0.001"


def test_a_users_analyzers(spark):
    given = site(spark)
    loud = Analyzer(
        "loud_titles", "pages", {"url_id": "url_id", "url": "url", "title": "title", "words": "cast(size(split(title, ' ')) AS bigint)"}, {"wordy": ("words > 2", False), "silent": ("title = ''", True)},
        {"title_of_one_word": Rule("words = 1", "notice", "low", "titles"), "title_words": Rule("words > 2", times="words")}, {"Address": "url", "Words": "words"},
    )
    many = [Analyzer("tracked_links", "links", {"link_id": "id", "page": "from_url_id", "to_url": "to_url"}, {}, {"link_to_products": Rule("to_url LIKE '%/products/%'")}), Analyzer("framed", "texts", {"url_id": "url_id", "frames": "html LIKE '%<iframe%'"}, {}, {"no_frames": Rule("NOT frames")})]
    s = Site(spark, given.tables, analyzers=[loud, *many])
    assert sorted(r.url.removeprefix(ROOT) for r in s.analyze("loud_titles", "wordy").collect()) == ["/"]
    assert s.shown("loud_titles").columns == ["Address", "Words"] and s.analyze("loud_titles").count() == 10
    found = {}
    for r in s.run("J13_issue_urls").collect():
        found.setdefault(r.issue_code, []).append(r.url.removeprefix(ROOT))
    assert found["title_of_one_word"] == ["/blog"] and found["title_words"] == ["/"] * 3 and sorted(found["link_to_products"]) == ["/products"] * 3 and len(found["no_frames"]) == 8
    before = sorted(map(str, given.run("S06_all_issues").collect()))
    assert before == sorted(str(r) for r in s.run("S06_all_issues").collect() if r.issue_code not in ("title_of_one_word", "title_words", "link_to_products", "no_frames"))
    row = s.run("S06_all_issues").where("issue_code = 'title_of_one_word'").first()
    assert (row.issue_type, row.severity, row.category) == ("notice", "low", "titles")


@pytest.mark.parametrize("wrong", [
    Analyzer("h1", "pages", {"url_id": "url_id"}), Analyzer("Bad name", "pages", {}), Analyzer("a", "nothing", {}), Analyzer("a", "pages", {"x": "1"}, {}, {"missing_title": Rule("true")}), Analyzer("a", "pages", {"x": "1"}, {}, {}, {"X": "y"}),
])
def test_wrong_analyzers_are_refused(spark, wrong):
    with pytest.raises(ValueError):
        Site(spark, {}, analyzers=[wrong])


def test_issues_read_each_stored_table_at_most_twice(spark, tmp_path):
    for name, df in site(spark).tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    plan = Site.open(spark, str(tmp_path)).run("S06_all_issues")._jdf.queryExecution().optimizedPlan().toString()
    paths = re.findall(r"Relation \[([^\]]*)\] parquet", plan)
    # a stored table is known by the columns that only it has
    marks = {"urls": "normalized_url", "fetches": "fetched_at", "html_features": "h1_first", "links": "anchor_text", "resources": "mime_type", "page_html": "html#", "hreflangs": "hreflang#", "sitemap_urls": "changefreq", "redirect_chains": "has_loop", "pagespeed": "cls#"}
    times = {t: sum(m in p for p in paths) for t, m in marks.items()}
    assert all(1 <= n <= 2 for n in times.values()), times
    assert sum(len(p) > 0 for p in paths) <= 16


def test_no_plan_joins_all_with_all(spark):
    site = Site.open(spark, SF, BASE, entry.CATALOG)
    found = {}
    for name in OPERATORS:
        if name not in COMPUTED and "__" not in name:  # a filter is a WHERE on its analyzer
            plan = site.run(name)._jdf.queryExecution().executedPlan().toString()
            found[name] = [join for join in ("CartesianProduct", "NestedLoopJoin") if join in plan]
    assert {n: j for n, j in found.items() if j} == {}
