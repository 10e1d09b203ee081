"""Operators that read documents: pages, robots files, sitemaps, structured data, user rules. Each maps a look-up of tables to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import html, robots, rules, sitemap, structured
from ..functions.cells import cells

Tables = Callable[[str], DataFrame]

#: Rules that the registered queries run; callers give their own.
SEARCHES = [
    rules.SearchRule("s1", "the", "text", "The", "text"), rules.SearchRule("s2", "pictures", "contains", "<IMG"), rules.SearchRule("s3", "jumps", "regex", '<a href="#[^"]*"'), rules.SearchRule("s4", "exact", "regex", "[A-Z][a-z]+ing", "title", True),
    rules.SearchRule("s5", "id", "css", "#two"), rules.SearchRule("s6", "class", "css", ".deep"), rules.SearchRule("s7", "tag", "css", "img.photo"), rules.SearchRule("s8", "address", "text", "q", "url"), rules.SearchRule("s9", "shared", "contains", "shared", "meta"),
]
EXTRACTIONS = [
    rules.ExtractionRule("e1", "h1", "regex", "<h1>([^<]*)</h1>", 1), rules.ExtractionRule("e2", "group 7", "regex", "<h4[^>]*>", 7), rules.ExtractionRule("e3", "deep", "css", ".deep"), rules.ExtractionRule("e4", "two", "css", "#two"),
    rules.ExtractionRule("e5", "alts", "css", "img[alt]"), rules.ExtractionRule("e6", "headings", "css", "h2"), rules.ExtractionRule("e7", "sources", "xpath", "//img/@src"), rules.ExtractionRule("e8", "text", "xpath", "//h4/text()"),
    rules.ExtractionRule("e9", "elements", "xpath", "//h4"), rules.ExtractionRule("e10", "names", "json", "$.name"), rules.ExtractionRule("e11", "prices", "json", "$.price"), rules.ExtractionRule("e12", "tags", "json", "$.tags.[*]"),
]
AGENT = "goodbot"


def structured_items(t: Tables) -> DataFrame:
    """A row for each item of a page."""
    rows = t("page_html").select("url_id", F.posexplode(structured.structured_items("html")).alias("position", "item"))
    return rows.select("url_id", F.col("position").cast("long").alias("position"), "item.type", "item.format", "item.valid", F.size("item.errors").cast("long").alias("n_errors"), F.size("item.warnings").cast("long").alias("n_warnings"))


def parsed_pages(t: Tables) -> DataFrame:
    page = html.with_page(t("site_pages"), "title", "language", "h1", "links", "scripts", "word_count", keep=["page_id"])
    return page.select("page_id", "p.title", "p.language", F.element_at("p.h1", 1).alias("h1"), F.size("p.h1").cast("long").alias("h1_count"), F.size("p.links").cast("long").alias("links"), F.size("p.scripts").cast("long").alias("scripts"), F.col("p.word_count").cast("long").alias("word_count"))


def parsed_links(t: Tables) -> DataFrame:
    """Anchors with resolved addresses: the links table of a crawl."""
    rows = html.with_page(t("site_pages"), "links", keep=["page_id"]).select("page_id", F.posexplode("p.links").alias("position", "l"))
    return rows.select("page_id", F.col("position").cast("long").alias("position"), F.col("l.url").alias("to_url"), F.col("l.text").alias("anchor_text"), F.col("l.nofollow").alias("nofollow"))


def parsed_images(t: Tables) -> DataFrame:
    rows = html.with_page(t("page_html"), "images", keep=["url_id"]).select("url_id", F.posexplode("p.images").alias("position", "i"))
    return rows.select("url_id", F.col("position").cast("long").alias("position"), "i.src", "i.alt")


def _robots_rules(t: Tables) -> DataFrame:
    return t("robots_files").select("host", F.explode(robots.parsed_robots("body")["rules"]).alias("r")).select("host", "r.agent", "r.kind", "r.rule", "r.pattern")


def robots_rules(t: Tables) -> DataFrame:
    return _robots_rules(t).drop("pattern")


def robots_sources(t: Tables) -> DataFrame:
    """Delays and sitemaps of each host."""
    p = t("robots_files").select("host", robots.parsed_robots("body").alias("p"))
    return p.select("host", F.array_max(F.transform(F.filter("p.delays", lambda d: d["agent"] == "*"), lambda d: d["seconds"])).alias("delay"), F.array_join("p.sitemaps", " ").alias("sitemaps"))


def robots_allowed(t: Tables) -> DataFrame:
    paths = t("X08_robots_path").join(t("urls").select("id", "host"), "id").select("id", "host", F.col("robots_path").alias("path"))
    return robots.allowed(paths, robots.for_agent(_robots_rules(t), AGENT)).select("id", "path", "allowed")


def meta_robots(t: Tables) -> DataFrame:
    return t("robots_values").select("url_id", robots.meta_robots(F.col("content")).alias("m")).select("url_id", "m.*")


def x_robots(t: Tables) -> DataFrame:
    return t("robots_values").select("url_id", robots.x_robots(F.col("tags"), AGENT).alias("m")).select("url_id", "m.noindex", "m.nofollow", "m.noarchive", "m.max_snippet")


def sitemap_entries(t: Tables) -> DataFrame:
    rows = t("sitemap_files").select("url", sitemap.parsed_sitemap("status_code", "body").alias("s"))
    return rows.select("url", "s.kind", "s.error", F.explode_outer("s.entries").alias("e")).select("url", "kind", "error", "e.loc", "e.lastmod", "e.changefreq", "e.priority")


def _search_pages(t: Tables) -> DataFrame:
    return t("page_html").join(t("html_features").select("url_id", "title", "meta_description"), "url_id", "left")


def custom_search(t: Tables) -> DataFrame:
    first = F.col("rules")[0]
    return rules.searched(_search_pages(t), SEARCHES).select("url_id", "url", "total_matches", first["rule_name"].alias("rule_name"), first["match_count"].alias("match_count"), first["first_match"].alias("first_match"), first["context"].alias("context"))


def search_rows(t: Tables) -> DataFrame:
    return rules.expanded_searches(_search_pages(t), SEARCHES).select("url_id", "rule_id", "match_count", "first_match")


def custom_extraction(t: Tables) -> DataFrame:
    first = F.col("rules")[0]
    return rules.extracted(t("page_html"), EXTRACTIONS).select("url_id", "url", "total_extractions", first["rule_name"].alias("rule_name"), first["extracted_count"].alias("extracted_count"), first["first_value"].alias("first_value"), first["all_values"].alias("all_values"))


def extraction_rows(t: Tables) -> DataFrame:
    return rules.expanded_extractions(t("page_html"), EXTRACTIONS).select("url_id", "rule_id", "extracted_count", "first_value", "all_values")


def bounded_pages(t: Tables) -> DataFrame:
    """Pages as the bounded parser keeps them, here within very small limits."""
    p = html.with_page(t("site_pages"), "title", "links", limits=html.Limits(links=3, title=12, anchor=4), keep=["page_id"])
    return p.select("page_id", "p.title", F.size("p.links").cast("long").alias("links"), F.array_join(F.transform("p.links", lambda x: x["text"]), "|").alias("anchors"))


def issue_export(t: Tables) -> DataFrame:
    titles = (("url_id", "URL ID"), ("issue_code", "Issue Code"), ("issue_type", "Type"), ("severity", "Severity"), ("category", "Category"))
    return t("issues").select(*(F.col(c).alias(name) for c, name in titles), F.initcap(F.translate("issue_code", "_", " ")).alias("Message"))


FUNCTIONS: dict[str, Callable[[Tables], DataFrame]] = {
    "structured_items": structured_items, "D01_parsed_pages": parsed_pages, "D04_parsed_links": parsed_links, "D05_parsed_images": parsed_images, "S17_robots_rules": robots_rules, "S17_robots_sources": robots_sources, "D07_robots_allowed": robots_allowed,
    "D08_meta_robots": meta_robots, "D09_x_robots": x_robots, "S16_sitemap_entries": sitemap_entries, "custom_search": custom_search, "Q07_search_rows": search_rows, "custom_extraction": custom_extraction, "D06_bounded_pages": bounded_pages, "K12_issue_export": issue_export, "K17_cells": lambda t: cells(t("pagespeed_result")), "Q12_extraction_rows": extraction_rows,
}
