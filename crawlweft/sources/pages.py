"""From fetched pages to the tables of a crawl.

Input: a row for each response with id, url, html and, where known, the columns of RESPONSE, or headers (a map of name to values) that
tell x_robots and location. Responses with locations make redirect chains. Every page is parsed once, in
Arrow batches; the parsed rows are checkpointed, and all tables are projections and joins of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.html import Limits, with_page
from ..functions.sitemap import parsed_sitemap
from ..functions.speed import header
from ..functions.url import normalized
from ..operators.crawl import ensure_checkpoints
from ..operators.walks import redirect_chains
from ..plans import spelled
from .store import headers_json

#: Columns of a response, their types and what stands in for a missing one.
RESPONSE = {
    "status_code": ("int", 200), "content_type": ("string", "text/html"), "response_time_ms": ("long", 0), "fetched_at": ("timestamp", None), "x_robots": ("string", ""), "location": ("string", ""), "depth": ("int", 0),
    "discovered_from": ("long", None), "in_sitemap": ("boolean", False), "crawl_status": ("string", "crawled"), "is_internal": ("boolean", True),
}
HOST = "^https?://([^/?#]+)"


def with_normal_form(df: DataFrame, column: str) -> DataFrame:
    """df and normalized_url, the normal form of a column."""
    view = f"given_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        return df.sparkSession.sql(spelled(normalized(f"SELECT * FROM {view}", column), True)).select(*df.columns, "normalized_url")
    finally:
        df.sparkSession.catalog.dropTempView(view)


def crawl_tables(responses: DataFrame, limits: Limits | None = None) -> dict[str, DataFrame]:
    """urls, fetches, html_features, links, resources, page_resources, hreflangs and page_html of the responses."""
    ensure_checkpoints(responses.sparkSession)
    moved = "location" in responses.columns or "headers" in responses.columns
    if "headers" in responses.columns:
        told = {c: header(F.col("headers"), name) for c, name in (("x_robots", "X-Robots-Tag"), ("location", "Location"), ("content_type", "Content-Type")) if c not in responses.columns}
        responses = responses.withColumns(told | {"headers_json": headers_json("headers")})
    kept = [F.col("headers_json")] if "headers_json" in responses.columns else [F.lit(None).cast("string").alias("headers_json")]
    given = responses.select("id", "url", "html", *((F.col(c) if c in responses.columns else F.lit(v)).cast(t).alias(c) for c, (t, v) in RESPONSE.items()), *kept)
    parsed = with_page(given, limits=limits, keep=given.columns).withColumn("p", F.when(F.col("html").isNotNull(), F.col("p"))).checkpoint()
    host = lambda c: F.lower(F.regexp_extract(c, HOST, 1))
    urls = with_normal_form(parsed.select("id", "url", host(F.col("url")).alias("host"), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1).alias("path"), "discovered_from", "depth", "crawl_status", "is_internal", "in_sitemap"), "url").checkpoint()
    robots = F.lower(F.concat_ws(",", "p.meta_robots", "x_robots"))
    pages = parsed.where("p is not null")
    features = pages.select(
        F.col("id").alias("url_id"), "p.title", "p.meta_description", "p.meta_keywords", "p.meta_robots", "p.canonical", F.size("p.h1").alias("h1_count"), F.coalesce(F.get("p.h1", F.lit(0)), F.lit("")).alias("h1_first"), F.size("p.h2").alias("h2_count"), F.coalesce(F.get("p.h2", F.lit(0)), F.lit("")).alias("h2_first"),
        F.md5(F.lower("p.text_content")).alias("content_hash"), "p.word_count", "p.language", (~F.contains(robots, F.lit("noindex")) & ~F.regexp_like(robots, F.lit(r"(^|,)\s*none\s*(,|$)"))).alias("is_indexable"),
    )
    anchors = pages.select("id", host(F.col("url")).alias("_host"), F.posexplode("p.links").alias("_k", "l"))
    anchors = with_normal_form(anchors.select((F.shiftleft("id", 20) + F.col("_k")).alias("link_id"), F.col("id").alias("from_url_id"), F.col("l.url").alias("to_url"), F.col("l.text").alias("anchor_text"), F.col("l.rel").alias("rel"), (host(F.col("l.url")) == F.col("_host")).alias("is_internal"), (~F.col("l.nofollow")).alias("is_follow")), "to_url")
    known = urls.groupBy("normalized_url").agg(F.min("id").alias("to_url_id"))
    links = anchors.join(known, "normalized_url", "left").select(F.col("link_id").alias("id"), "from_url_id", "to_url_id", "to_url", "anchor_text", "is_internal", "is_follow", "rel")
    fetched = parsed.groupBy("url").agg(F.max("status_code").alias("status_code"))
    item = lambda kind, url, alt, w, h, a, d, mime: F.struct(F.lit(kind).alias("resource_type"), url.alias("url"), alt.alias("alt"), w.alias("width"), h.alias("height"), a.alias("is_async"), d.alias("is_defer"), mime.alias("mime_type"))
    text, zero, no = F.lit(""), F.lit(0), F.lit(False)
    items = F.concat(
        F.transform("p.images", lambda i: item("image", i["src"], i["alt"], i["width"], i["height"], no, no, text)), F.transform("p.scripts", lambda s: item("script", s["url"], text, zero, zero, s["async"], s["defer"], s["type"])), F.transform("p.stylesheets", lambda s: item("stylesheet", s, text, zero, zero, no, no, text))
    )
    shown = pages.select(F.col("id").alias("url_id"), F.explode(items).alias("r")).select("url_id", "r.*").where("url <> ''").withColumn("resource_id", F.xxhash64("url"))
    # the first page by id says what a resource is; sizes come with its own response, which a page does not tell
    first = F.min_by(F.struct("resource_type", "alt", "width", "height", "is_async", "is_defer", "mime_type"), F.struct("url_id", "alt")).alias("f")
    resources = shown.groupBy("resource_id", "url").agg(first).join(fetched, "url", "left").select(F.col("resource_id").alias("id"), "url", "f.resource_type", F.coalesce("status_code", F.lit(0)).alias("status_code"), F.lit(0).cast("long").alias("size"), "f.alt", "f.width", "f.height", "f.is_async", "f.is_defer", "f.mime_type")
    return {
        "urls": urls, "fetches": parsed.where("status_code > 0").select(F.col("id"), F.col("id").alias("url_id"), "status_code", "content_type", "response_time_ms", "fetched_at", "x_robots", "headers_json"), "html_features": features, "links": links, "resources": resources,
        "page_resources": shown.select("resource_id", "url_id").distinct(), "hreflangs": pages.select(F.col("id").alias("url_id"), "url", F.explode("p.hreflangs").alias("h")).select("url_id", "url", "h.hreflang", F.col("h.url").alias("href")), "page_html": pages.select(F.col("id").alias("url_id"), "url", "html"),
    } | ({"redirect_chains": redirect_chains(parsed.select("url", "status_code", "location"))} if moved else {})


def sitemap_urls(files: DataFrame, urls: DataFrame) -> DataFrame:
    """files: url, status_code, body. A row for each entry of a set of URLs, with the id of the page it names."""
    entries = files.select(parsed_sitemap("status_code", "body").alias("s")).where("s.kind = 'sitemap'").select(F.explode("s.entries").alias("e")).select("e.*")
    return entries.join(urls.select(F.col("id").alias("url_id"), F.col("url").alias("loc")), "loc", "left").select("url_id", F.col("loc").alias("url"), "lastmod", "changefreq", "priority")
