"""XML sitemaps and sitemap indexes."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, functions as F

SITEMAP = "kind string, error string, entries array<struct<loc:string,lastmod:string,changefreq:string,priority:double>>"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _priority(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parsed(status: int | None, body: str | None) -> dict:
    """An HTTP error, an index of sitemaps, a set of URLs or an error of format, told apart in this order."""
    body = body or ""
    if (status or 0) >= 400:
        return {"kind": "error", "error": f"HTTP {status}", "entries": []}
    kind = "sitemap_index" if "<sitemapindex" in body else "sitemap" if "<urlset" in body else None
    if not kind:
        return {"kind": "error", "error": "Unknown sitemap format", "entries": []}
    try:
        root = ElementTree.fromstring(body.encode())
    except ElementTree.ParseError as e:
        return {"kind": "error", "error": f"XML parse error: {e}", "entries": []}
    entries = []
    for node in root:
        if _local(node.tag) == ("sitemap" if kind == "sitemap_index" else "url"):
            of = {_local(c.tag): (c.text or "").strip() for c in node}
            entries.append({"loc": of.get("loc", ""), "lastmod": of.get("lastmod", ""), "changefreq": of.get("changefreq", ""), "priority": _priority(of.get("priority", ""))})
    return {"kind": kind, "error": "", "entries": entries}


def _parsed(status: pd.Series, body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(None if pd.isna(s) else int(s), b) for s, b in zip(status, body, strict=True)], columns=["kind", "error", "entries"])


def parsed_sitemap(status: Column | str, body: Column | str) -> Column:
    return F.pandas_udf(_parsed, SITEMAP)(status, body)
