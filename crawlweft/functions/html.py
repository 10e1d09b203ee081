"""HTML documents to page rows: one Arrow pass with the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import chunks

PAGE = (
    "title string, meta_description string, meta_keywords string, meta_robots string, canonical string, language string, base_url string, h1 array<string>, h2 array<string>, h3 array<string>, "
    "links array<struct<url:string,text:string,rel:string,nofollow:boolean>>, images array<struct<src:string,alt:string,title:string,width:int,height:int,loading:string>>, scripts array<struct<url:string,type:string,async:boolean,defer:boolean>>, "
    "stylesheets array<string>, hreflangs array<struct<hreflang:string,url:string>>, open_graph map<string,string>, twitter_card map<string,string>, meta_tags map<string,string>, text_content string, word_count int"
)
#: The same fields in Arrow.
_TEXT, _TEXTS, _MAP = pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
ARROW = {c: _TEXT for c in ("title", "meta_description", "meta_keywords", "meta_robots", "canonical", "language", "base_url", "text_content")} | {c: _TEXTS for c in ("h1", "h2", "h3", "stylesheets")} | {c: _MAP for c in ("open_graph", "twitter_card", "meta_tags")} | {
    "word_count": pa.int32(), "links": pa.list_(pa.struct([("url", _TEXT), ("text", _TEXT), ("rel", _TEXT), ("nofollow", pa.bool_())])), "hreflangs": pa.list_(pa.struct([("hreflang", _TEXT), ("url", _TEXT)])),
    "images": pa.list_(pa.struct([("src", _TEXT), ("alt", _TEXT), ("title", _TEXT), ("width", pa.int32()), ("height", pa.int32()), ("loading", _TEXT)])), "scripts": pa.list_(pa.struct([("url", _TEXT), ("type", _TEXT), ("async", pa.bool_()), ("defer", pa.bool_())])),
}


@dataclass(frozen=True)
class Limits:
    """How much of a page the bounded parser keeps; texts are cut in characters."""

    links: int = 10_000
    images: int = 5_000
    headings: int = 500
    title: int = 500
    meta: int = 1_000
    anchor: int = 500


def _int(text: str) -> int:
    found = re.match(r"\s*(\d{1,9})", text)
    return int(found[1]) if found else 0


_SKIPPED = ("javascript:", "mailto:", "tel:", "#")


def _without_dots(path: str) -> str:
    """'.' and '..' resolved; empty segments stay."""
    out: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        if part == "..":
            out = out[:-1] if len(out) > 1 else out
        elif part != ".":
            out.append(part)
            continue
        if k == len(parts) - 1:
            out.append("")
    return "/".join(out)


def resolve(base: str, href: str) -> str:
    """A reference against its base by RFC 3986; what cannot be parsed stays as it is."""
    try:
        b, r = urlsplit(base), urlsplit(href)
    except ValueError:
        return href
    if r.scheme:
        return href
    if r.netloc:
        return urlunsplit((b.scheme, r.netloc, _without_dots(r.path), r.query, r.fragment))
    if not r.path:
        return urlunsplit((b.scheme, b.netloc, b.path, r.query or ("" if href.startswith("?") else b.query), r.fragment))
    path = r.path if r.path.startswith("/") else (b.path[: b.path.rfind("/") + 1] or ("/" if b.netloc else "")) + r.path
    return urlunsplit((b.scheme, b.netloc, _without_dots(path), r.query, r.fragment))


class _Page(HTMLParser):
    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.words, self.open, self.anchor, self.hidden = url, [], [], None, 0
        self.row = {"title": "", "meta_description": "", "meta_keywords": "", "meta_robots": "", "canonical": "", "language": "", "base_url": url, "h1": [], "h2": [], "h3": [], "links": [], "images": [], "scripts": [], "stylesheets": [], "hreflangs": [], "open_graph": {}, "twitter_card": {}, "meta_tags": {}}

    def resolve(self, href: str) -> str:
        return resolve(self.base, href)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a, row = {k: v or "" for k, v in attrs}, self.row
        match tag:
            case "html":
                row["language"] = a.get("lang", "")
            case "base" if a.get("href"):
                self.base = row["base_url"] = self.resolve(a["href"])
            case "title" | "h1" | "h2" | "h3":
                self.open.append([tag, ""])
            case "meta":
                name = (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower()
                if name in ("description", "keywords", "robots"):
                    row[f"meta_{name}"] = a.get("content", "")
                elif name.startswith("og:"):
                    row["open_graph"][name[3:]] = a.get("content", "")
                elif name.startswith("twitter:"):
                    row["twitter_card"][name[8:]] = a.get("content", "")
                elif name:
                    row["meta_tags"][name] = a.get("content", "")
            case "link":
                rel, href = a.get("rel", "").lower(), a.get("href", "")
                if rel == "canonical":
                    row["canonical"] = self.resolve(href)
                elif rel == "stylesheet":
                    row["stylesheets"].append(self.resolve(href))
                elif rel == "alternate" and a.get("hreflang"):
                    row["hreflangs"].append({"hreflang": a["hreflang"], "url": self.resolve(href)})
            case "a":
                href = a.get("href", "").strip()
                if href and not href.lower().startswith(_SKIPPED):
                    self.anchor = {"url": self.resolve(href), "text": "", "rel": a.get("rel", ""), "nofollow": "nofollow" in a.get("rel", "").lower()}
                    row["links"].append(self.anchor)
            case "img":
                src = a.get("data-src") or a.get("src", "")
                row["images"].append({"src": self.resolve(src) if src else "", "alt": a.get("alt", ""), "title": a.get("title", ""), "width": _int(a.get("width", "")), "height": _int(a.get("height", "")), "loading": a.get("loading", "")})
            case "script":
                if a.get("src"):
                    row["scripts"].append({"url": self.resolve(a["src"]), "type": a.get("type", ""), "async": "async" in a, "defer": "defer" in a})
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "a":
            self.anchor = None
        elif self.open and self.open[-1][0] == tag:
            _, text = self.open.pop()
            if tag == "title":
                self.row["title"] = text.strip()
            elif text.strip():
                self.row[tag].append(text.strip())

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.words += data.split()
            for o in self.open:
                o[1] += data
            if self.anchor:
                self.anchor["text"] += data


def parse(url: str | None, html: str | None, limits: Limits | None = None) -> dict:
    page = _Page(url or "")
    page.feed(html or "")
    page.close()
    for link in page.row["links"]:
        link["text"] = re.sub(r"\s+", " ", link["text"]).strip()
    row = page.row | {"text_content": " ".join(page.words), "word_count": len(page.words)}
    return bounded(row, limits) if limits else row


def bounded(row: dict, limits: Limits) -> dict:
    """A page's row within limits."""
    out = row | {"title": row["title"][: limits.title], "links": [x | {"text": x["text"][: limits.anchor]} for x in row["links"][: limits.links]], "images": row["images"][: limits.images]}
    out |= {h: row[h][: limits.headings] for h in ("h1", "h2", "h3")} | {k: row[k][: limits.meta] for k in ("meta_description", "meta_keywords", "meta_robots")}
    return out | {k: {n: v[: limits.meta] for n, v in row[k].items()} for k in ("open_graph", "twitter_card", "meta_tags")}


def _pages(url: pd.Series, html: pd.Series, limits: Limits | None = None) -> pd.DataFrame:
    return pd.DataFrame([parse(u, h, limits) for u, h in zip(url, html, strict=True)], columns=[c.split()[0] for c in re.split(r", (?=\w+ )", PAGE)])


def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b or "", h or "") for b, h in zip(base, href, strict=True)])


def parsed_page(url: Column | str, html: Column | str, limits: Limits | None = None) -> Column:
    """The page's parsed row (PAGE) from its address and HTML, whole or within limits."""

    def run(u: pd.Series, h: pd.Series) -> pd.DataFrame:
        return _pages(u, h, limits)

    return F.pandas_udf(run, PAGE)(url, html)


def with_page(pages: DataFrame, *fields: str, limits: Limits | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """pages (url, html and the columns to keep): these columns and p, the fields of the parsed row (PAGE), by default all.

    A few pages at a time: of the others only their HTML is in memory, and of all the fields that are asked for.
    """
    types = dict(c.split(" ", 1) for c in re.split(r", (?=\w+ )", PAGE))
    names = [c for c in types if c in fields or not fields]
    given = pages.select(*dict.fromkeys((*keep, "url", "html")))
    schema = pages.select(*keep).schema.simpleString()[7:-1]
    shape = pa.struct([(c, ARROW[c]) for c in names])

    def row(url: str | None, html: str | None) -> dict:
        whole = parse(url, html, limits)
        return {c: list(whole[c].items()) if ARROW[c] == _MAP else whole[c] for c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            page = pa.array((row(u.as_py(), h.as_py()) for u, h in zip(batch["url"], batch["html"], strict=True)), shape)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), page], [*keep, "p"])

    return given.mapInArrow(run, f"{schema + ', ' if keep else ''}p struct<{', '.join(f'{c}: {types[c]}' for c in names)}>")


def resolved_url(base: Column | str, href: Column | str) -> Column:
    """A reference resolved against its base."""
    return F.pandas_udf(_resolved, "string")(base, href)
