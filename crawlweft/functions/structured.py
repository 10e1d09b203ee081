"""Structured data of HTML texts: JSON-LD blocks and microdata types as rows of items."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

ITEM = "struct<type:string,format:string,valid:boolean,errors:array<string>,warnings:array<string>>"
#: Fields that an item of a type should have, and those without which it is wrong.
WANTED = {
    **dict.fromkeys(("Article", "NewsArticle", "BlogPosting"), ("headline", "author", "datePublished")), "Product": ("name",), "LocalBusiness": ("name",), "Organization": ("name",), "WebSite": ("name", "url"),
}
NEEDED = {"BreadcrumbList": "itemListElement", "FAQPage": "mainEntity"}
BLOCK = re.compile(r"""<script[^>]*type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""")
_TYPE = re.compile(r"""itemtype=["']([^"']+)["']""")


def blocks(html: str) -> Iterator[tuple[bool, object]]:
    """(whether it parses, value or message) of each JSON-LD block."""
    return _parsed(BLOCK.findall(html))


def _parsed(raw: Iterable[str]) -> Iterator[tuple[bool, object]]:
    for text in raw:
        try:
            yield True, json.loads(text.strip())
        except (ValueError, RecursionError) as e:
            yield False, str(e)


def types(data: object) -> list[str]:
    """@type values through lists and @graph, however deep, in their order; a stack in place of recursion."""
    out, stack = [], [data]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            t = x.get("@type")
            out += [t] if isinstance(t, str) else [y for y in t if isinstance(y, str)] if isinstance(t, list) else []
            if isinstance(x.get("@graph"), list):
                stack.append(x["@graph"])
    return out


def items(html: str | None) -> list[dict]:
    text = html or ""
    return _items(BLOCK.findall(text), _TYPE.findall(text) if "itemscope" in text and "itemtype" in text else [])


def _items(raw: Iterable[str], itemtypes: Iterable[str]) -> list[dict]:
    out = []
    for good, data in _parsed(raw):
        if not good:
            out.append({"type": "Unknown (parse error)", "format": "JSON-LD", "valid": False, "errors": [f"JSON parse error: {data}"], "warnings": []})
            continue
        errors, warnings = [], []
        if isinstance(data, dict) and isinstance(kind := data.get("@type"), str):
            warnings = [f"Missing recommended field '{f}'" for f in WANTED.get(kind, ()) if f not in data]
            if kind == "Product" and "offers" not in data:
                warnings.append("Product missing 'offers'")
            if kind in NEEDED and NEEDED[kind] not in data:
                errors.append(f"{kind} missing '{NEEDED[kind]}'")
        out.append({"type": ", ".join(types(data)) or "Unknown", "format": "JSON-LD", "valid": not errors, "errors": errors, "warnings": warnings})
    names = dict.fromkeys(t.rsplit("/", 1)[-1] if "schema.org/" in t else t for t in itemtypes)
    return out + [{"type": n, "format": "Microdata", "valid": True, "errors": [], "warnings": []} for n in names]


def _found(html: Column | str, pattern: re.Pattern) -> Column:
    """A pattern's groups in a page. Spark cuts them out, so that Python is handed these parts and not whole pages."""
    text = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    return F.regexp_extract_all(text, F.lit(pattern.pattern), F.lit(1))


def structured_items(html: Column | str) -> Column:
    """The items of a page as array<ITEM>: JSON-LD blocks in their order, then distinct microdata types."""

    def run(raw: pd.Series, itemtypes: pd.Series) -> pd.Series:
        return pd.Series([_items(r, t) for r, t in zip(raw, itemtypes, strict=True)])

    text = F.col(html) if isinstance(html, str) else html
    scoped = F.when(F.contains(text, F.lit("itemscope")), _found(text, _TYPE)).otherwise(F.array().cast("array<string>"))
    return F.pandas_udf(run, f"array<{ITEM}>")(_found(text, BLOCK), scoped)


def json_values(data: object, path: str) -> list[str]:
    """Dotted keys, [n] and [*] from `$`; strings, numbers and lists of strings are values, others none."""
    path = path.removeprefix("$.").removeprefix("$")
    if not path:
        return [data] if isinstance(data, str) else [json.dumps(data, separators=(",", ":"), sort_keys=True, ensure_ascii=False)]
    now = data
    for part in path.split("."):
        if part.startswith("[") and part.endswith("]"):
            if not isinstance(now, list):
                return []
            if part == "[*]":
                return [x for x in now if isinstance(x, str)]
            found = re.match(r"\s*([+-]?\d+)", part[1:-1])
            at = int(found[1]) if found else 0
            now = now[at] if 0 <= at < len(now) else None
        else:
            now = now.get(part) if isinstance(now, dict) else None
        if now is None:
            return []
    if isinstance(now, str):
        return [now]
    if isinstance(now, bool):
        return []
    if isinstance(now, (int, float)):
        return [_number(float(now))]
    return [x for x in now if isinstance(x, str)] if isinstance(now, list) else []


def _number(x: float) -> str:
    """The shortest digits that give x again; an exponent of two digits at least from 1e21 on and below 1e-4."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" not in text:
        return text
    body, _, power = text.partition("e")
    return f"{body}e{power[0] if power[0] in '+-' else '+'}{power.lstrip('+-').zfill(2)}"


def json_path(html: Column | str, path: str) -> Column:
    """Values at a path in every JSON-LD block of a page, as array<string>."""

    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda texts: [v for good, data in _parsed(texts) if good for v in json_values(data, path)])

    return F.pandas_udf(run, "array<string>")(_found(html, BLOCK))
