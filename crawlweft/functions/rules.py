"""User rules that search pages and extract values, compiled to Column expressions.

Searches: types text, contains, regex, css; targets html, text, url, title, meta. Extractions: types regex, css, xpath,
json. Selectors are the small subset that can be found by pattern: #id, .class, tag, tag[attr]; //tag, //tag/@attr,
//tag/text(). Rules of one kind are evaluated in one pass over a page; only json needs Python.

Defined cases: a page without HTML has no matches; an empty text or contains pattern is refused, as is a pattern that does
not compile; offsets and cuts are in characters; a rule's first match is cut at 100 characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .structured import json_path

TARGETS = ("html", "text", "url", "title", "meta")
CUT, AROUND = 100, 50


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_ -" else f"\\{c}" if c.isascii() else c for c in text)


@dataclass(frozen=True)
class SearchRule:
    id: str
    name: str
    type: str
    pattern: str
    target: str = "html"
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if self.type not in ("text", "contains", "regex", "css") or self.target not in TARGETS:
            raise ValueError(f"rule {self.id}: unknown type or target")
        if not self.pattern:
            raise ValueError(f"rule {self.id}: an empty pattern matches everywhere")
        if self.type == "regex":
            re.compile(self.pattern)


@dataclass(frozen=True)
class ExtractionRule:
    id: str
    name: str
    type: str
    pattern: str
    group: int = 0
    attribute: str = ""

    def __post_init__(self) -> None:
        if self.type not in ("regex", "css", "xpath", "json"):
            raise ValueError(f"rule {self.id}: unknown type")
        if self.type == "regex":
            re.compile(self.pattern)


@dataclass
class Rules:
    """Rules in their order; a rule replaces one of the same id."""

    search: list[SearchRule] = field(default_factory=list)
    extract: list[ExtractionRule] = field(default_factory=list)

    def add(self, rule: SearchRule | ExtractionRule) -> Rules:
        of = self.search if isinstance(rule, SearchRule) else self.extract
        of[:] = [*(r for r in of if r.id != rule.id), rule]
        return self

    def remove(self, rule_id: str) -> Rules:
        for of in (self.search, self.extract):
            of[:] = [r for r in of if r.id != rule_id]
        return self

    def clear(self) -> Rules:
        self.search.clear()
        self.extract.clear()
        return self


def strip_tags(html: Column) -> Column:
    """Scripts and styles go, tags become spaces, white space is collapsed and trimmed."""
    bare = reduce(lambda c, tag: F.regexp_replace(c, rf"<{tag}[^>]*>[\s\S]*?</{tag}>", ""), ("script", "style"), html)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "), r"^\s+|\s+$", "")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def css_search(html: Column, selector: str) -> Column:
    s = selector.strip()
    if s.startswith("#"):
        return _all(html, rf"""id=["']{_quoted(s[1:])}["']""")
    if s.startswith("."):
        return _all(html, rf"""class=["'][^"']*\b{_quoted(s[1:])}\b[^"']*["']""")
    tag = s.split(".")[0].split("#")[0]
    return _all(html, rf"<{_quoted(tag)}[^>]*>") if tag else F.array().cast("array<string>")


def matches(rule: SearchRule, page: dict[str, Column]) -> Column:
    """All matches of a rule as array<string>; page: a column for each target."""
    content, pattern = F.coalesce(page[rule.target], F.lit("")), rule.pattern
    folded, needle = (content, pattern) if rule.case_sensitive else (F.lower(content), pattern.lower())
    none = F.array().cast("array<string>")
    match rule.type:
        case "text":
            n = (F.length(folded) - F.length(F.replace(folded, F.lit(needle), F.lit("")))) / len(needle)
            return F.array_repeat(F.lit(needle), n.cast("int"))
        case "contains":
            return F.when(F.contains(folded, F.lit(needle)), F.array(F.lit(pattern))).otherwise(none)
        case "regex":
            return _all(content, ("" if rule.case_sensitive else "(?i)") + pattern)
    return F.when(content != "", css_search(F.coalesce(page["html"], F.lit("")), pattern)).otherwise(none)


def _cut(text: Column) -> Column:
    return F.when(F.length(text) > CUT, F.concat(F.substring(text, 1, CUT), F.lit("..."))).otherwise(text)


def context(rule: SearchRule, page: dict[str, Column], match_: Column) -> Column:
    """AROUND characters on both sides of the first place of a match, whatever its case."""
    content = F.coalesce(page["html" if rule.target == "html" else "text"], F.lit(""))
    at = F.instr(F.lower(content), F.lower(match_))
    begin, end = F.greatest(at - AROUND, F.lit(1)), F.least(at - 1 + F.length(match_) + AROUND, F.length(content))
    shown = F.concat(F.when(begin > 1, "...").otherwise(""), content.substr(begin, end - begin + 1), F.when(end < F.length(content), "...").otherwise(""))
    return F.when(at > 0, shown).otherwise("")


def _page(df: DataFrame) -> dict[str, Column]:
    known = {"html": "html", "url": "url", "title": "title", "meta": "meta_description"}
    cols = {k: F.col(c) if c in df.columns else F.lit("") for k, c in known.items()}
    return cols | {"text": F.col("_text")}


def searched(pages: DataFrame, rules: list[SearchRule]) -> DataFrame:
    """pages (url_id, url, html, optionally title and meta_description) with total_matches and rules: array of (rule_id, rule_name, match_count, first_match, context)."""
    df = pages.withColumn("_text", strip_tags(F.coalesce("html", F.lit(""))))
    page = _page(df)
    df = df.select("*", *(matches(r, page).alias(f"_m{k}") for k, r in enumerate(rules)))
    found = []
    for k, r in enumerate(rules):
        m = F.col(f"_m{k}")
        first = F.get(m, F.lit(0))
        found.append(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.size(m).cast("long").alias("match_count"), _cut(first).alias("first_match"), F.when(F.size(m) > 0, context(r, page, first)).alias("context")))
    total = reduce(lambda a, b: a + b, (x["match_count"] for x in found), F.lit(0).cast("long"))
    kind = "array<struct<rule_id:string,rule_name:string,match_count:bigint,first_match:string,context:string>>"
    return df.select("url_id", "url", total.alias("total_matches"), F.array(*found).cast(kind).alias("rules"))


def expanded_searches(pages: DataFrame, rules: list[SearchRule]) -> DataFrame:
    """A row for each page and rule that matches."""
    return searched(pages, rules).select("url_id", "url", F.explode("rules").alias("r")).select("url_id", "url", "r.*").where("match_count > 0")


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def css_extract(html: Column, selector: str, attribute: str) -> Column:
    s = selector.strip()
    if "[" in s and "]" in s:
        tag, _, rest = s.partition("[")
        attribute = rest.removesuffix("]")
    else:
        tag = s
    if not tag:
        return F.array().cast("array<string>")
    if tag.startswith("#"):
        whole, inner = rf"""<([a-zA-Z0-9]+)[^>]*id=["']{_quoted(tag[1:])}["'][^>]*>([\s\S]*?)</\1>""", 2
    elif tag.startswith("."):
        whole, inner = rf"""<([a-zA-Z0-9]+)[^>]*class=["'][^"']*\b{_quoted(tag[1:])}\b[^"']*["'][^>]*>([\s\S]*?)</\1>""", 2
    else:
        whole, inner = rf"<{_quoted(tag)}([^>]*)>([\s\S]*?)</{_quoted(tag)}>", 2
    if not attribute:
        return _present(F.transform(_all(html, whole, inner), strip_tags))
    value = rf"""{_quoted(attribute)}=["']([^"']*)["']"""
    elements = _all(html, whole)
    if tag[0] not in "#.":  # hits of paired elements come first, then all opening tags: the former twice
        elements = F.concat(elements, _all(html, rf"<{_quoted(tag)}([^>]*)/?>"))
    return F.transform(F.filter(elements, lambda e: F.regexp_like(e, F.lit(value))), lambda e: F.regexp_extract(e, value, 1))


def xpath_extract(html: Column, path: str) -> Column:
    path = path.removeprefix("//")
    if "/@" in path:
        tag, attribute = path.split("/@")[:2]
        return _all(html, rf"""<{_quoted(tag)}[^>]*{_quoted(attribute)}=["']([^"']*)["']""", 1)
    if path.endswith("/text()"):
        tag = _quoted(path.removesuffix("/text()"))
        return _present(F.transform(_all(html, rf"<{tag}[^>]*>([\s\S]*?)</{tag}>", 1), strip_tags))
    return _all(html, rf"<{_quoted(path)}[^>]*>([\s\S]*?)</{_quoted(path)}>")


def values(rule: ExtractionRule, html: Column) -> Column:
    """All values of a rule as array<string>."""
    match rule.type:
        case "regex":
            group = rule.group if 0 <= rule.group <= re.compile(rule.pattern).groups else 0
            return _present(F.transform(_all(html, rule.pattern, group), lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")))
        case "css":
            return css_extract(html, rule.pattern, rule.attribute)
        case "xpath":
            return xpath_extract(html, rule.pattern)
    return json_path(html, rule.pattern)


def extracted(pages: DataFrame, rules: list[ExtractionRule]) -> DataFrame:
    """pages (url_id, url, html) with total_extractions, extracted_json and rules: array of (rule_id, rule_name, extracted_count, first_value, all_values)."""
    df = pages.withColumn("html", F.coalesce("html", F.lit("")))
    df = df.select("url_id", "url", *(values(r, F.col("html")).alias(f"_v{k}") for k, r in enumerate(rules)))
    found = [F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.size(v).cast("long").alias("extracted_count"), F.coalesce(_cut(F.get(v, F.lit(0))), F.lit("")).alias("first_value"), F.array_join(v, " | ").alias("all_values")) for k, r in enumerate(rules) for v in [F.col(f"_v{k}")]]
    total = reduce(lambda a, b: a + b, (x["extracted_count"] for x in found), F.lit(0).cast("long"))
    whole = F.to_json(F.map_from_arrays(F.array(*(F.lit(r.name) for r in rules)), F.array(*(F.col(f"_v{k}") for k in range(len(rules)))))) if rules else F.lit("{}")
    kind = "array<struct<rule_id:string,rule_name:string,extracted_count:bigint,first_value:string,all_values:string>>"
    return df.select("url_id", "url", total.alias("total_extractions"), whole.alias("extracted_json"), F.array(*found).cast(kind).alias("rules"))


def expanded_extractions(pages: DataFrame, rules: list[ExtractionRule]) -> DataFrame:
    """A row for each page and rule, also where nothing is found."""
    return extracted(pages, rules).select("url_id", "url", F.explode("rules").alias("r")).select("url_id", "url", "r.*")
