"""What callers choose: which addresses are crawled, which nodes a graph shows, how pages are put into segments. Choices are checked when they are made."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .reports import EXTENSIONS

Tables = Callable[[str], DataFrame]


def _compiled(patterns: Sequence[str], what: str) -> None:
    for p in patterns:
        try:
            re.compile(p)
        except re.error as wrong:
            raise ValueError(f"invalid {what} pattern {p!r}: {wrong}") from wrong


def _any(column: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(p) for p in patterns), F.lit(False))


@dataclass(frozen=True)
class CrawlOptions:
    """Limits and rules of a crawl; 0 is unlimited. Values below their least are raised to it, as a crawl would take them."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = tuple(EXTENSIONS)
    max_depth: int = 0
    max_urls: int = 0
    max_query_params: int = 0
    concurrency: int = 5
    requests_per_second: float = 10.0
    crawl_delay_s: float = 1.0
    per_host_rate: float = 2.0
    timeout_s: float = 30.0
    max_retries: int = 3
    max_redirects: int = 10
    redirect_policy: str = "any"
    respect_robots: bool = True
    respect_nofollow: bool = False
    crawl_sitemaps: bool = False

    def __post_init__(self) -> None:
        for name, least in (("concurrency", 1), ("max_retries", 0), ("timeout_s", 1.0), ("max_redirects", 0)):
            object.__setattr__(self, name, max(getattr(self, name), least))
        for name in ("include", "exclude", "exclude_extensions"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        _compiled(self.include, "include")
        _compiled(self.exclude, "exclude")
        if self.redirect_policy not in ("any", "same_host", "none"):
            raise ValueError(f"redirect_policy is any, same_host or none, not {self.redirect_policy!r}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> CrawlOptions:
        given = json.loads(text)
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**given)

    def but(self, **changed: object) -> CrawlOptions:
        return replace(self, **changed)


#: Options for common cases.
PRESETS = {
    "fast": CrawlOptions(concurrency=20, requests_per_second=50, crawl_delay_s=0.1, per_host_rate=10, timeout_s=10, respect_robots=False), "polite": CrawlOptions(concurrency=2, requests_per_second=1, crawl_delay_s=2, per_host_rate=0.5, timeout_s=60, respect_nofollow=True),
    "rendering": CrawlOptions(requests_per_second=5, timeout_s=60), "audit": CrawlOptions(concurrency=10, crawl_delay_s=0.5, crawl_sitemaps=True),
}


def crawlable(urls: DataFrame, options: CrawlOptions, column: str = "url") -> DataFrame:
    """The rows whose address is to be crawled: no exclude pattern matches it, an include pattern does if there are any, its extension and its number of parameters are allowed, its depth (if the rows have one) is within the limit."""
    address = F.col(column)
    path = F.regexp_extract(address, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    kept = ~_any(address, options.exclude)
    if options.include:
        kept = kept & _any(address, options.include)
    if options.exclude_extensions:
        kept = kept & ~F.lower(F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1)).isin(*options.exclude_extensions)
    if options.max_query_params:
        query = F.regexp_extract(address, "[?]([^#]*)", 1)
        kept = kept & (F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))) <= options.max_query_params)
    if options.max_depth and "depth" in urls.columns:
        kept = kept & (F.col("depth") <= options.max_depth)
    return urls.where(kept)


def pending(urls: DataFrame, limit: int) -> DataFrame:
    """The next pages of a work list: pending internal ones by depth, then by when they were first seen (by id where that isn't known)."""
    if limit < 1:
        raise ValueError(f"a work list takes one page at least, not {limit}")
    return urls.where("crawl_status = 'pending' and is_internal").orderBy("depth", *(["first_seen"] if "first_seen" in urls.columns else []), "id").limit(limit)


@dataclass(frozen=True)
class GraphFilter:
    """Nodes of a crawl graph; 0 is no limit, no content types are all."""

    internal_only: bool = True
    max_depth: int = 0
    min_in_links: int = 0
    status: tuple[int, int] = (0, 599)
    content_types: tuple[str, ...] = ()
    indexable_only: bool = False
    max_nodes: int = 1000

    def __post_init__(self) -> None:
        if self.status[0] > self.status[1] or min(self.max_depth, self.min_in_links, self.max_nodes) < 0:
            raise ValueError(f"not a filter: {self}")


def graph_nodes(pages: DataFrame, links: DataFrame, graph: GraphFilter) -> DataFrame:
    """url_id, url, depth, status_code, in_links of the nodes that pass, the first max_nodes by id. pages: the rows of `wide`. A page that was not fetched passes the tests of its answer."""
    counts = links.where("to_url_id is not null").groupBy(F.col("to_url_id").alias("url_id")).agg(F.count("*").alias("n"))
    nodes = pages.join(counts, "url_id", "left").withColumn("in_links", F.coalesce("n", F.lit(0)))
    kept = F.col("status_code").isNull() | F.col("status_code").between(*graph.status)
    if graph.internal_only:
        kept = kept & F.col("is_internal")
    if graph.max_depth:
        kept = kept & (F.col("depth") <= graph.max_depth)
    if graph.min_in_links:
        kept = kept & (F.col("in_links") >= graph.min_in_links)
    if graph.content_types:
        kept = kept & (F.col("status_code").isNull() | F.coalesce(F.col("content_type").isin(*graph.content_types), F.lit(False)))
    if graph.indexable_only:
        kept = kept & F.coalesce("is_indexable", F.lit(False))
    found = nodes.where(kept).select("url_id", "url", "depth", "status_code", "in_links")
    return found.orderBy("url_id").limit(graph.max_nodes) if graph.max_nodes else found


def graph_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """source, target, weight between the given nodes (url_id)."""
    ends = nodes.select("url_id")
    kept = links.join(ends, F.col("from_url_id") == F.col("url_id"), "left_semi").join(ends, F.col("to_url_id") == F.col("url_id"), "left_semi")
    return kept.groupBy(F.col("from_url_id").alias("source"), F.col("to_url_id").alias("target")).agg(F.count("*").alias("weight"))


def tree_nodes(prefixes: DataFrame, fetched: DataFrame, *, status: tuple[int, int] | None = None, depth: int | None = None) -> DataFrame:
    """Nodes of the path tree by the status of their page (of several pages of one path the last that has one; 0 without) and by their depth in the tree: full_path, level, status_code. prefixes and fetched: the rows of `prefixes` and `latest_fetch`."""
    page = prefixes.where("is_page and prefix <> ''").join(fetched.select(F.col("url_id").alias("id"), "status_code"), "id", "left").groupBy("prefix").agg(F.max_by("status_code", F.when(F.col("status_code").isNotNull(), F.col("id"))).alias("status_code"))
    tree = prefixes.where("prefix <> ''").groupBy("prefix").agg(F.max("k").cast("long").alias("level")).join(page, "prefix", "left")
    out = tree.select(F.col("prefix").alias("full_path"), "level", F.coalesce("status_code", F.lit(0)).alias("status_code"))
    if status is not None:
        out = out.where(F.col("status_code").between(*status))
    return out if depth is None else out.where(F.col("level") == depth)


@dataclass(frozen=True)
class SegmentRule:
    name: str
    pattern: str

    def __post_init__(self) -> None:
        _compiled((self.pattern,), "segment")

    @property
    def id(self) -> str:
        return "custom_" + self.name.lower().translate(str.maketrans(" /.-", "____"))


@dataclass
class Segments:
    """Rules in their order; a page goes to the first that matches its address, else to Other."""

    rules: list[SegmentRule] = field(default_factory=list)

    def of(self, address: Column) -> Column:
        return reduce(lambda rest, r: F.when(address.rlike(r.pattern), r.name).otherwise(rest), reversed(self.rules), F.lit("Other"))

    def metrics(self, pages: DataFrame) -> DataFrame:
        """A row for each rule and for Other, empty ones too. pages: the rows of `wide`."""
        is_, zero = lambda low: F.count_if(F.col("status_code").between(low, low + 99)), F.lit(0)
        mean = lambda c: F.sum(F.coalesce(F.col(c), zero)).cast("double") / F.count("*")
        found = pages.where("is_internal").groupBy(self.of(F.col("url")).alias("segment")).agg(F.count("*").alias("n"), mean("response_time_ms").alias("avg_response_ms"), mean("word_count").alias("avg_words"), mean("depth").alias("avg_depth"), F.count_if(F.coalesce("is_indexable", F.lit(False))).alias("indexable"), is_(200).alias("ok"), is_(300).alias("redirects"), is_(400).alias("client_errors"))
        ids = {r.name: r.id for r in self.rules} | {"Other": "custom_other"}
        every = pages.sparkSession.createDataFrame(list(ids.items()), "segment string, id string")
        return every.join(found, "segment", "left").select("id", "segment", *(F.coalesce(c, F.lit(0.0) if c.startswith("avg") else zero).alias(c) for c in found.columns[1:]))


_CHOSEN = CrawlOptions(include=(r"/[a-z]+[-/]", r"[.]html$"), exclude=(r"[?]utm_", r"/t1"), max_query_params=3, max_depth=3)
_RULES = Segments([SegmentRule("Blog / news", "/blog|blog[.]"), SegmentRule("Paged", "[?]page="), SegmentRule("No such page", "/no/such/page"), SegmentRule("Documents", "[.]html")])
_GRAPH = GraphFilter(max_depth=2, min_in_links=2, status=(200, 399), content_types=("text/html", "text/html; charset=utf-8"), indexable_only=True)


def _graph(t: Tables, graph: GraphFilter) -> DataFrame:
    return graph_nodes(t("wide"), t("links"), graph)


OPTIONS: dict[str, Callable[[Tables], DataFrame]] = {
    "F05_url_rules": lambda t: crawlable(t("urls"), _CHOSEN).select("id", "url"), "S14_pending_list": lambda t: pending(t("urls"), 100).select("id", "url", "depth"), "F07_graph_nodes": lambda t: _graph(t, _GRAPH), "O05_first_nodes": lambda t: _graph(t, GraphFilter()),
    "F07_graph_edges": lambda t: graph_edges(_graph(t, GraphFilter(max_depth=2)), t("links")), "F08_tree_by_status": lambda t: tree_nodes(t("prefixes"), t("latest_fetch"), status=(200, 299)), "F08_tree_by_depth": lambda t: tree_nodes(t("prefixes"), t("latest_fetch"), depth=2), "G19_user_segments": lambda t: _RULES.metrics(t("wide")),
}
