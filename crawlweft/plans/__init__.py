"""Declarative plans: named SQL over the crawl tables, resolved into one statement with common table expressions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: Tables of the test data, which fixtures.py derives crawl tables from.
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Tables of a crawl: what Site.open() looks for in a folder.
CRAWL = ("urls", "fetches", "html_features", "links", "resources", "page_resources", "redirect_chains", "sitemap_urls", "hreflangs", "page_html", "pagespeed", "robots_files", "sitemap_files")
_NAME = re.compile(r"(?<!\\[px])\{([A-Za-z_]\w*)\}")
#: Words whose spelling differs between Spark SQL and DuckDB.
DIALECT = {"RX(": ("regexp_like(", "regexp_matches("), "BLEN(": ("octet_length(", "strlen("), "RXALL(": ("regexp_replace(", "regexp_replace("), "EACH(": ("explode(", "unnest("), "TEXT": ("string", "varchar"), "PARTS(": ("split(", "string_split("), "SIZE(": ("size(", "len("), "SEQ(": ("sequence(", "generate_series("), "CHARS(": ("char_length(", "length("),
           "KEPT(": ("filter(", "list_filter("), "MAPPED(": ("transform(", "list_transform("), "SORTED(": ("array_sort(", "list_sort("), "GLUED(": ("array_join(", "array_to_string("), "PAIR(": ("array(", "list_value("), "FIRST_OF(": ("slice(", "list_slice("), "ITEM(": ("element_at(", "list_extract("),
           # FOLDED(list FROM_EMPTY lambda) starts from the empty string
           "FOLDED(": ("aggregate(", "list_reduce(list_concat([''], "), "FROM_EMPTY": (", '',", "),"), "UNESCAPED(": ("try_url_decode(", "url_decode("), "DISTINCT_OF(": ("array_distinct(", "list_distinct("), "ALL_OF(": ("regexp_extract_all(", "regexp_extract_all("), "FOUND(": ("instr(", "instr("), "UNIX(": ("unix_micros(", "epoch_us("),
           # lambdas with an index count from 0 in one engine and from 1 in the other
           "FIRST_INDEX": ("0", "1"), "BEFORE": ("0", "-1"), "UPPER_CLASS": (r"'\\p{Lu}'", r"'\p{Lu}'")}


def spelled(sql: str, spark: bool) -> str:
    """JOINED(x, sep, by) and the words of DIALECT in one engine's spelling; GALL(s, re, to) replaces all matches."""
    side = 0 if spark else 1
    for word, names in DIALECT.items():
        sql = re.sub(rf"(?<!\w){re.escape(word)}" + ("" if word.endswith("(") else r"(?!\w)"), lambda _, n=names[side]: n, sql)
    sql = re.sub(r"JOINED\(([^;]*?);([^;]*?);([^;)]*?)\)", r"listagg(\1,\2) within group (order by \3)" if spark else r"string_agg(\1,\2 order by \3)", sql)
    inner = re.compile(r"GALL\(((?:(?!GALL\()[^;])*?);([^;]*?);([^;)]*?)\)")
    while (new := inner.sub(r"regexp_replace(\1,\2,\3)" if spark else r"regexp_replace(\1,\2,\3,'g')", sql)) != sql:
        sql = new
    return sql if spark else _counted(re.sub(r"(?:\(([a-z], [a-z])\)|\b([a-z]\w*)) -> ", lambda m: f"lambda {m[1] or m[2]}: ", sql))


def _counted(sql: str) -> str:
    """count_if(x) of DuckDB is null where x is never known; a count over CASE is not."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if('):end - 1]} THEN 1 END){sql[end:]}"
    return sql


class Catalog:
    """Plans by name. A plan's SQL names what it reads in braces. other: statements written for the other engine alone; forms: plans that it reads in another form."""

    def __init__(self, plans: Mapping[str, str], other: Mapping[str, str] | None = None, forms: Mapping[str, str] | None = None) -> None:
        self.plans, self.other = dict(plans), {k: spelled(v, False) for k, v in (forms or {}).items()} | dict(other or {})

    def _needs(self, name: str, given: Iterable[str], spark: bool = True) -> list[str]:
        order: list[str] = []
        text = self.plans if spark else self.plans | self.other

        def visit(x: str, trail: tuple[str, ...]) -> None:
            if x in given or x in order:
                return
            if x in trail:
                raise ValueError(f"plan {x} depends on itself")
            for y in _NAME.findall(text[x]):
                visit(y, (*trail, x))
            order.append(x)

        visit(name, ())
        return order

    def statement(self, name: str, given: Iterable[str] = BASE) -> str:
        """One statement for the other engine: every plan that `name` needs as a common table expression over the given tables."""
        *before, last = self._needs(name, set(given), spark=False)
        sql = lambda x: _NAME.sub(lambda m: m[1], self.other.get(x) or spelled(self.plans[x], False))
        head = ", ".join(f"{x} AS ({sql(x)})" for x in before)
        return (f"WITH {head} " if head else "") + sql(last)

    def run(self, spark: SparkSession, name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The plan over the given tables (of crawl tables or of what they are derived from)."""
        given = {**tables}
        *before, last = self._needs(name, given)
        text = {x: spelled(self.plans[x], True) for x in (*before, last)}
        used = {t for s in text.values() for t in _NAME.findall(s) if t in given}
        # views of this one statement: analysis resolves them, then they go
        views = {t: f"{t}_{uuid.uuid4().hex}" for t in used}
        for t, view in views.items():
            given[t].createOrReplaceTempView(view)
        try:
            inner = lambda x: _NAME.sub(lambda m: views.get(m[1], m[1]), text[x])
            head = ", ".join(f"{x} AS ({inner(x)})" for x in before)
            return spark.sql((f"WITH {head} " if head else "") + inner(last))
        finally:
            for view in views.values():
                spark.catalog.dropTempView(view)
