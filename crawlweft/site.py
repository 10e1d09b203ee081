"""The engine's front: crawl tables in, analyzers, filters, reports, segments and graph operators out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.analyzers import ANALYZERS, COLUMNS, FILTER_PLANS, FILTERS, ISSUE_PLANS, LASTMOD_VALID, SHOWN, filtered
from .operators.arrivals import ARRIVALS
from .operators.crawl import STATEFUL
from .operators.documents import FUNCTIONS
from .operators.measured import MEASURED
from .operators.options import OPTIONS
from .operators.passes import Analyzer, plans_of, shared_issues
from .operators.reports import BY_STEPS, GRAPH, REPORTS, SCALARS, SEGMENTS
from .operators.walks import WALKS
from .plans import CRAWL, Catalog
from .plans.oracles import DUCK
from .sources.seeds import SEEDS

PLANS = ANALYZERS | FILTER_PLANS | shared_issues(LASTMOD_VALID) | ISSUE_PLANS | REPORTS | SEGMENTS | GRAPH | SCALARS
COMPUTED = FUNCTIONS | STATEFUL | WALKS | ARRIVALS | MEASURED | OPTIONS | SEEDS
CATALOG = Catalog(PLANS, DUCK, BY_STEPS)
#: Plans and computed tables that stand for an operator; the others are their parts.
PARTS = ("wide", "url_parts", "url_flags", "amp_links", "page_texts", "page_facts", *SHOWN.values(), "page_state", "overview", "first_inlink", "prefixes", "node_ids", "structured_items", "templates", "hops")
OPERATORS = [k for k in (*PLANS, *COMPUTED) if k not in PARTS]


class Folder(Mapping):
    """Parquet tables of a folder by name, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
        self._spark, self._folder, self._names, self._open = spark, folder, names, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._open:
            self._open[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class Site:
    """Named operators over one crawl. tables: crawl tables by name (urls, fetches, html_features, links, ...). analyzers: a user's, whose issues are found in the same pass as all others."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], catalog: Catalog = CATALOG, analyzers: Iterable[Analyzer] = ()) -> None:
        own = list(analyzers)
        self.spark, self.tables, self.titles = spark, tables, COLUMNS | {a.name: dict(a.titles) for a in own}
        self.catalog = Catalog(catalog.plans | plans_of(own, LASTMOD_VALID, {*catalog.plans, *COMPUTED, *tables}), catalog.other) if own else catalog

    @classmethod
    def open(cls, spark: SparkSession, folder: str, names: tuple[str, ...] = CRAWL, catalog: Catalog = CATALOG, analyzers: Iterable[Analyzer] = ()) -> Site:
        """A folder with {table}.parquet for the crawl tables; only those that an operator needs have to be there."""
        return cls(spark, Folder(spark, folder, names), catalog, analyzers)

    def table(self, name: str) -> DataFrame:
        """A given table, or an operator's rows."""
        return self.tables[name] if name in self.tables else self.run(name)

    def run(self, name: str) -> DataFrame:
        if name in COMPUTED:
            return COMPUTED[name](self.table)
        given = {*self.tables, *COMPUTED}
        needed = {t for x in self.catalog._needs(name, given) for t in given if f"{{{t}}}" in self.catalog.plans[x]}
        return self.catalog.run(self.spark, name, {t: self.table(t) for t in needed})

    def analyze(self, analyzer: str, filter_id: str | None = None) -> DataFrame:
        """An analyzer's rows, all or those that a named filter keeps (an unknown filter keeps all)."""
        name = f"{analyzer}__{filter_id}"
        return self.run(name if filter_id and name in self.catalog.plans else analyzer)

    def shown(self, analyzer: str, filter_id: str | None = None) -> DataFrame:
        """An analyzer's rows under its display titles."""
        if analyzer in SHOWN:
            predicate, default = FILTERS.get(analyzer, {}).get(filter_id, ("true", True))
            rows = self.run(SHOWN[analyzer]).where(f"coalesce({predicate}, {default})")
        else:
            rows = self.analyze(analyzer, filter_id)
        return rows.select(*(F.col(key).alias(title) for title, key in self.titles[analyzer].items()))

    def where(self, name: str, column: str, value: object) -> DataFrame:
        return self.run(name).where(F.col(column) == value)

    def sorted(self, name: str, column: str, descending: bool = False) -> DataFrame:
        return self.run(name).orderBy(F.col(column).desc() if descending else F.col(column))

    def search(self, name: str, needle: str) -> DataFrame:
        """Rows with a cell that contains the needle, whatever its case."""
        df = self.run(name)
        return df.where(F.exists(F.array(*(F.lower(F.col(c).cast("string")) for c in df.columns)), lambda c: F.coalesce(F.contains(c, F.lit(needle.lower())), F.lit(False))))


__all__ = ["CATALOG", "OPERATORS", "Analyzer", "Site", "filtered"]
