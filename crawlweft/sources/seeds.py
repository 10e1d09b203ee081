"""Where a crawl starts: lists of addresses, and sitemaps that indexes of indexes lead to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.sitemap import parsed_sitemap
from ..operators.crawl import bfs, ensure_checkpoints
from .pages import with_normal_form

Tables = Callable[[str], DataFrame]
#: Indexes within indexes that are followed.
MAX_DEPTH = 10


def list_seeds(rows: DataFrame) -> DataFrame:
    """url, normalized_url: each page of a list once, by its normal form, under the address that comes first by `position`. Blank addresses go."""
    given = rows.select(F.trim("url").alias("url"), "position").where("url <> ''")
    formed = with_normal_form(given, "url")
    return formed.groupBy("normalized_url").agg(F.min_by("url", F.struct("position", "url")).alias("url")).select("url", "normalized_url")


def sitemap_seeds(files: DataFrame, roots: Sequence[str], max_depth: int = MAX_DEPTH) -> DataFrame:
    """url, lastmod, priority, sitemap, depth: each page that the sitemaps under the roots name, once, from the nearest sitemap (the least address of several).

    files: url, status_code, body of fetched sitemaps, each parsed once. Indexes are opened level by level; one that leads back, or that has
    been opened, is not opened again. Files that are missing, broken or answered with an error lead nowhere.
    """
    spark = files.sparkSession
    ensure_checkpoints(spark)
    parsed = files.select("url", parsed_sitemap("status_code", "body").alias("s")).where("s.error = ''").select("url", "s.kind", F.explode("s.entries").alias("e")).where("e.loc <> ''").checkpoint()
    edges = parsed.where("kind = 'sitemap_index'").select(F.col("url").alias("source"), F.col("e.loc").alias("target"))
    opened = bfs(edges, spark.createDataFrame([(r,) for r in roots], "id string"), max_depth)
    named = parsed.where("kind = 'sitemap'").join(opened, F.col("url") == F.col("id")).select(F.col("e.loc").alias("page"), "e.lastmod", "e.priority", F.col("url").alias("sitemap"), "depth")
    first = named.groupBy("page").agg(F.min(F.struct("depth", "sitemap", "lastmod", "priority")).alias("f"))
    return first.select(F.col("page").alias("url"), "f.lastmod", "f.priority", "f.sitemap", "f.depth")


SEEDS: dict[str, Callable[[Tables], DataFrame]] = {
    "S23_sitemap_seeds": lambda t: sitemap_seeds(t("sitemap_tree"), ["https://root.example/index.xml"]).select("url", "sitemap", "depth"),
    "S23_list_seeds": lambda t: list_seeds(t("links").select(F.col("to_url").alias("url"), F.col("id").alias("position"))),
}
