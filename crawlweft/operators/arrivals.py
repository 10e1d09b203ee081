"""Operators that store a crawl as it arrives: two arrivals one after the other, then the table as it stands."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import Store, headers_json
from .crawl import ensure_checkpoints

Tables = Callable[[str], DataFrame]


def scratch_store(spark: SparkSession) -> Store:
    """A store in the shared folder."""
    ensure_checkpoints(spark)
    return Store(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}", buckets=8)


def _day(k: int) -> Column:
    return F.lit(f"2024-01-0{k} 00:00:00").cast("timestamp")


def upserted_urls(t: Tables) -> DataFrame:
    """Even pages, then those of which every third, found one level deeper: what is known keeps its row and is seen again."""
    urls, store = t("urls"), scratch_store(t("urls").sparkSession)
    store.merge("urls", urls.where("id % 2 = 0").withColumns({"first_seen": _day(1), "last_seen": _day(1)}), ["id"])
    store.merge("urls", urls.where("id % 3 = 0").withColumns({"depth": F.col("depth") + 1, "first_seen": _day(2), "last_seen": _day(2)}), ["id"])
    return store.read("urls").select("id", "url", "normalized_url", "depth", "crawl_status", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


def appended_fetches(t: Tables) -> DataFrame:
    """Fetches in two arrivals, each with its headers as JSON."""
    fetches, store = t("fetches"), scratch_store(t("fetches").sparkSession)
    header = lambda name, c: F.when(F.col(c) != "", F.struct(F.lit(name).alias("key"), F.array(c).alias("value")))
    entries = F.filter(F.array(header("X-Robots-Tag", "x_robots"), header("Content-Type", "content_type")), lambda e: e.isNotNull())
    rows = fetches.withColumn("headers", F.map_from_entries(entries)).withColumn("headers_json", headers_json("headers")).drop("headers")
    with store.staged("fetches", rows) as found:
        store.append("fetches", found.where("id % 2 = 1"))
        store.append("fetches", found.where("id % 2 = 0"))
    return store.read("fetches").select("id", "url_id", "status_code", "headers_json")


def upserted_features(t: Tables) -> DataFrame:
    """All pages' features, then new ones of every third page and first ones of pages that had none: every column of the later row counts, nulls too."""
    features, store = t("html_features"), scratch_store(t("urls").sparkSession)
    with store.staged("html_features", features) as found:
        store.merge("html_features", found)
        again = found.where("url_id % 3 = 0").withColumns({"title": F.concat("title", F.lit(" (new)")), "word_count": F.lit(None).cast("int")})
        store.merge("html_features", again.unionByName(t("urls").where("id % 20 = 19").select(F.col("id").alias("url_id"), F.lit("first").alias("title"), F.lit(1).alias("word_count")), allowMissingColumns=True))
    return store.read("html_features").select("url_id", "title", "word_count", "is_indexable")


def appended_links(t: Tables) -> DataFrame:
    """Batches of links, each in one version: what a reader of each version sees."""
    links, store = t("links"), scratch_store(t("links").sparkSession)
    with store.staged("links", links) as found:
        versions = [store.append("links", found.where(F.col("from_url_id") % 3 == k)) for k in range(3)]
    seen = [store.read("links", v).select(F.lit(v).cast("long").alias("version"), "id", "from_url_id", "to_url") for v in versions]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


def appended_issues(t: Tables) -> DataFrame:
    """Issues by category as analyzers find them in one pass; equal ones stay apart."""
    issues, store = t("issues"), scratch_store(t("urls").sparkSession)
    with store.staged("issues", issues) as found:
        store.append("issues", found.where("category <> 'response'"))
        store.append("issues", found.where("category = 'response'"))
    return store.read("issues").groupBy("url_id", "issue_code").agg(F.count("*").alias("n"))


def sessions(t: Tables) -> DataFrame:
    """A session for each host: created, its progress, and completed where no page is left."""
    urls, store = t("urls"), scratch_store(t("urls").sparkSession)
    hosts = urls.groupBy(F.col("host").alias("id")).agg(F.min("url").alias("start_url"), F.count_if(F.col("crawl_status") == "crawled").alias("crawled_urls"), F.count_if(F.col("crawl_status") == "failed").alias("failed_urls"), F.count_if(F.col("crawl_status") == "pending").alias("left"))
    store.merge("sessions", hosts.select("id", "start_url", F.lit("running").alias("status"), F.lit("{}").alias("config_json"), F.lit(0).alias("crawled_urls"), F.lit(0).alias("failed_urls"), _day(1).alias("started_at")))
    store.merge("sessions", hosts.select("id", "crawled_urls", "failed_urls", _day(2).alias("last_checkpoint")), insert=False, take=("crawled_urls", "failed_urls", "last_checkpoint"))
    store.merge("sessions", hosts.where("left = 0").select("id", F.lit("completed").alias("status"), _day(3).alias("completed_at")), insert=False, take=("status", "completed_at"))
    return store.read("sessions").select("id", "start_url", "status", "crawled_urls", "failed_urls", F.date_format("last_checkpoint", "yyyy-MM-dd").alias("last_checkpoint"), F.date_format("completed_at", "yyyy-MM-dd").alias("completed_at"))


ARRIVALS: dict[str, Callable[[Tables], DataFrame]] = {
    "K01_upsert_urls": upserted_urls, "K03_append_fetches": appended_fetches, "K04_upsert_features": upserted_features, "K05_append_links": appended_links, "K06_append_issues": appended_issues, "K09_sessions": sessions,
}
