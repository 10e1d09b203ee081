"""Operators on recorded API answers and stored headers, and every analyzer's rows under its display titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.speed import header, headers_of, psi_metrics
from .analyzers import COLUMNS, SHOWN

Tables = Callable[[str], DataFrame]


def pagespeed(answers: DataFrame) -> DataFrame:
    """The pagespeed table of a crawl. answers: url_id, url, status_code, body; those with an error measure nothing."""
    m = answers.select("url_id", "url", psi_metrics(F.col("status_code"), F.col("body")).alias("m")).where("m.error = ''")
    return m.select("url_id", "url", *(f"m.{c}" for c in ("score", "lcp_ms", "cls", "inp_ms", "fcp_ms", "ttfb_ms")))


def _psi(t: Tables) -> DataFrame:
    return t("psi_answers").select("url_id", psi_metrics(F.col("status_code"), F.col("body")).alias("m")).select("url_id", "m.*")


def _psi_table(t: Tables) -> DataFrame:
    return pagespeed(t("psi_answers"))


def _header_maps(t: Tables) -> DataFrame:
    h = t("K03_append_fetches").withColumn("headers", headers_of(F.col("headers_json")))
    return h.select("id", F.size("headers").cast("long").alias("n_headers"), header(F.col("headers"), "X-Robots-Tag").alias("x_robots"), header(F.col("headers"), "x-robots-tag").alias("other_case"), header(F.col("headers"), "Content-Type").alias("content_type"))


def _detail_headers(t: Tables) -> DataFrame:
    """The headers of each page's latest fetch, a row for each."""
    latest = t("latest_fetch").select("id", "url_id").join(t("K03_append_fetches").select("id", "headers_json"), "id")
    rows = latest.select("url_id", F.explode(headers_of(F.col("headers_json"))).alias("name", "values"))
    return rows.select("url_id", "name", F.array_join("values", ", ").alias("value"))


def _shown(analyzer: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t(SHOWN.get(analyzer, analyzer)).select(*(F.col(key).alias(title) for title, key in COLUMNS[analyzer].items()))


MEASURED: dict[str, Callable[[Tables], DataFrame]] = {"S20_psi_metrics": _psi, "D15_pagespeed_table": _psi_table, "D14_header_maps": _header_maps, "J14_url_detail_headers": _detail_headers} | {"K10_shown_titles": _shown("page_titles")} | {f"K10_shown_{a}": _shown(a) for a in COLUMNS}
