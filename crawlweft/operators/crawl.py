"""Crawl control and graph walks: loops over DataFrames, and folds over a key's events in order.

A fold is one sorted pass: events are dealt out by key, sorted, and read batch by batch with the state carried along, so
a key of any length needs no more memory than a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

Tables = Callable[[str], DataFrame]


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, max_nodes: int | None = None) -> DataFrame:
    """(id, depth) of all nodes within max_depth of the seeds (id), at most max_nodes of them by depth, then id. edges: source, target.

    One join a level, against the nodes of the level before; visited nodes are checkpointed, so that lineage stays short.
    """
    level = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    if max_nodes is not None:
        level = level.orderBy("id").limit(max_nodes)
    seen = level = level.checkpoint()
    for depth in range(1, max_depth + 1):
        found = edges.join(level, edges["source"] == level["id"]).select(F.col("target").alias("id")).where("id is not null").distinct()
        level = found.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        if max_nodes is not None:
            level = level.orderBy("id").limit(max(max_nodes - seen.count(), 0))
        level = level.checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level).checkpoint()
    return seen


def bfs_subgraph(t: Tables, root: int = 0, depth: int = 3) -> DataFrame:
    """Nodes within `depth` edges of a page."""
    ensure_checkpoints(t("urls").sparkSession)
    reached = bfs(t("G27_edges").select("source", "target"), t("urls").where(F.col("id") == root).select("id"), depth)
    return reached.join(t("urls").select("id", "url"), "id").select("id", F.col("depth").alias("d"), "url")


def crawl_levels(t: Tables, max_depth: int = 4, max_urls: int = 120) -> DataFrame:
    """What a crawl from the pages of depth 0 takes up: every address once, up to a depth and a number."""
    ensure_checkpoints(t("urls").sparkSession)
    return bfs(t("links").select(F.col("from_url_id").alias("source"), F.col("to_url_id").alias("target")), t("urls").where("depth = 0").select("id"), max_depth, max_urls)


def ensure_checkpoints(spark: SparkSession) -> None:
    """The shared folder of spark.checkpoint.dir; one of our own only where executors are threads of the driver."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        at = f"file://{tempfile.mkdtemp(prefix='crawlweft-checkpoints-')}"
    spark.sparkContext.setCheckpointDir(at)


def folded(events: DataFrame, key: str, order: tuple[str, ...], start: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """Rows that step(state, event) gives for the events of each key in order; start() makes a key's first state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for event in batch.to_dict("records"):
                if state is None or event[key] != now:
                    now, state = event[key], start()
                out.append(step(state, event))
            if out:
                yield pd.DataFrame(out)

    return events.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


@dataclass
class TokenBucket:
    """`rate` tokens a second up to `burst`; an event at second t is allowed if a token is there."""

    rate: float = 0.5
    burst: float = 3.0
    tokens: float = field(default=3.0)
    last: float | None = None

    def allow(self, t: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.tokens + self.rate * (t - self.last), self.burst)
        self.last = t
        ok = self.tokens >= 1
        self.tokens -= ok
        return bool(ok)


@dataclass
class RateController:
    """Requests a second, by shares of errors and pending requests; fixed values of the rule."""

    low: float = 0.5
    high: float = 50.0
    rate: float = 25.0
    errors_over: float = 0.1
    pending_over: float = 1000.0
    slow_over_s: float = 5.0
    cooldown_s: float = 5.0
    ok: int = 0
    errors: int = 0
    changed: float | None = None

    def _set(self, factor: float, t: float) -> None:
        self.rate = min(max(self.rate * factor, self.low), self.high)
        self.changed = t

    def sample(self, t: float, ok: int, errors: int, pending: float, slowest_s: float) -> float:
        self.ok, self.errors = self.ok + ok, self.errors + errors
        if slowest_s > self.slow_over_s:
            self._set(0.7, t)
        elif self.changed is None or t - self.changed >= self.cooldown_s:
            total = self.ok + self.errors
            share = self.errors / total if total else 0.0
            if share > self.errors_over or pending > self.pending_over:
                self._set(0.7, t)
            elif share < self.errors_over / 2 and pending < self.pending_over / 2:
                self._set(1.1, t)
            else:
                self.changed = t
        return self.rate


def token_bucket(t: Tables) -> DataFrame:
    """Whether each fetch passes the bucket of its host; times are whole seconds."""
    events = t("fetches").join(t("urls").select(F.col("id").alias("url_id"), "host"), "url_id").select("host", "id", F.unix_timestamp(F.col("fetched_at").cast("timestamp")).cast("double").alias("t"))
    return folded(events, "host", ("t", "id"), TokenBucket, lambda bucket, e: {"id": e["id"], "allowed": bucket.allow(e["t"])}, "id long, allowed boolean")


def rate_samples(t: Tables) -> DataFrame:
    """A controller for each of eight workers, a sample for each hour of its fetches."""
    f = t("fetches").withColumn("worker", F.col("url_id") % 8).withColumn("t", F.floor(F.unix_timestamp(F.col("fetched_at").cast("timestamp")) / 3600).cast("double"))
    failed = F.col("status_code") >= 400
    return f.groupBy("worker", "t").agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("errors"), (F.sum("response_time_ms") / 10).alias("pending"), (F.max("response_time_ms") / 300).alias("slowest_s"))


def adaptive_rate(t: Tables) -> DataFrame:
    step = lambda c, e: {"worker": e["worker"], "t": e["t"], "rate": c.sample(e["t"], e["ok"], e["errors"], e["pending"], e["slowest_s"])}
    return folded(rate_samples(t), "worker", ("t",), RateController, step, "worker long, t double, rate double")


LAYOUT_NODES, ITERATIONS, SPRING = 1000, 50, 100.0


def positions(n: int, edges: list[tuple[int, int]]) -> list[tuple[float, float]]:
    """Nodes on a circle, then, ITERATIONS times, repulsion of all pairs in their order and attraction along edges; each step moves both ends at once."""
    x, y = ([n * 10 * f(2 * math.pi * i / n) for i in range(n)] for f in (math.cos, math.sin))

    def move(a: int, b: int, share: Callable[[float], float]) -> None:
        dx, dy = x[a] - x[b], y[a] - y[b]
        dist = max(math.sqrt(dx * dx + dy * dy), 1.0)
        by = share(dist) / dist
        x[a] += dx * by
        y[a] += dy * by
        x[b] -= dx * by
        y[b] -= dy * by

    for _ in range(ITERATIONS):
        for a in range(n):
            for b in range(a + 1, n):
                move(a, b, lambda d: SPRING * SPRING / d * 0.1)
        for a, b in edges:
            move(a, b, lambda d: -d * d / SPRING * 0.01)
    return list(zip(x, y, strict=True))


def layout(t: Tables, nodes: int = 60) -> DataFrame:
    """Places of the first nodes by id (LAYOUT_NODES at most, which is the operator's own bound) in one task."""
    first = t("N01_nodes").orderBy("url_id").limit(min(nodes, LAYOUT_NODES)).select(F.col("url_id").alias("source"), F.lit(None).cast("long").alias("target"))
    ids = first.select(F.col("source").alias("id"))
    edges = t("G27_edges").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids_ = np.sort(rows.source[rows.target.isna()].to_numpy())
        edges_ = rows[rows.target.notna()].sort_values(["source", "target"])
        at = {v: k for k, v in enumerate(ids_.tolist())}
        xy = positions(len(ids_), [(at[a], at[int(b)]) for a, b in zip(edges_.source, edges_.target, strict=True)])
        return pd.DataFrame({"url_id": ids_, "x": [p[0] for p in xy], "y": [p[1] for p in xy]})

    return first.unionByName(edges).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "url_id long, x double, y double")


STATEFUL: dict[str, Callable[[Tables], DataFrame]] = {"N02_bfs_subgraph": bfs_subgraph, "Z01_crawl_levels": crawl_levels, "Z06_token_bucket": token_bucket, "Z05_adaptive_rate": adaptive_rate, "N03_layout": layout}
