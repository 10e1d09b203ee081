"""A stored crawl that arrivals are appended to and merged into.

A table is kept in hash buckets of its key (tables without one: in buckets of the tasks that wrote them). A merge rewrites the buckets that its rows fall into, and no others; an append adds files. What
a version of a table consists of is one small file that lists folders and buckets; it is written last, under a name that only
one writer can create, so a reader sees a version whole or not at all, and of two writers that start from one version the second starts anew.
Old versions can be read until expire() drops them. The driver handles bucket numbers, never rows.

Defined cases: rows of one arrival with equal keys count one after the other, in the order given; null keys are keys like others; columns that the
table lacks are an error; an empty arrival makes a version like any other. Exclusive creation has to be atomic on the file system
(it is on HDFS and its like; object stores need a committer that provides it).
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Tables of a stored crawl (fixed values): columns, key, and the columns in which a later row of a key counts; appended tables have no key.
TABLES = {
    "urls": ("id long, url string, normalized_url string, host string, path string, discovered_from long, depth int, crawl_status string, is_internal boolean, in_sitemap boolean, first_seen timestamp, last_seen timestamp", ("normalized_url",), ("last_seen",)),
    "fetches": ("id long, url_id long, status_code int, content_type string, response_time_ms long, fetched_at timestamp, x_robots string, headers_json string", (), ()),
    "html_features": ("url_id long, title string, meta_description string, meta_keywords string, meta_robots string, canonical string, h1_count int, h1_first string, h2_count int, h2_first string, content_hash string, word_count int, language string, is_indexable boolean", ("url_id",), None),
    "links": ("id long, from_url_id long, to_url_id long, to_url string, anchor_text string, is_internal boolean, is_follow boolean, rel string", (), ()),
    "resources": ("id long, url string, resource_type string, status_code int, size long, alt string, width int, height int, is_async boolean, is_defer boolean, mime_type string", ("url",), ("status_code", "size")),
    "page_resources": ("resource_id long, url_id long", ("url_id", "resource_id"), ()),
    "issues": ("url_id long, issue_code string, issue_type string, severity string, category string", (), ()),
    "sessions": ("id string, start_url string, status string, config_json string, crawled_urls long, failed_urls long, started_at timestamp, last_checkpoint timestamp, completed_at timestamp", ("id",), ("status", "crawled_urls", "failed_urls", "last_checkpoint", "completed_at")),
}


class Conflict(RuntimeError):
    """Another writer has committed the version in the meantime."""


def headers_json(headers: str) -> object:
    """A map column of header values as JSON with its names sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(headers))))


class Store:
    """{folder}/{table}/v{number}.json and {folder}/{table}/data/{part}/bucket={number}/. buckets: a table's, fixed when it is first written."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, files: int = 1, tries: int = 5) -> None:
        self.spark, self.folder, self.buckets, self.files, self.tries = spark, folder.rstrip("/"), buckets, files, tries
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        path = self._hadoop.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        path, fs = self._path(table)
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path) if s.isFile())
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, table: str, version: int | None = None) -> dict:
        """{"version", "buckets", "parts": {part: [bucket, ...]}} of a version, by default the newest."""
        found = self.versions(table)
        if version is None and not found:
            return {"version": 0, "buckets": self.buckets, "parts": {}}
        path, _ = self._path(f"{table}/v{version or found[-1]:08d}.json")
        return json.loads("".join(r.value for r in self.spark.read.text(path.toString()).collect()))

    def _commit(self, table: str, manifest: dict) -> int:
        path, fs = self._path(f"{table}/v{manifest['version']:08d}.json")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as taken:
            if fs.exists(path):
                raise Conflict(f"{table} has a version {manifest['version']} already") from taken
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return manifest["version"]

    def _rows(self, table: str, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromDDL(TABLES[table][0])
        paths = [f"{self.folder}/{table}/data/{part}/bucket={b}" for part, of in manifest["parts"].items() for b in of if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._rows(table, self._manifest(table, version))

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        fields = StructType.fromDDL(TABLES[table][0]).fields
        if extra := [c for c in rows.columns if c not in {f.name for f in fields}]:
            raise ValueError(f"{table} has no columns {extra}")
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    @contextlib.contextmanager
    def staged(self, table: str, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows, computed once and kept beside the table for what reads them several times inside."""
        name = f"staged-{uuid.uuid4().hex}"
        path, _ = self._path(f"{table}/data/{name}")
        rows.write.parquet(path.toString())
        try:
            yield self.spark.read.schema(rows.schema).parquet(path.toString())
        finally:
            self._drop(table, name)

    def _written(self, table: str, rows: DataFrame) -> tuple[str, list[int]]:
        """The part that holds the rows (with their bucket), and its buckets."""
        part = uuid.uuid4().hex
        path, fs = self._path(f"{table}/data/{part}")
        rows.write.partitionBy("bucket").parquet(path.toString())
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return part, sorted(int(n.partition("=")[2]) for n in names if n.startswith("bucket="))

    def append(self, table: str, rows: DataFrame) -> int:
        """Adds all rows in one version. Appended rows are looked up by no key: every task's go into one bucket, unshuffled."""
        bucket = F.spark_partition_id() % self._manifest(table)["buckets"]
        part, filled = self._written(table, self._shaped(table, rows).withColumn("bucket", bucket))
        for _ in range(self.tries):
            old = self._manifest(table)
            try:
                # what others have committed in the meantime stays beside these rows
                return self._commit(table, {**old, "version": old["version"] + 1, "parts": old["parts"] | {part: filled}})
            except Conflict:
                continue
        raise Conflict(f"{table}: {self.tries} other writers came first")

    def merge(self, table: str, rows: DataFrame, order: Sequence[str] = (), *, insert: bool = True, take: Sequence[str] | None = None) -> int:
        """Inserts rows of new keys (unless insert is False); of a key that is there, the columns that a later row counts in are taken.

        order: columns by which rows of one key come one after the other. take: other columns than the table's own rule.
        Rows that are there and rows that arrive meet in one shuffle by bucket, in which they are written too. An arrival that meets none is
        computed once; one that does is kept beside the table first, since its buckets have to be known.
        """
        ddl, keys, rule = TABLES[table]
        names = [f.name for f in StructType.fromDDL(ddl).fields]
        later = set(take if take is not None else rule if rule is not None else [c for c in names if c not in keys])
        shaped = self._shaped(table, rows).withColumn("_by", F.struct(*order) if order else F.lit(0))
        with contextlib.ExitStack() as kept_for:
            known = None
            for _ in range(self.tries):
                old = self._manifest(table)
                gone: set[int] = set()
                if old["parts"]:
                    known = known if known is not None else kept_for.enter_context(self.staged(table, shaped))
                    gone = {r.b for r in known.select(self._bucket(keys, old).alias("b")).distinct().collect()}
                arrived = (known if known is not None else shaped).withColumn("_new", F.lit(1))
                met = arrived.unionByName(self._rows(table, old, gone).withColumns({"_new": F.lit(0), "_by": F.lit(None).cast(arrived.schema["_by"].dataType)}))
                part, filled = self._written(table, self._merged(met, keys, later, names, old, insert))
                if not filled:
                    self._drop(table, part)
                kept = {p: left for p, of in old["parts"].items() if (left := [b for b in of if b not in gone])}
                try:
                    return self._commit(table, {**old, "version": old["version"] + 1, "parts": kept | ({part: filled} if filled else {})})
                except Conflict:
                    self._drop(table, part)
        raise Conflict(f"{table}: {self.tries} other writers came first")

    @staticmethod
    def _bucket(keys: Sequence[str], manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(manifest["buckets"])).cast("int")

    def _merged(self, met: DataFrame, keys: Sequence[str], later: set[str], names: Sequence[str], manifest: dict, insert: bool) -> DataFrame:
        """Rows of the table (_new 0) and arrived ones (_new 1, in the order of _by) as one row a key, dealt by bucket."""
        place = [self._bucket(keys, manifest).alias("bucket"), F.pmod(F.shiftright(F.xxhash64(*keys), 32), F.lit(self.files)).alias("_file")]
        dealt = met.select("*", *place).repartition("bucket", "_file")
        turn = F.struct("_new", "_by")
        ends = {"first": (F.min_by, [c for c in names if c not in later and c not in keys]), "last": (F.max_by, [c for c in names if c in later])}
        picked = [pick(F.struct(*of), turn).alias(end) for end, (pick, of) in ends.items() if of]
        # dealt by two of the columns that it groups by, so nothing is shuffled again
        one = dealt.groupBy("bucket", "_file", *keys).agg(F.min("_new").alias("_new"), *picked)
        if not insert:
            one = one.where("_new = 0")
        end = lambda c: c if c in keys else F.col(f"{'last' if c in later else 'first'}.{c}").alias(c)
        return one.select(*map(end, names), "bucket")

    def _drop(self, table: str, part: str) -> None:
        path, fs = self._path(f"{table}/data/{part}")
        fs.delete(path, True)

    def expire(self, table: str, keep: int = 1) -> None:
        """Drops all versions but the newest `keep`, and the parts that only they have. Parts of no version yet are left alone."""
        found = self.versions(table)
        old, new = ([self._manifest(table, v) for v in some] for some in (found[:-keep], found[-keep:]))
        used = {p for m in new for p in m["parts"]}
        for m in old:
            path, fs = self._path(f"{table}/v{m['version']:08d}.json")
            fs.delete(path, False)
        for part in {p for m in old for p in m["parts"]} - used:
            self._drop(table, part)
