"""Sharding by size-tiered compaction; DataFrame readers and writers only.

append() writes arrivals as small immutable shards and commits a manifest version that lists them; compact() groups
shards into tiers of similar size, merges every tier of at least FANOUT shards into files of about TARGET bytes (a scan
of that tier's files, coalesced: no shuffle), and commits the next version. A version is a folder that appears by one
atomic rename which fails if it exists: of two writers one wins and the other gets an error, its files unreferenced.
Shards are never changed. expire() drops old versions, then the shards that only they listed; files that no version lists
may be those of a writer about to commit and go only when they are older than `grace` seconds.

Defined cases: an empty table commits a version without shards and reads as no rows; nulls, repeated rows and any extra
columns are stored as they are; a row larger than a shard is a shard; where the input has a column _shard or _shard_bytes,
read() puts underscores before its own until they differ. The driver holds the list of shards (one path for each TARGET
bytes, which reading them needs there), never rows.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .runtime import scratch_path

SMALL, TARGET, FANOUT, GRACE = 4 << 20, 64 << 20, 4, 24 * 3600
MANIFEST = "shard string, tier int, rows long, bytes long"


def _none(spark: SparkSession, schema: str | StructType) -> DataFrame:
    """No rows of a schema; a local list would pass a Python worker."""
    fields = schema.fields if isinstance(schema, StructType) else StructType.fromDDL(schema).fields
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


class Store:
    """A folder of shards and manifests: {root}/shards/<batch>/part-*.parquet and {root}/manifests/v%08d."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or scratch_path(spark, "store")
        self._hadoop, self._conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        at = self._path("manifests")
        fs = at.getFileSystem(self._conf)
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v")) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> DataFrame:
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            return _none(self.spark, MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version:08d}")

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Writes the manifest aside and renames it to its version; raises if another writer has that version."""
        aside = f"manifests/.aside-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(f"{self.root}/{aside}")
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        source, target = self._path(aside), self._path(f"manifests/v{version:08d}")
        plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, plain)
        return version

    def _written(self, batch: str) -> DataFrame:
        """The manifest rows of a batch's files."""
        files = self.spark.read.parquet(f"{self.root}/shards/{batch}").groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.floor(F.log(float(FANOUT), F.greatest(F.col("bytes"), F.lit(1)) / F.lit(SMALL / FANOUT)))).cast("int")
        return files.select(F.concat(F.lit(f"{batch}/"), F.element_at(F.split("file", "/"), -1)).alias("shard"), tier.alias("tier"), "rows", "bytes")

    def append(self, docs: DataFrame) -> int:
        """New shards of about SMALL bytes of text, in the layout of the input's own partitions; returns the version."""
        version = max(self.versions(), default=0) + 1
        batch = f"a-{uuid.uuid4().hex}"
        text = F.sum(F.octet_length("text").cast("long")) if "text" in docs.columns else F.lit(None)
        sized = docs.agg(F.count("*").alias("n"), text.alias("bytes")).first()
        per = max(1, int(sized.n * SMALL // max(sized.bytes or 0, 1))) if "text" in docs.columns else 10_000
        docs.write.option("maxRecordsPerFile", per).option("compression", "zstd").parquet(f"{self.root}/shards/{batch}")
        return self._commit(self.manifest().unionByName(self._written(batch)), version)

    def compact(self) -> int:
        """Merges each tier of at least FANOUT shards below half of TARGET; returns the newest version."""
        version = max(self.versions(), default=0)
        small = self.manifest().where(F.col("bytes") < TARGET // 2)
        tiers = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= FANOUT).orderBy("tier").collect()
        merged = F.col("tier").isin([t.tier for t in tiers]) & (F.col("bytes") < TARGET // 2)
        after = self.manifest().where(~merged)
        for t in tiers:
            of = [r.shard for r in small.where(F.col("tier") == t.tier).orderBy("shard").select("shard").toLocalIterator()]
            batch = f"m-{uuid.uuid4().hex}"
            rows = self.spark.read.parquet(*(f"{self.root}/shards/{s}" for s in of))
            rows.coalesce(max(1, round(t.bytes / TARGET))).write.option("compression", "zstd").parquet(f"{self.root}/shards/{batch}")
            after = after.unionByName(self._written(batch))
        return self._commit(after, version + 1) if tiers else version

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """All rows of a version, then _shard and _shard_bytes."""
        shards = self.manifest(version)
        names = [r.shard for r in shards.where("rows > 0").select("shard").toLocalIterator()]
        rows = self.spark.read.parquet(*(f"{self.root}/shards/{s}" for s in names)) if names else _none(self.spark, schema or "doc_id long")
        mark = "_shard"
        while {mark, f"{mark}_bytes"} & set(rows.columns):
            mark = f"_{mark}"
        if not names:
            return rows.select("*", F.lit(None).cast("string").alias(mark), F.lit(None).cast("long").alias(f"{mark}_bytes"))
        at = F.split(F.col("_metadata.file_path"), "/")
        return rows.select("*", F.concat_ws("/", F.element_at(at, -2), F.element_at(at, -1)).alias(mark), F.col("_metadata.file_size").alias(f"{mark}_bytes"))

    def expire(self, keep: int = 1, grace: float = GRACE) -> None:
        """Drops all but the newest `keep` versions and the shards that only they listed, then unlisted files older than `grace` seconds."""
        versions = self.versions()
        old, new = versions[: len(versions) - keep], versions[len(versions) - keep :]
        listed = lambda of: {r.shard for v in of for r in self.manifest(v).select("shard").toLocalIterator()}
        kept = listed(new)
        gone = listed(old) - kept
        top = self._path("shards")
        fs = top.getFileSystem(self._conf)
        for v in old:
            fs.delete(self._path(f"manifests/v{v:08d}"), True)
        for batch in fs.listStatus(top) if fs.exists(top) else []:
            for f in fs.listStatus(batch.getPath()):
                name = f"{batch.getPath().getName()}/{f.getPath().getName()}"
                late = time.time() - f.getModificationTime() / 1000 > grace
                if "/part-" in name and name not in kept and (name in gone or late):
                    fs.delete(f.getPath(), False)
