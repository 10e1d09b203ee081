"""Versions of a crawl's state on disk: save, list, load, prune, resume."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


class Checkpoints:
    """{folder}/v{number}/{table} as Parquet; a version counts once its marker is written, which is the last step of save()."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 5, every_s: float = 300.0) -> None:
        self.spark, self.folder, self.keep, self.every_s, self._last = spark, folder, keep, every_s, None
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    @property
    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs
        if not fs.exists(self._hadoop.Path(self.folder)):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(self._hadoop.Path(self.folder)))
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(self._path(f"{n}/_DONE")))

    def save(self, **tables: DataFrame) -> int:
        """All tables as the next version, then all but the newest `keep` go."""
        number = max(self.versions(), default=0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/v{number:06d}/{name}")
        self._fs.create(self._path(f"v{number:06d}/_DONE"), True).close()
        self._last = time.monotonic()
        for old in self.versions()[: -self.keep]:
            self.delete(old)
        return number

    def due(self) -> bool:
        return self._last is None or time.monotonic() - self._last >= self.every_s

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, by default the newest; empty without one."""
        version = version or max(self.versions(), default=0)
        if not version:
            return {}
        at = f"v{version:06d}"
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(at)) if s.isDirectory()]
        return {n: self.spark.read.parquet(f"{self.folder}/{at}/{n}") for n in names}

    def delete(self, version: int) -> None:
        self._fs.delete(self._path(f"v{version:06d}/_DONE"), False)
        self._fs.delete(self._path(f"v{version:06d}"), True)

    def clear(self) -> None:
        for v in self.versions():
            self.delete(v)
