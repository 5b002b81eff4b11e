"""Tables with one row per key: copy-on-write buckets behind a committed manifest.

Rows lie in buckets by a hash of their key.  An upsert rewrites the buckets
that its keys fall into and leaves the others where they are; a manifest then
names the version that holds each bucket.  Readers follow the newest manifest,
so a writer that fails before its commit leaves the old table as it was, and
what it wrote is overwritten by the next attempt.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


@dataclass
class Manifest:
    """Which version holds each bucket; ``batch`` is the last stream batch in it."""

    version: int
    columns: str
    key: str
    count: int
    buckets: dict[str, int]
    batch: int = -1


class KeyedTable:
    """The table below ``path``; ``key`` and ``buckets`` hold for a new one, a stored one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.count = spark, path, key, buckets
        now = self.manifest()
        if now:
            self.key, self.count = now.key, now.count

    # Files, through Hadoop's interface: the folder may lie on any shared store.

    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        where, fs = self._file("manifests")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """That of a version, by default of the newest; None without any."""
        versions = self._versions()
        if not versions:
            return None
        at = versions[-1] if version is None else version
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/{at}.json", wholetext=True).first().value))

    def _commit(self, new: Manifest) -> None:
        """Written aside and then renamed, which shows it whole or not at all; fails if another writer was first."""
        aside, fs = self._file(f"manifests/.{new.version}.tmp")
        final, _ = self._file(f"manifests/{new.version}.json")
        out = fs.create(aside, True)
        out.write(json.dumps(new.__dict__).encode())
        out.close()
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"version {new.version} of {self.path} was committed by another writer")

    # Rows

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if now is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(now, list(now.buckets))

    def _rows(self, now: Manifest, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.columns))
        paths = [f"{self.path}/data/{now.buckets[b]}/bucket={b}" for b in buckets if b in now.buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int = -1) -> Manifest | None:
        """Write the new version of the touched buckets and return its manifest, not yet committed; None if nothing changes."""
        now = self.manifest()
        if now is not None and 0 <= batch <= now.batch:
            return None  # a replayed batch that was committed
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.count)).cast("int")
        touched = [str(r.b) for r in incoming.select(bucket.alias("b")).distinct().collect()]
        version = 0 if now is None else now.version + 1
        if now is None:
            old, held = incoming.limit(0), {}
        else:
            old, held = self._rows(now, touched), now.buckets
        merged = merge(old, incoming)
        placed = merged.withColumn("bucket", bucket)
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{version}")
        return Manifest(version, merged.schema.json(), self.key, self.count, held | dict.fromkeys(touched, version), max(batch, now.batch if now else -1))

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: int = -1, keep: int = 2) -> None:
        """Merge ``incoming`` into the rows of the touched buckets; ``merge`` gets these rows and ``incoming``.

        A batch number that was committed before is skipped. Of the versions
        before the newest ``keep``, what no kept manifest names is deleted.
        """
        staged = self.stage(incoming, merge, batch)
        if staged is not None:
            self._commit(staged)
            self.expire(keep)

    def expire(self, keep: int = 2) -> None:
        """Delete the manifests before the newest ``keep`` and the bucket versions that only they name."""
        versions = self._versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        named = {(v, b) for m in kept for b, v in m.buckets.items()}
        for old in versions[:-keep]:
            gone = self.manifest(old)
            for b, v in gone.buckets.items():
                if (v, b) not in named:
                    where, fs = self._file(f"data/{v}/bucket={b}")
                    fs.delete(where, True)
            where, fs = self._file(f"manifests/{old}.json")
            fs.delete(where, False)


def replace(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Incoming rows, one per key, take the place of stored ones."""
    return lambda old, new: old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)
