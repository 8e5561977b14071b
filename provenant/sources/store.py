"""A snapshot store on plain Parquet.

Every publish writes new table folders and then one manifest that names them
all; the manifest with the highest number is the state.  Readers see a whole
snapshot or the one before, and a publish whose guards find a violation leaves
nothing behind but unused folders.  One writer at a time is assumed.

A table may be kept in buckets by a key: then a publish writes only the buckets
that the change touches, and the manifest names the folders of all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table's folder, or its folders by bucket.
Place = str | dict[str, str]
Guard = Callable[[dict[str, DataFrame]], DataFrame]


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._read: dict[str, DataFrame] = {}  # folders never change, so each is looked into once
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._path(f"{self.root}/manifests"))
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in found if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, Place]:
        """Table folders of a version, the newest by default."""
        known = self.versions()
        if not known:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{version or known[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._load(self.manifest(version)[table])

    def _load(self, place: Place) -> DataFrame:
        if not isinstance(place, str):
            return self.spark.read.parquet(*(f"{self.root}/{place[k]}" for k in sorted(place)))
        if place not in self._read:
            self._read[place] = self.spark.read.parquet(f"{self.root}/{place}")
        return self._read[place]

    def tables(self) -> dict[str, DataFrame]:
        return {n: self._load(p) for n, p in self.manifest().items()}

    @staticmethod
    def bucket_of(key: str, buckets: int):
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def touched(self, table: str, rows: DataFrame, key: str, buckets: int) -> tuple[list[int], DataFrame | None]:
        """The buckets that some rows fall in, and what the table holds there now (None: nothing)."""
        asked = sorted(r[0] for r in rows.select(self.bucket_of(key, buckets)).distinct().collect())  # as many as buckets
        place = self.manifest().get(table)
        held = [place[str(b)] for b in asked if str(b) in place] if isinstance(place, dict) else []
        return asked, self._load({str(i): f for i, f in enumerate(held)}) if held else None

    def publish(self, changes: Mapping[str, DataFrame], guards: Mapping[str, Guard] | None = None, *, buckets: Mapping[str, tuple[str, int, list[int]]] | None = None) -> int:
        """Write changed tables and make them the state; a broken guard refuses them all.

        ``buckets`` tells of a bucketed table its key, the number of buckets, and those
        that the change rewrites; its rows are only theirs.
        """
        current = self.manifest()
        written = dict(current)
        for name, rows in changes.items():
            folder = f"tables/{name}/{uuid.uuid4().hex}"
            if buckets and name in buckets:
                key, number, asked = buckets[name]
                rows.withColumn("_bucket", self.bucket_of(key, number)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
                old = current.get(name, {})
                kept = dict(old) if isinstance(old, dict) else {}
                filled = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))}
                for b in asked:
                    kept.pop(str(b), None)
                    if f"_bucket={b}" in filled:
                        kept[str(b)] = f"{folder}/_bucket={b}"
                written[name] = kept
            else:
                rows.write.parquet(f"{self.root}/{folder}")
                written[name] = folder
        after = {n: self._load(p) for n, p in written.items() if p}
        for name, guard in (guards or {}).items():
            if not guard(after).isEmpty():
                raise ValueError(f"guard {name} refuses the snapshot")
        version = (self.versions() or [0])[-1] + 1
        draft, final = (self._path(f"{self.root}/manifests/{n}") for n in (f".{uuid.uuid4().hex}", f"{version}.json"))
        out = self._fs.create(draft, False)
        out.write(json.dumps(written, sort_keys=True).encode())
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError("another writer has published this version")
        return version
