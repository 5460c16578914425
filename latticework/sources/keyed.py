"""Tables whose rows are replaced and deleted by key: merge on read, compaction of touched buckets only.

A row's key decides its bucket. A write adds one folder per bucket that it touches, with new rows and tombstones, and at last a
version: which folders, in which order, make up each bucket. Folders are never changed, so readers of a version aren't disturbed, and a
write that broke off is no version and is not seen. A reader takes buckets of one folder as they are; in others the row of the
latest folder counts for each key. When a bucket has gathered more than ``most`` folders, the next write gives it one new folder
in their place; other buckets' files stay as they are.

The number of buckets is fixed when a table is made (``BUCKETS``), and so bounds a version's size; more for larger tables. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, MOST = 64, 4
VERSION = "version bigint, buckets int, folders array<struct<bucket: int, folder: string, whole: boolean>>"


class KeyedTable:
    """A table of rows with unique keys below ``path``; ``schema`` is that of its rows, ``key`` names its key columns (a null is a value like others)."""

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str], buckets: int = BUCKETS, most: int = MOST) -> None:
        self.spark, self.path, self.key, self.most = spark, path, key, most
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names
        self.version, self.buckets, self.folders = self._latest(buckets)

    def _latest(self, buckets: int) -> tuple[int, int, dict[int, list[tuple[str, bool]]]]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        if not root.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(root):
            return 0, buckets, {}
        # a version is one file of one row, which is there whole or not at all
        row = self.spark.read.schema(VERSION).parquet(f"{self.path}/versions").orderBy(F.desc("version")).first()
        if row is None:
            return 0, buckets, {}
        folders: dict[int, list[tuple[str, bool]]] = {}
        for x in row.folders:
            folders.setdefault(x.bucket, []).append((x.folder, x.whole))
        return row.version, row.buckets, folders

    def bucket(self, columns: list[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(F.col(c) for c in columns or self.key)), F.lit(self.buckets)).cast("int")

    def _commit(self, folders: dict[int, list[tuple[str, bool]]]) -> None:
        row = (self.version + 1, self.buckets, [(b, f, w) for b in sorted(folders) for f, w in folders[b]])
        self.spark.createDataFrame([row], VERSION).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        self.version, self.folders = self.version + 1, folders

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows (with bucket_, gone_) in a new folder, and the buckets it has."""
        name = uuid.uuid4().hex
        rows.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{name}")
        return name, [r.bucket_ for r in self._read(name).select("bucket_").distinct().collect()]

    def _read(self, name: str) -> DataFrame:
        at = f"{self.path}/data/{name}"
        return self.spark.read.option("basePath", at).schema(self._stored()).parquet(at)

    def _stored(self):
        return self.spark.createDataFrame([], self.schema).withColumns({"gone_": F.lit(True), "bucket_": F.lit(0)}).schema

    def _rows(self, buckets: set[int] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of buckets of one whole folder, and those of other buckets with their folders' order."""
        plain: dict[str, list[int]] = {}
        layered: dict[tuple[str, int], list[int]] = {}
        for b, folders in self.folders.items():
            if buckets is None or b in buckets:
                if len(folders) == 1 and folders[0][1]:
                    plain.setdefault(folders[0][0], []).append(b)
                else:
                    for i, (f, _) in enumerate(folders):
                        layered.setdefault((f, i), []).append(b)
        union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
        return (union([self._read(f).filter(F.col("bucket_").isin(bs)) for f, bs in sorted(plain.items())]),
                union([self._read(f).filter(F.col("bucket_").isin(bs)).withColumn("order_", F.lit(i)) for (f, i), bs in sorted(layered.items())]))

    def _merged(self, layered: DataFrame) -> DataFrame:
        kept = [F.col(f"x.{c}").alias(c) for c in self.columns if c not in self.key]
        rest = F.struct("gone_", *(c for c in self.columns if c not in self.key))
        latest = layered.groupBy(*self.key, "bucket_").agg(F.max_by(rest, "order_").alias("x")).filter("not x.gone_")
        return latest.select(*self.key, "bucket_", *kept)

    def read(self, near: DataFrame | None = None) -> DataFrame:
        """All rows; ``near``: only those of buckets that its keys fall into, found by the folders' names."""
        wanted = None if near is None else {r[0] for r in near.select(self.bucket()).distinct().collect()}  # no more than there are buckets
        plain, layered = self._rows(wanted)
        parts = [p.select(self.columns) for p in (plain, layered and self._merged(layered)) if p is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Replace or add ``rows`` (one for each key) and delete the keys of ``gone``; a key in both stays deleted."""
        parts = []
        if rows is not None:
            new = rows.select(*self.columns)
            if gone is not None:
                ends = [F.col(f"g.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key]
                new = new.alias("n").join(gone.select(self.key).distinct().alias("g"), reduce(Column.__and__, ends), "left_anti")
            parts.append(new.withColumn("gone_", F.lit(False)))
        if gone is not None:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.key]
            parts.append(gone.select(self.key).distinct().select(*self.key, *none).select(*self.columns, F.lit(True).alias("gone_")))
        if not parts:
            return
        name, touched = self._write(reduce(DataFrame.unionByName, parts).withColumn("bucket_", self.bucket()))
        folders = {b: list(f) for b, f in self.folders.items()}
        for b in touched:
            folders.setdefault(b, []).append((name, False))
        if any(len(folders[b]) > self.most for b in touched):
            self.folders, full = folders, {b for b in touched if len(folders[b]) > self.most}
            name, left = self._write(self._merged(self._rows(full)[1]).select(*self.columns, F.lit(False).alias("gone_"), "bucket_"))
            folders = {b: f for b, f in folders.items() if b not in full} | {b: [(name, True)] for b in left}
        self._commit(folders)

    def replace_set(self, wanted: DataFrame) -> None:
        """Make the table hold ``wanted`` and nothing else: rows that differ are written, keys that are gone get tombstones, equal rows stay untouched."""
        old = self.read()
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"w.{c}")) for c in self.columns]
        new = wanted.select(self.columns).alias("w").join(old.alias("o"), reduce(Column.__and__, same), "left_anti")
        keys = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.key])
        self.write(new, old.select(self.key).alias("o").join(wanted.select(self.key).alias("w"), keys, "left_anti"))
