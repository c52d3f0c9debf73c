"""Upserts that touch only changed data.

Rows are kept in hash buckets of their key, each bucket a partition of a catalog table with a
folder of its own. An upsert reads the buckets that the new rows fall into, writes their merged
rows to new folders, and then switches each bucket's location: other buckets are neither read nor
written, and readers see a bucket's old or new rows, never a gap. A repeated upsert gives the same
rows, so one that was interrupted is simply run again. Folders that were switched away stay until
``drop_old`` is called, as readers may still be in them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import delete_path, list_dir

BUCKETS = 64
BUCKET = "key_bucket"


class KeyedTable:
    """A table of one row a key: the one with the greatest ``order``. Rows without key are left out."""

    def __init__(self, spark: SparkSession, name: str, base: str, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.name, self.base, self.key, self.order, self.buckets = spark, name, base, key, order, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col(self.key).isNotNull()).withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop(BUCKET)

    def _stored(self) -> list[int]:
        return [int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]  # at most ``buckets`` rows

    def _locations(self) -> dict[int, str]:
        """Bucket → folder, as the catalog has it."""
        out = {}
        for b in self._stored():
            about = self.spark.sql(f"DESCRIBE FORMATTED {self.name} PARTITION ({BUCKET}={b})").where("col_name = 'Location'").first()
            out[b] = about["data_type"]
        return out

    def upsert(self, new: DataFrame) -> list[int]:
        """Insert or replace by key; returns the buckets that were rewritten."""
        from tidemark.operators.windows import top1_per_group

        exists = self.spark.catalog.tableExists(self.name)
        new = self._bucketed(new)
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most ``buckets``
        merged = new
        if exists:
            old = self.spark.table(self.name).where(F.col(BUCKET).isin(touched))
            merged = old.unionByName(new)
        merged = top1_per_group(merged, [BUCKET, self.key], [(self.order, True)])
        if not exists:
            cols = ", ".join(f"`{c}` {t}" for c, t in merged.drop(BUCKET).dtypes)
            self.spark.sql(f"CREATE TABLE {self.name} ({cols}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) LOCATION '{self.base}/table'")
        folder = os.path.join(self.base, f"u-{uuid.uuid4().hex[:12]}")
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        stored = set(self._stored()) if exists else set()
        place = {b: (f"PARTITION ({BUCKET}={b})", f"LOCATION '{folder}/{BUCKET}={b}'") for b in touched}
        for b in stored & set(touched):
            self.spark.sql(f"ALTER TABLE {self.name} {place[b][0]} SET {place[b][1]}")
        added = [" ".join(place[b]) for b in touched if b not in stored]
        if added:
            self.spark.sql(f"ALTER TABLE {self.name} ADD {' '.join(added)}")
        self.spark.catalog.refreshTable(self.name)
        return touched

    def drop_old(self) -> int:
        """Delete folders that no bucket uses any more; returns their number."""
        used = {x.rstrip("/").rsplit("/", 2)[-2] + "/" + x.rstrip("/").rsplit("/", 1)[-1] for x in self._locations().values()}
        n = 0
        for u in list_dir(self.spark, self.base):
            if u.startswith("u-"):
                for b in list_dir(self.spark, os.path.join(self.base, u)):
                    if b.startswith(BUCKET) and f"{u}/{b}" not in used:
                        delete_path(self.spark, os.path.join(self.base, u, b))
                        n += 1
        return n
