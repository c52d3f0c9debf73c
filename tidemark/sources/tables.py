"""Parquet table access (S04 ``scan_parquet``).

``spark.read.parquet`` is lazy: Catalyst prunes the columns a query touches and pushes filters
into the scan, so callers select only what they need. A table is listed afresh at every read,
so files added since are seen. How many splits a scan has is the file layout's and
``spark.sql.files.maxPartitionBytes``' business.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name}")
    return spark.read.parquet(table_path(sf_dir, name))
