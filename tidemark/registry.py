"""Key registry: every user-facing query/operator is registered under its survey key
with its Spark callable ``fn(spark, sf_dir) -> DataFrame`` and (when SQL can express it)
an equivalent DuckDB statement over the raw driver tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

MODULES = [
    "tidemark.plans.kpi",
    "tidemark.plans.corpus",
    "tidemark.plans.star",
    "tidemark.plans.ingest",
    "tidemark.operators.expressions",
    "tidemark.operators.filters",
    "tidemark.operators.joins",
    "tidemark.operators.aggregates",
    "tidemark.operators.windows",
    "tidemark.operators.ordering",
    "tidemark.operators.reshape",
    "tidemark.operators.quality",
    "tidemark.operators.audit",
    "tidemark.operators.search",
    "tidemark.sources.exports",
    "tidemark.streaming.files",
]


def query(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def load_all() -> None:
    # Importing the modules registers their keys.
    for m in MODULES:
        importlib.import_module(m)
