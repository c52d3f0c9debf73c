"""Upserts by bucket: the same rows as a whole rewrite, from a small share of it."""

import os
import random
import uuid

import pytest


def files(base):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    from tidemark.sources.keyed_table import KeyedTable

    name = f"keyed_{uuid.uuid4().hex[:8]}"
    yield KeyedTable(spark, name, str(tmp_path / "t"), "k", "version", buckets=16)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_small_upsert_rewrites_few_buckets(spark, tmp_path, table):
    first = [(i, 1, f"v{i}") for i in range(2000)]
    schema = "k long, version int, v string"
    assert len(table.upsert(spark.createDataFrame(first, schema))) == 16
    before = files(tmp_path)
    again = [(5, 2, "new"), (7, 0, "too old"), (5000, 1, "added"), (None, 9, "no key")]
    touched = table.upsert(spark.createDataFrame(again, schema))
    assert 1 <= len(touched) <= 3
    after = files(tmp_path)
    assert {f: t for f, t in after.items() if f in before} == before  # nothing of the old is rewritten
    size = sum(os.path.getsize(f) for f in after if f not in before)
    assert size < sum(os.path.getsize(f) for f in before) * 0.4
    want = {k: (ver, v) for k, ver, v in first} | {5: (2, "new"), 5000: (1, "added")}
    assert {r["k"]: (r["version"], r["v"]) for r in table.rows().collect()} == want
    assert table.rows().count() == len(want)
    assert table.drop_old() == len(touched)
    assert table.rows().count() == len(want)


def test_upserts_equal_the_latest_rows(spark, table):
    rng = random.Random(2)
    want = {}
    for step in range(4):
        rows = [(rng.randint(0, 60), rng.randint(0, 9) * 10 + step, f"{step}-{i}") for i in range(rng.choice([1, 30]))]
        table.upsert(spark.createDataFrame(rows, "k long, version int, v string"))
        for k, ver, v in rows:
            # equal versions of a key: the smaller row
            best = min([(-ver, v)] + ([(-want[k][0], want[k][1])] if k in want else []))
            want[k] = (-best[0], best[1])
        assert {r["k"]: (r["version"], r["v"]) for r in table.rows().collect()} == want
    assert table.upsert(spark.createDataFrame([], "k long, version int, v string")) == []
    assert table.rows().count() == len(want)
