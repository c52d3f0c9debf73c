"""The stored run of the quality suite, and foreign keys with orphans and nulls."""

import os
import shutil

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tidemark.operators import quality
from tidemark.operators.quality import CHECKED_TABLES, RESULT_COLS, run_all, store_checks, stored_checks
from test_oracle import _rows


def tables(tmp_path):
    for t in CHECKED_TABLES:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def rows(df):
    return sorted(map(tuple, df.select(*RESULT_COLS).collect()), key=str)


def test_reports_read_the_stored_run_until_a_file_changes(spark, tmp_path, monkeypatch):
    sf = tables(tmp_path)
    first = rows(store_checks(spark, sf))
    assert first == rows(run_all(spark, sf))

    def never(*a, **k):
        raise AssertionError("the suite ran again")

    real = quality.run_all
    monkeypatch.setattr(quality, "run_all", never)
    assert rows(stored_checks(spark, sf)) == first
    assert E.queries()["q23_dq_overall_summary"](spark, sf).first()["files"] == 7
    monkeypatch.setattr(quality, "run_all", real)
    # Clips without part, of unknown orders, and with no supplier at all.
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    extra = l.limit(30).withColumns({"l_partkey": F.lit(10**9), "l_suppkey": F.lit(None).cast("long"),
                                     "l_orderkey": F.when(F.col("l_linenumber") == 1, F.col("l_orderkey") + 10**8).otherwise(F.col("l_orderkey"))})
    l.unionByName(extra).write.parquet(str(tmp_path / "changed"))
    os.replace(tmp_path / "lineitem.parquet", tmp_path / "before.parquet")
    os.replace(tmp_path / "changed", tmp_path / "lineitem.parquet")
    got = {r["name"]: r["count"] for r in stored_checks(spark, sf).where("tbl = 'referential'").collect()}
    con = duckdb.connect()
    for t in CHECKED_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet{'/*.parquet' if t == 'lineitem' else ''}')")
    cur = con.execute(E.oracle_sql()["q14_dq_referential"])
    want = cur.fetchall()
    assert _rows(RESULT_COLS, rows(E.queries()["q14_dq_referential"](spark, sf))) == _rows([d[0] for d in cur.description], want)
    assert got["referential:lineitem.l_partkey"] == 30 and got["referential:lineitem.l_suppkey"] == 0 and got["referential:lineitem.l_orderkey"] > 0


def test_other_issues_weigh_less(spark):
    rows = [("a", "t", "FAIL"), ("b", "t", "WARN"), ("c", "t", "INFO"), ("d", "t", "PASS"), ("e", "u", "INFO")]
    got = {r["tbl"]: r["score"] for r in quality.file_scores(spark.createDataFrame(rows, "name string, tbl string, status string")).collect()}
    assert got == {"t": 100 - 15 - 8 - 2, "u": 98}
