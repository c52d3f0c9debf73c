"""Frame helpers: scalar attachment of one-row aggregates, table access with spreading."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidemark.functions.expr import with_scalars
from tidemark.sources import tables


def test_with_scalars_attaches_one_row_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 6.0)], "k int, v double")
    tot = df.agg(F.sum("v").alias("t"), F.max("v").alias("m"))
    got = sorted(tuple(r) for r in with_scalars(df, tot).collect())
    assert got == [(1, 2.0, 8.0, 6.0), (2, 6.0, 8.0, 6.0)]


def test_with_scalars_rejects_more_than_one_row(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(Exception):
        with_scalars(df, df.select(F.col("k").alias("x"))).collect()


def test_read_table_sees_appended_files(spark, tmp_path):
    from tidemark.sources import tables

    path = str(tmp_path / "events.parquet")
    spark.range(10).write.parquet(path)
    assert tables.read_table(spark, str(tmp_path), "events").count() == 10
    spark.range(10).write.mode("append").parquet(path)
    assert tables.read_table(spark, str(tmp_path), "events").count() == 20

def _chart(spark, rows, schema):
    from tidemark.operators.search import chart_frame

    kind, frame = chart_frame(spark.createDataFrame(rows, schema))
    return kind, None if frame is None else sorted((r["x"], r["series"], r["value"], r["place"]) for r in frame.collect())


def test_chart_frames(spark):
    assert _chart(spark, [("a", 1)], "name string, n long") == (None, None)
    kind, rows = _chart(spark, [("Jan", 1, 2.0), ("Feb", 3, None)], "Month string, n long, publish_rate_pct double")
    assert kind == "dual_axis" and rows[0] == ("Feb", "n", 3.0, None) and len(rows) == 4
    assert _chart(spark, [("Jan", 1, 2), ("Feb", 3, 4)], "month string, a long, b long")[0] == "line"
    kind, rows = _chart(spark, [("a", "x", 1), ("a", "x", 2), ("b", "y", 5), (None, "y", 1)], "p string, q string, n long")
    assert kind == "heatmap" and rows == [("a", "x", 3.0, None), ("a", "y", 0.0, None), ("b", "x", 0.0, None), ("b", "y", 5.0, None)]
    wide = [(f"p{i}", f"q{i}", i) for i in range(30)]  # too many members for a heat map: the largest rows
    kind, rows = _chart(spark, wide, "p string, q string, n long")
    assert kind == "bar" and len(rows) == 20 and {r[3] for r in rows} == set(range(1, 21)) and ("p29", "n", 29.0, 1) in rows
    kind, rows = _chart(spark, [(f"u{i:02d}", i // 2, 0.5) for i in range(40)], "u string, n long, publish_rate_pct double")
    assert kind == "dual_axis" and len(rows) == 30 and ("u38", "n", 19.0, 1) in rows and ("u39", "publish_rate_pct", 0.5, 2) in rows
    kind, rows = _chart(spark, [(f"u{i}", i, i, i, i, i) for i in range(25)], "u string, a long, b long, c long, d long, e long")
    assert kind == "bar" and len(rows) == 100 and {r[1] for r in rows} == set("abcd")
    assert _chart(spark, [(1, 2), (3, 4)], "a long, b long") == (None, None)
