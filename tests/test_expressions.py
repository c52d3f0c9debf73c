"""Column expressions on small synthetic inputs with the export files' oddities (FIXTURES.md §1)."""

from pyspark.sql import functions as F

from tidemark.functions import expr as X


def _one(spark, rows, schema, col_expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col_expr).collect()]


def test_hms_to_minutes_and_seconds(spark):
    rows = [("227:24:21",), ("0:05:07",), ("12:30",), ("5:7:99x",), ("",), (None,), (" 1:00:00 ",)]
    mins = _one(spark, rows, "d string", X.hms_to_minutes("d"))
    assert mins == [227 * 60 + 24 + round(21 / 60, 4), 5.1167, 12.5, 0.0, 0.0, 0.0, 60.0]
    secs = _one(spark, rows, "d string", X.hms_to_seconds("d"))
    assert secs == [227 * 3600 + 24 * 60 + 21, 307, 0, 0, 0, 0, 3600]


def test_hms_to_hours_and_format(spark):
    hrs = _one(spark, [("2:30:00",), ("30:00",), ("bad",)], "d string", X.hms_to_hours("d"))
    assert hrs == [2.5, 0.5, 0.0]
    txt = _one(spark, [(3725,), (59,), (0,)], "s long", X.format_duration("s"))
    assert txt == ["1h 2m", "0m", "0m"]


def test_month_labels(spark):
    rows = [("Apr, 2025",), ("April 2025",), ("Feb,2026",), (None,)]
    df = spark.createDataFrame(rows, "m string")
    out = df.select(X.month_number("m").alias("n"), X.year_of_label("m").alias("y"), X.sort_key_yyyymm("m").alias("k")).collect()
    assert [tuple(r) for r in out[:2]] == [(4, 2025, 202504), (0, 0, 0)]
    assert out[3][2] == 0
    assert _one(spark, [(1,), (3,), (4,), (12,)], "m int", X.quarter_of_month("m")) == [1, 1, 2, 4]
    assert _one(spark, [("Apr, 2025",)], "m string", X.month_label_display("m")) == ["Apr 2025"]


def test_booleans_and_nullish(spark):
    rows = [("Yes",), (" TRUE ",), ("1",), ("No",), ("maybe",), (None,)]
    assert _one(spark, rows, "b string", X.bool_from_text_loose("b")) == [True, True, True, False, False, False]
    assert _one(spark, rows, "b string", X.bool_from_text_strict("b")) == [True, None, None, False, None, None]
    rows = [("Unknown",), (" n/a ",), ("x",), (None,), ("",)]
    assert _one(spark, rows, "s string", X.is_nullish("s")) == [True, True, False, True, True]
    assert _one(spark, rows, "s string", X.null_equivalent_to_null("s")) == [None, " n/a ", "x", None, None]


def test_ratios_and_growth(spark):
    rows = [(5, 0), (1, 3), (0, 0)]
    assert _one(spark, rows, "a long, b long", X.safe_ratio_pct("a", "b")) == [None, 100 / 3, None]
    assert _one(spark, rows, "a long, b long", X.safe_ratio_floor("a", "b")) == [5.0, 1 / 3, 0.0]
    g = spark.createDataFrame([(10, 0), (0, 0), (15, 10)], "c long, p long")
    out = g.select(*[X.growth_pct("c", "p", r).alias(r) for r in ("null", "zero", "hundred")]).collect()
    assert [tuple(r) for r in out] == [(None, 0.0, 100.0), (None, 0.0, 0.0), (50.0, 50.0, 50.0)]


def test_rounding_half_up_matches_duckdb(spark, duck):
    vals = [0.285, 0.125, 2.675, 1.005, 12.3456789]
    got = _one(spark, [(v,) for v in vals], "v double", X.round_half_up("v", 2))
    want = [duck.execute(f"SELECT {X.round_sql(f'CAST({v!r} AS DOUBLE)', 2)}").fetchall()[0][0] for v in vals]
    assert got == want


def test_week_bucket_sunday(spark):
    df = spark.createDataFrame([("2024-01-07 10:00:00",), ("2024-01-08 10:00:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r[0] for r in df.select(X.date_bucket("t", "week", "sunday")).collect()] == ["2024-01-07", "2024-01-07"]
    assert [r[0] for r in df.select(X.date_bucket("t", "week")).collect()] == ["2024-01-01", "2024-01-08"]
