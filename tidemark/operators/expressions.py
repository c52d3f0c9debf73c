"""Table-level checks of the column expressions (survey §2.9, X-keys).

Each key applies one expression from ``functions/expr.py`` to rows derived from the driver
tables; malformed inputs (bad durations, bad month labels, odd booleans) are injected by
expression on a fixed subset of rows, so every rule is exercised on every scale.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.functions.expr import round_half_up, round_sql, with_scalars
from tidemark.operators.filters import hms_text
from tidemark.plans.marts import marts_for, monthly_mart
from tidemark.registry import query
from tidemark.sources.domain import QA_PREFIX, Domain, oracle


def D(spark, sf):
    return Domain(spark, sf)


BAD_LINE = 7  # rows with this line number get a malformed duration text


def _durations(spark, sf):
    c = D(spark, sf).clips("video_id", "line_no", "created_secs")
    t = hms_text("created_secs")
    # Line 7 → trailing junk; line 6 → two-part 'mm:ss' form; others 'h:mm:ss'.
    mmss = F.format_string("%d:%02d", F.floor(F.col("created_secs") / 60).cast("bigint"), F.pmod("created_secs", F.lit(60)))
    txt = F.when(F.col("line_no") == BAD_LINE, F.concat(t, F.lit("x"))).when(F.col("line_no") == 6, mmss).otherwise(t)
    return c.select("video_id", "created_secs", "line_no", txt.alias("duration"))


_H = "CAST(floor(created_secs / 3600) AS DOUBLE)"
_M = "CAST(floor((created_secs % 3600) / 60) AS DOUBLE)"
_S = "CAST(created_secs % 60 AS DOUBLE)"
_MM = "CAST(floor(created_secs / 60) AS DOUBLE)"


@query("x01_hms_to_minutes", oracle(
    f"""SELECT video_id, CASE WHEN line_no = {BAD_LINE} THEN 0.0
            WHEN line_no = 6 THEN {round_sql(f'{_MM} + {_S} / 60', 4)}
            ELSE {round_sql(f'{_H} * 60 + {_M} + {_S} / 60', 4)} END AS minutes FROM clips""", "clips"))
def x01(spark, sf):
    d = _durations(spark, sf)
    return d.select("video_id", X.hms_to_minutes("duration").alias("minutes"))


@query("x02_hms_to_seconds", oracle(
    f"""SELECT video_id, CAST(CASE WHEN line_no IN ({BAD_LINE}, 6) THEN 0 ELSE created_secs END AS BIGINT) AS secs FROM clips""",
    "clips"))
def x02(spark, sf):
    d = _durations(spark, sf)
    return d.select("video_id", X.hms_to_seconds("duration").alias("secs"))


@query("x03_hms_to_hours", oracle(
    f"""SELECT video_id, CASE WHEN line_no = {BAD_LINE} THEN 0.0
            WHEN line_no = 6 THEN {round_sql(f'{_MM} / 60 + {_S} / 3600', 6)}
            ELSE {round_sql(f'{_H} + {_M} / 60 + {_S} / 3600', 6)} END AS hours FROM clips""", "clips"))
def x03(spark, sf):
    d = _durations(spark, sf)
    return d.select("video_id", round_half_up(X.hms_to_hours("duration"), 6).alias("hours"))


@query("x04_secs_to_hours", oracle(
    f"SELECT user_name, {round_sql('created_secs / 3600.0', 2)} AS created_hours, created_secs / 60.0 AS created_mins FROM mart_users",
    "mart_users"))
def x04(spark, sf):
    m = marts_for(D(spark, sf), "users")
    return m.select("user_name", X.secs_to_hours("created_secs").alias("created_hours"), X.secs_to_minutes("created_secs").alias("created_mins"))


@query("x05_format_duration", oracle(
    """SELECT month, CASE WHEN created_secs >= 3600 THEN printf('%dh %dm', CAST(floor(created_secs / 3600) AS BIGINT), CAST(floor((created_secs % 3600) / 60) AS BIGINT))
            ELSE printf('%dm', CAST(floor((created_secs % 3600) / 60) AS BIGINT)) END AS created_text FROM mart_monthly""",
    "mart_monthly"))
def x05(spark, sf):
    m = monthly_mart(D(spark, sf))
    return m.select("month", X.format_duration("created_secs").alias("created_text"))


def _labels(spark, sf):
    """Month labels; uploads of 1995 carry a malformed label ('January 1995')."""
    u = D(spark, sf).uploads("upload_ts").select(
        F.when(F.year("upload_ts") == 1995, F.date_format("upload_ts", "MMMM yyyy")).otherwise(F.date_format("upload_ts", "MMM, yyyy")).alias("label"))
    return u.distinct()


_LABELS_SQL = """SELECT DISTINCT CASE WHEN year(upload_ts) = 1995 THEN strftime(upload_ts, '%B %Y') ELSE strftime(upload_ts, '%b, %Y') END AS label
  FROM uploads"""


@query("x06_parse_month_label", oracle(
    """SELECT label, CAST(COALESCE(month(try_strptime(label, '%b, %Y')), 0) AS INTEGER) AS month_number,
       CAST(COALESCE(year(try_strptime(label, '%b, %Y')), 0) AS INTEGER) AS year,
       CAST(COALESCE(year(try_strptime(label, '%b, %Y')) * 100 + month(try_strptime(label, '%b, %Y')), 0) AS INTEGER) AS sort_key
  FROM l""", "uploads", extra=[("l", _LABELS_SQL)]))
def x06(spark, sf):
    l = _labels(spark, sf)
    return l.select("label", X.month_number("label").cast("int").alias("month_number"), X.year_of_label("label").cast("int").alias("year"),
                    X.sort_key_yyyymm("label").cast("int").alias("sort_key"))


@query("x07_month_label_display", oracle("SELECT month, replace(month, ',', '') AS display FROM mart_monthly", "mart_monthly"))
def x07(spark, sf):
    return monthly_mart(D(spark, sf)).select("month", X.month_label_display("month").alias("display"))


@query("x08_quarter", oracle(
    "SELECT month, CAST((month_number - 1) // 3 + 1 AS INTEGER) AS quarter FROM mart_monthly", "mart_monthly"))
def x08(spark, sf):
    return monthly_mart(D(spark, sf)).select("month", X.quarter_of_month("month_number").alias("quarter"))


@query("x09_date_buckets", oracle(
    """SELECT strftime(CAST(date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE), '%Y-%m-%d') AS week_start_sunday,
       CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1"""))
def x09(spark, sf):
    e = D(spark, sf).t("events").select("ts")
    return e.groupBy(X.date_bucket("ts", "week", week_start="sunday").alias("week_start_sunday")).agg(F.count(F.lit(1)).alias("n"))


@query("x10_sort_key_yyyymm", oracle(
    "SELECT month, CAST(year * 100 + month_number AS INTEGER) AS sort_key FROM mart_monthly", "mart_monthly"))
def x10(spark, sf):
    return monthly_mart(D(spark, sf)).select("month", X.sort_key_yyyymm("month").cast("int").alias("sort_key"))


def _flag_text(spark, sf):
    l = D(spark, sf).t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    txt = (F.when(F.col("l_linenumber") == BAD_LINE, F.lit(None))
           .when(F.col("l_returnflag") == "R", F.lit("Yes"))
           .when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", F.lit(" TRUE ")).otherwise(F.lit("1")))
           .otherwise(F.lit("No")))
    return l.select("l_returnflag", "l_linestatus", txt.alias("txt"))


_FLAG_SQL = f"""SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = {BAD_LINE} THEN NULL WHEN l_returnflag = 'R' THEN 'Yes'
       WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN ' TRUE ' ELSE '1' END ELSE 'No' END AS txt FROM lineitem"""


@query("x11_bool_from_text_loose", oracle(
    """SELECT txt, COALESCE(lower(trim(txt)) IN ('yes', 'true', '1'), false) AS flag, CAST(COUNT(*) AS BIGINT) AS n
  FROM f GROUP BY ALL""", extra=[("f", _FLAG_SQL)]))
def x11(spark, sf):
    f = _flag_text(spark, sf)
    return f.groupBy("txt", X.bool_from_text_loose("txt").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("x12_bool_from_text_strict", oracle(
    """SELECT txt, CASE WHEN upper(txt) = 'YES' THEN true WHEN upper(txt) = 'NO' THEN false END AS flag, CAST(COUNT(*) AS BIGINT) AS n
  FROM f GROUP BY ALL""", extra=[("f", _FLAG_SQL)]))
def x12(spark, sf):
    f = _flag_text(spark, sf)
    return f.groupBy("txt", X.bool_from_text_strict("txt").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("x13_is_nullish", oracle(
    """SELECT CAST(COUNT(*) FILTER (WHERE t IS NULL OR trim(t) IN ('', ' ', 'N/A', 'n/a', 'NA', 'none', 'None', 'Unknown', 'unknown', 'NULL', 'null')) AS BIGINT) AS nullish,
       CAST(COUNT(*) AS BIGINT) AS total
  FROM (SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN ' Unknown ' ELSE c_mktsegment END AS t FROM customer) x"""))
def x13(spark, sf):
    c = D(spark, sf).t("customer").select(
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None)).when(F.col("c_mktsegment") == "BUILDING", F.lit(" Unknown "))
        .otherwise(F.col("c_mktsegment")).alias("t"))
    return c.agg(F.count_if(X.is_nullish("t")).alias("nullish"), F.count(F.lit(1)).alias("total"))


@query("x14_safe_ratio_pct", oracle(
    f"SELECT user_name, {round_sql('CAST(published_count AS DOUBLE) * 100.0 / NULLIF(CAST(uploaded_count - uploaded_count AS DOUBLE), 0)', 2)} AS undefined_rate, "
    f"{round_sql('CAST(published_count AS DOUBLE) * 100.0 / NULLIF(CAST(created_count AS DOUBLE), 0)', 2)} AS rate FROM mart_users", "mart_users"))
def x14(spark, sf):
    m = marts_for(D(spark, sf), "users")
    return m.select("user_name", round_half_up(X.safe_ratio_pct("published_count", F.col("uploaded_count") - F.col("uploaded_count")), 2).alias("undefined_rate"),
                    round_half_up(X.safe_ratio_pct("published_count", "created_count"), 2).alias("rate"))


@query("x15_safe_ratio_floor", oracle(
    f"SELECT input_type, {round_sql('CAST(published_count AS DOUBLE) / GREATEST(CAST(published_count - published_count AS DOUBLE), 1.0)', 2)} AS floored FROM mart_input_types",
    "mart_input_types"))
def x15(spark, sf):
    m = marts_for(D(spark, sf), "input_types")
    return m.select("input_type", round_half_up(X.safe_ratio_floor("published_count", F.col("published_count") - F.col("published_count")), 2).alias("floored"))


@query("x16_round_half", oracle(
    """SELECT l_linenumber, CAST(l_linenumber AS DOUBLE) + 0.5 AS v,
       round(CAST(l_linenumber AS DOUBLE) + 0.5, 0) AS half_up, round_even(CAST(l_linenumber AS DOUBLE) + 0.5, 0) AS half_even,
       round(CAST(l_linenumber AS DOUBLE) / 4, 1) AS q_up, round_even(CAST(l_linenumber AS DOUBLE) / 4, 1) AS q_even
  FROM (SELECT DISTINCT l_linenumber FROM lineitem) x"""))
def x16(spark, sf):
    l = D(spark, sf).t("lineitem").select("l_linenumber").distinct()
    v = F.col("l_linenumber").cast("double") + F.lit(0.5)
    q = F.col("l_linenumber").cast("double") / F.lit(4.0)
    return l.select("l_linenumber", v.alias("v"), F.round(v, 0).alias("half_up"), F.bround(v, 0).alias("half_even"),
                    F.round(q, 1).alias("q_up"), F.bround(q, 1).alias("q_even"))


@query("x17_cast_float_sql", oracle(
    """SELECT l_returnflag, CAST(SUM(CAST(l_returnflag = 'R' AS INTEGER)) AS BIGINT) AS flag_sum,
       CAST(CAST(COUNT(*) AS FLOAT) AS DOUBLE) AS n_float FROM lineitem GROUP BY l_returnflag"""))
def x17(spark, sf):
    l = D(spark, sf).t("lineitem").select("l_returnflag")
    return l.groupBy("l_returnflag").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).cast("bigint").alias("flag_sum"),
                                         F.count(F.lit(1)).cast("float").cast("double").alias("n_float"))


@query("x18_coalesce_default", oracle(
    """SELECT CAST(COALESCE((SELECT MAX(c_custkey) FROM customer WHERE c_custkey < 0), 0) AS BIGINT) AS empty_max,
       CAST(COALESCE((SELECT MAX(c_custkey) FROM customer), 0) AS BIGINT) AS max_id"""))
def x18(spark, sf):
    c = D(spark, sf).t("customer")
    a = c.where(F.col("c_custkey") < 0).agg(F.coalesce(F.max("c_custkey"), F.lit(0)).cast("bigint").alias("empty_max"))
    b = c.agg(F.coalesce(F.max("c_custkey"), F.lit(0)).cast("bigint").alias("max_id"))
    return with_scalars(a, b)


@query("x19_case_severity", oracle(
    """SELECT channel_name, CASE WHEN 100 - publish_rate > 70 THEN 'high' WHEN 100 - publish_rate > 60 THEN 'medium' ELSE 'info' END AS severity
  FROM mart_channels""", "mart_channels"))
def x19(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    return m.select("channel_name", X.severity(F.lit(100.0) - F.col("publish_rate"), 70, 60).alias("severity"))


@query("x20_like_prefix", oracle(
    f"SELECT CAST(COUNT(*) FILTER (WHERE user_name NOT LIKE '{QA_PREFIX}%') AS BIGINT) AS real_users FROM mart_users", "mart_users"))
def x20(spark, sf):
    m = marts_for(D(spark, sf), "users")
    return m.agg(F.count_if(~X.like_prefix("user_name", QA_PREFIX)).alias("real_users"))


@query("x21_lower_like_contains", oracle(
    "SELECT headline, CAST(COUNT(*) AS BIGINT) AS n FROM clips WHERE lower(headline) LIKE '%bolt%' GROUP BY headline", "clips"))
def x21(spark, sf):
    c = D(spark, sf).clips("headline")
    return c.where(F.lower("headline").like("%bolt%")).groupBy("headline").agg(F.count(F.lit(1)).alias("n"))


@query("x22_strptime", oracle(
    "SELECT month, CAST(strptime(month, '%b, %Y') AS DATE) AS month_start FROM mart_monthly", "mart_monthly"))
def x22(spark, sf):
    return monthly_mart(D(spark, sf)).select("month", X.parse_month_label("month").alias("month_start"))


@query("x23_now_utc", oracle(
    "SELECT now() > MAX(created_ts) AS after_data, true AS has_z FROM clips", "clips"))
def x23(spark, sf):
    c = D(spark, sf).clips("created_ts")
    return c.agg((F.current_timestamp() > F.max("created_ts")).alias("after_data"),
                 F.max(X.now_iso_utc().endswith("Z")).alias("has_z"))


@query("x25_growth_pct", oracle(
    f"""SELECT month, {round_sql('(CAST(c AS DOUBLE) - p) * 100.0 / NULLIF(CAST(p AS DOUBLE), 0)', 2)} AS g_null,
       CASE WHEN p = 0 THEN 0.0 ELSE {round_sql('(CAST(c AS DOUBLE) - p) * 100.0 / NULLIF(CAST(p AS DOUBLE), 0)', 2)} END AS g_zero,
       CASE WHEN p = 0 THEN CASE WHEN c > 0 THEN 100.0 ELSE 0.0 END ELSE {round_sql('(CAST(c AS DOUBLE) - p) * 100.0 / NULLIF(CAST(p AS DOUBLE), 0)', 2)} END AS g_hundred
  FROM (SELECT month, published_count AS c, LAG(published_count) OVER (ORDER BY year, month_number) % 7 AS p FROM mart_monthly) x""",
    "mart_monthly"))
def x25(spark, sf):
    from pyspark.sql import Window

    m = monthly_mart(D(spark, sf))
    # prev mod 7 injects zero denominators on a data-derived subset of months.
    p = F.pmod(F.lag("published_count").over(Window.orderBy("year", "month_number")), F.lit(7))
    x = m.select("month", F.col("published_count").alias("c"), p.alias("p"))
    return x.select("month", *[round_half_up(X.growth_pct(F.col("c"), F.col("p"), r), 2).alias(f"g_{r}") for r in ("null", "zero", "hundred")])


@query("x26_composite_score", oracle(
    f"""SELECT channel_name, {round_sql('0.4 * publish_rate + 0.3 * (100.0 - (100.0 - publish_rate)) + 0.3 * LEAST(multiplication_ratio * 20.0, 100.0)', 2)} AS score
  FROM mart_channels""", "mart_channels"))
def x26(spark, sf):
    m = marts_for(D(spark, sf), "channels")
    return m.select("channel_name", round_half_up(X.composite_score(F.col("publish_rate"), F.lit(100.0) - F.col("publish_rate"),
                                                                    F.col("multiplication_ratio")), 2).alias("score"))


@query("x27_clip_floor_zero", oracle(
    "SELECT user_name, GREATEST(published_count - created_count, 0) AS over_published, GREATEST(created_count - published_count, 0) AS waste FROM mart_users",
    "mart_users"))
def x27(spark, sf):
    m = marts_for(D(spark, sf), "users")
    return m.select("user_name", X.clip_floor_zero(F.col("published_count") - F.col("created_count")).alias("over_published"),
                    X.clip_floor_zero(F.col("created_count") - F.col("published_count")).alias("waste"))


@query("x29_percent_of_total", oracle(
    f"""SELECT input_type, CASE WHEN SUM(created_count) OVER () = 0 THEN 0.0
            ELSE {round_sql('created_count * 100.0 / SUM(created_count) OVER ()', 1)} END AS pct FROM mart_input_types""",
    "mart_input_types"))
def x29(spark, sf):
    m = marts_for(D(spark, sf), "input_types")
    tot = m.agg(F.sum("created_count").alias("_t"))
    return with_scalars(m, tot).select("input_type", X.percent_of_total("created_count", "_t").alias("pct"))
